"""Exact top-k inner products by Fagin's threshold algorithm.

Each task holds its vectors in shards and keeps, per dimension, the order of the shard's values: read from the front
for a positive query component and from the back for a negative one. All queries of a block go down their lists in
step; every vector met is scored in full, and a query stops as soon as its k-th score beats the best score that the
values at its depth still allow. Queries come in blocks of bounded size, so that the vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import written

SCALE = 256
K = 5
EVERY = 50
# Queries handed to one pass over the vectors: at most this many, and at most this many components.
BLOCK = 4096
BLOCK_VALUES = 1 << 20
SHARD = 8192
FIRST_DEPTH = 32


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with v = floor(scale * x) as longs; vectors that are null or hold null or non-finite values go."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(x.isNotNull() & fine).select(
        F.col(id_column).alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v")
    )


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -(2**62))
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if len(score) > k:  # those that tie with the k-th stay for the order by id
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, ids = score[near], ids[near]
        score, ids = np.r_[self.score[q], score], np.r_[self.id[q], ids]
        order = np.lexsort((ids, -score))[:k]
        self.score[q], self.id[q] = score[order], ids[order]


def threshold(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Merge one shard of vectors into ``best``. Integer sums are exact."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    values = np.take_along_axis(vectors, order, axis=0)
    for q in range(len(queries)):
        w = queries[q]
        used = np.flatnonzero(w)
        seen = np.zeros(n, bool)
        depth, step = 0, FIRST_DEPTH
        up = w[used] > 0
        while depth < n:
            to = min(n, depth + step)
            rows = np.where(up, n - 1 - np.arange(depth, to)[:, None], np.arange(depth, to)[:, None])
            met = np.unique(order[rows, used]) if len(used) else np.arange(n)
            met = met[~seen[met]]
            seen[met] = True
            met = met[ids[met] != query_ids[q]]
            if len(met):
                best.add(q, vectors[met] @ w, ids[met])
            if not len(used) or seen.all():
                break
            bound = int((w[used] * values[np.where(up, n - to, to - 1), used]).sum())
            if best.score[q, -1] > bound:  # an unseen vector that ties could have a smaller id
                break
            depth, step = to, 2 * step


def search(
    queries: DataFrame, vectors: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD
) -> DataFrame:
    """``queries(id, v)`` against ``vectors(id, v)``: (query_id, rank, vec_id, score), at most k rows a query.

    A vector with the query's own id is no candidate, null ids are dropped, and rows that repeat an id are
    candidates one by one. Queries and vectors meet only where their lengths agree.
    """
    spark = vectors.sparkSession
    asked = written(queries.filter("id is not null and v is not null"), "queries")
    facts = asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()
    vectors = vectors.filter("id is not null")
    parts = []
    for d, n in sorted(facts):
        size = max(1, min(block, BLOCK_VALUES // max(d, 1)))
        blocks = -(-n // size)
        of = F.pmod(F.xxhash64("id"), F.lit(blocks))
        for b in range(blocks):
            rows = asked.filter(F.size("v") == d).filter(of == b).toArrow()  # one block: bounded
            for at in range(0, rows.num_rows, size):
                part = rows.slice(at, size)
                parts.append(_pass(part, vectors.filter(F.size("v") == d), int(d), k, shard))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(part: pa.Table, vectors: DataFrame, dims: int, k: int, shard: int) -> DataFrame:
    """One block of queries against all vectors; each task returns its k best per query."""
    query_ids = np.asarray(part.column(0).combine_chunks()).astype(np.int64)
    flat = np.asarray(part.column(1).combine_chunks().flatten()).astype(np.int64)
    wanted = flat.reshape(len(query_ids), dims)
    seen_before = {}
    copies = np.array([seen_before.setdefault(i, []).append(0) or len(seen_before[i]) - 1 for i in query_ids.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, held_ids, rows = Best(len(query_ids), k), [], [], 0

        def flush() -> None:
            if held:
                threshold(wanted, query_ids, np.concatenate(held), np.concatenate(held_ids), best)
                held.clear()
                held_ids.clear()

        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            held.append(np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(len(ids), dims))
            held_ids.append(ids)
            rows += len(ids)
            if rows >= shard:
                flush()
                rows = 0
        flush()
        q, r = np.nonzero(best.id != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[q]), pa.array(copies[q]), pa.array(best.id[q, r]), pa.array(best.score[q, r])],
            names=["query_id", "copy", "vec_id", "score"],
        )

    return vectors.select("id", "v").mapInArrow(run, "query_id long, copy int, vec_id long, score long")
