"""Near-duplicate documents by an exact Jaccard join of their word shingles.

Pairs come from the SimHash index first: fingerprints of the same shingles within its distance. At the similarities asked
for, most pairs lie beyond that distance, so the rest is found without fingerprints. Shingles are put in order of rarity; two sets of similarity ``similarity`` or more share one among the first
n - ceil(similarity * n) + 1 of each. At a shingle every set first meets one other, then, in a second round, only sets
that the links found so far leave in another component. Every pair is verified on the whole sets before it links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm import lines, simhash
from ragframe.llm.common import arrow_map, dropped, numbered, stored, texts_of, written
from ragframe.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[bytes], words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every shingle; a text of fewer words is one shingle, a text without words has none."""
    if not any(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    line, word, _ = lines.words_by_line(texts)
    n = np.bincount(np.searchsorted(np.cumsum(lines._line_counts(texts)), line, "right"), minlength=len(texts))
    width = np.minimum(n, words)
    size = np.where(n > 0, n - width + 1, 0)
    of = np.repeat(np.arange(len(texts)), size)
    at = (np.cumsum(n) - n)[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    h = width[of].astype(np.uint64)
    for i in range(words):
        inside = np.flatnonzero(i < width[of])
        h[inside] = h[inside] * _BASE + word[at[inside] + i]
    return of, lines._mixed(h, 0)


class ShingleSets:
    """The distinct shingles of a batch's texts, rarest first: hashes flat, with first hash and size per text."""

    def __init__(self, texts: list[bytes], words: int, rare: np.ndarray | None = None):
        of, h = shingle_hashes(texts, words)
        seen = rare[(h & np.uint64(lines.SLOTS - 1)).astype(np.int64)] if rare is not None else np.zeros(len(h), np.int64)
        order = np.lexsort((h, seen, of))
        of, h = of[order], h[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])][: len(h)]
        self.hash, of = h[new], of[new]
        self.size = np.bincount(of, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        sums = np.r_[np.uint64(0), np.cumsum(lines._mixed(self.hash, 1))]
        self.key = sums[self.first + self.size] - sums[self.first]  # zero for a text without words


def _entries(batch: pa.RecordBatch, words: int, rare: np.ndarray, similarity: float) -> pa.RecordBatch | None:
    """(text) -> (token, key, n, at): the prefix of every distinct set of the batch."""
    sets = ShingleSets(texts_of(batch.column(0)), words, rare)
    keep = np.unique(sets.key, return_index=True)[1]
    keep = keep[sets.size[keep] > 0]
    n = sets.size[keep]
    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    of = np.repeat(np.arange(len(keep)), prefix)
    at = np.arange(len(of)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    columns = [sets.hash[sets.first[keep][of] + at].view(np.int64), sets.key[keep][of].view(np.int64), n[of].astype(np.int32), at.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n", "at"])


def _least(n: Column, m: Column, similarity: float) -> Column:
    """Common shingles that sets of n and m need: J >= s iff common >= s / (1 + s) * (n + m)."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9)


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether two entries of one token can be similar, by their sizes and the token's places."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at")) >= _least(n, m, similarity)


def _verified(pairs: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``keyed(key, text)`` whose whole sets are similar."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = written(wanted, "wanted")

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = ShingleSets(texts_of(batch.column(1)), words)
        offsets = pa.array(np.r_[0, np.cumsum(sets.size)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(sets.hash.view(np.int64)))], names=["key", "hashes"]
        )

    texts = keyed.join(lines._hinted(wanted), "key", "left_semi").select("key", "text")
    sets, path = stored(arrow_map(texts, build, "key long, hashes array<long>"), "sets")
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    similar = written(joined.filter(common >= _least(F.size("x"), F.size("y"), similarity)).select("a", "b"), "links")
    dropped(keyed.sparkSession, path)
    return similar


def _indexed(texts: DataFrame, words: int) -> DataFrame:
    """``texts(key, text)`` -> pairs (a, b), b < a, that the SimHash index links, a spanning set of them."""
    prints = written(simhash.fingerprints(texts, "key", words), "prints")
    least = written(prints.groupBy("fp").agg(F.min("key").alias("least")), "least")
    equal = prints.join(least, "fp").select(F.col("key").alias("a"), F.col("least").alias("b"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}")) for c in ("a", "b")]
    near = simhash.links(least.select("fp")).join(ends[0], "a").join(ends[1], "b").select("key_a", "key_b")
    pairs = equal.unionByName(near.toDF("a", "b")).filter("a <> b")
    return written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "indexed")


def _components(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``rows(row, doc)`` -> (row, component) over links of Jaccard ``similarity`` or more; texts without words are one."""
    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = ShingleSets(texts_of(batch.column(1)), words)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets.key.view(np.int64))], names=["row", "text", "key"])

    classes = written(arrow_map(rows.select("row", "doc.text"), keys, "row long, text string, key long"), "classes")
    # One text of each set: copies would only repeat its entries. Where they are few, no text moves to leave them out.
    copied = classes.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = written(classes.select("row", "key").join(copied, "key").filter("row <> first").select("row"), "copies")
    keyed = classes.join(lines._hinted(copies), "row", "left_anti").select("key", "text")
    if copies.count() > lines.FEW:
        keyed = written(keyed, "keyed")
    indexed = _indexed(keyed, words)
    texts = keyed.select("text")
    rare = lines.rarity(texts, lambda t: shingle_hashes(t, words)[1])
    held = rows.sparkSession.sparkContext.broadcast(rare)  # lines.SLOTS numbers
    entries = arrow_map(texts, lambda b: _entries(b, words, held.value, similarity), "token long, key long, n int, at int")
    # Windows deal the entries once; a shingle's rows are spilled, not held, by the task that has them.
    one, token = F.struct("key", "n", "at"), Window.partitionBy("token")
    shared = entries.select("token", one.alias("a")).select("token", "a", F.min("a").over(token).alias("b"), F.count("*").over(token).alias("members"))
    shared, shared_at = stored(shared.filter("members > 1").drop("members"), "shared")
    star = shared.filter(F.col("a.key") != F.col("b.key")).filter(_fits("a", "b", similarity))
    star = star.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct().unionByName(indexed).distinct()
    star = written(star, "star")
    links = _verified(star, keyed, words, similarity)

    known = connected_components(links).select(F.col("node").alias("key"), "root")
    placed = shared.select("token", "a", F.col("a.key").alias("key")).join(known, "key", "left")
    placed = placed.select("token", "a", F.coalesce("root", "key").alias("root"))
    placed = placed.select("*", F.min("root").over(token).alias("low"), F.max("root").over(token).alias("high"))
    left, left_at = stored(placed.filter("low < high").drop("low", "high"), "apart")
    dropped(rows.sparkSession, shared_at)
    right = left.select("token", F.col("a").alias("b"), F.col("root").alias("other"))
    rest = left.join(right, "token").filter((F.col("root") != F.col("other")) & (F.col("b.key") < F.col("a.key")))
    rest = rest.filter(_fits("a", "b", similarity)).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    rest = written(rest.join(star, ["a", "b"], "left_anti"), "rest")
    dropped(rows.sparkSession, left_at)
    links = links.unionByName(_verified(rest, keyed, words, similarity))
    roots = connected_components(links).select(F.col("node").alias("key"), "root")
    return classes.select("row", "key").join(roots, "key", "left").select("row", F.coalesce("root", "key").alias("component"))


def keep_one(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, the one of the least id (null last), columns unchanged."""
    rows = numbered(docs)
    ids = rows.select("row", F.col("doc")[id_column].alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = _components(rows, words, similarity).join(ids, "row").groupBy("component").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")
