"""Embedding jobs: the row-local hash embedder, validation, and TF-IDF weights."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions import text as tx
from ragframe.functions import vectors as vx
from ragframe.operators import words
from ragframe.session import stored

HASH_MODEL = "hash-384"
BATCH = 64
RETRIES = 3
BACKOFF_SECONDS = 0.5
# Whole-number idf keeps sums exact; scores are reported to four decimals.
IDF_SCALE = 10_000


def hash_embed(df: DataFrame, text: str = "content", dimensions: int = vx.DIMENSIONS) -> DataFrame:
    """Add ``model`` and sparse ``vector`` (slot, q). One projection: no shuffle, no Python."""
    counted = vx.add_hashed_counts(df, tx.tokenize(F.col(text)), "_counts", dimensions)
    return counted.select(
        *df.columns, F.lit(HASH_MODEL).alias("model"), tx.seal(vx.quantize_counts(F.col("_counts"))).alias("vector")
    )


# A worker remembers the hashes of so many tokens, looks the distinct ones of so many rows up at once, and adds so many up.
KNOWN_TOKENS = 1_000_000
STEP_ROWS = 10_000
DENSE_ROWS = 1024


class _Codes(dict):
    """2 * slot + odd of every token seen so far, as in ``vx.add_hashed_counts``."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        head = int.from_bytes(hashlib.sha256(token.encode()).digest()[:5], "big")
        code = (head >> 8) % self.dimensions * 2 + head % 2
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        self[token] = code
        return code


def _hashed(lowered: pa.Array, codes: _Codes) -> pa.Array:
    """Quantised vectors of lower-cased texts; sums of signs are whole numbers, so their order cannot show."""
    n, dimensions = len(lowered), codes.dimensions
    token_row, tokens = words.tokens(lowered)
    distinct = tokens.dictionary_encode()
    known = np.fromiter(map(codes.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(distinct.dictionary))
    code = known[distinct.indices.to_numpy(zero_copy_only=False)]
    cut = np.searchsorted(token_row, np.arange(0, n + DENSE_ROWS, DENSE_ROWS))
    rows, slots, values = [], [], []
    for first, a, b in zip(range(0, n, DENSE_ROWS), cut[:-1], cut[1:], strict=False):
        cell, sign = (token_row[a:b] - first) * dimensions + (code[a:b] >> 1), 1.0 - 2.0 * (code[a:b] & 1)
        # Without any token bincount gives whole numbers, weights or not.
        sums = np.bincount(cell, sign).astype(float, copy=False)
        held = np.flatnonzero(sums)
        rows.append(first + held // dimensions)
        slots.append(held % dimensions)
        values.append(sums[held])
    row, slot, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, slots, values))
    norm = np.sqrt(np.bincount(row, value * value, n))
    exact = value / norm[row] * vx.SCALE
    # Halves go away from zero, as in Spark's round; the largest double below a half keeps the sum from rounding up.
    q = (np.sign(exact) * np.floor(np.abs(exact) + np.nextafter(0.5, 0))).astype(np.int64)
    row, slot, q = row[q != 0], slot[q != 0], q[q != 0]
    entries = pa.StructArray.from_arrays([pa.array(slot, pa.int32()), pa.array(q)], ["slot", "q"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), entries)


def hash_embed_batches(df: DataFrame, text: str = "content", dimensions: int = vx.DIMENSIONS) -> DataFrame:
    """``hash_embed`` for a corpus: the same rows without a shuffle, hashed by batches of Arrow rows.

    A word is hashed once by a worker that remembers it, and a batch is counted as one matrix of bounded size.
    """
    codes = _Codes(dimensions)

    @F.arrow_udf("array<struct<slot:int,q:bigint>>")
    def vectors(texts: pa.Array) -> pa.Array:
        parts = [_hashed(texts.slice(*step), codes) for step in words.steps(texts, STEP_ROWS)]
        return pa.concat_arrays(parts) if parts else _hashed(texts, codes)

    return df.select(*df.columns, F.lit(HASH_MODEL).alias("model"), tx.seal(vectors(F.lower(F.col(text)))).alias("vector"))


class RetryableError(Exception):
    """Raised by a user's model when the same batch is worth another try (timeouts, 429, 5xx)."""


def score_in_batches(
    df: DataFrame,
    model: Callable[[Sequence[str]], Sequence[Sequence[float]]],
    text: str = "content",
    batch: int = BATCH,
    retries: int = RETRIES,
    backoff: float = BACKOFF_SECONDS,
) -> DataFrame:
    """Embed with any ``texts -> vectors`` callable, in slices, retrying transient failures.

    Everything else about retries belongs to Spark: a fatal error fails the task.
    """

    def call(texts: list[str]) -> Sequence[Sequence[float]]:
        for attempt in range(retries + 1):
            try:
                vectors = model(texts)
            except RetryableError:
                if attempt == retries:
                    raise
                time.sleep(backoff * 2**attempt)
                continue
            if len(vectors) != len(texts):
                raise ValueError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
            return vectors
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame[text].tolist()
            out: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                out.extend(np.asarray(v, dtype=float) for v in call(texts[i : i + batch]))
            frame = frame.copy()
            frame["vector"] = out
            yield frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, vector array<double>")


def vector_problem(vector: Column, dimensions: int) -> Column:
    """Name of the first rule a dense vector breaks, else null."""
    bad = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return (
        F.when(vector.isNull() | (F.size(vector) == 0), "empty")
        .when(bad, "not_finite")
        .when(F.size(vector) != dimensions, "dimension")
        .when(~F.exists(vector, lambda x: x != 0), "all_zero")
    )


def validate_vectors(df: DataFrame, owner: str, vector: str, dimensions: int) -> DataFrame:
    """Verdict per owner: how many vectors, how many bad, and whether all may be published."""
    problem = vector_problem(F.col(vector), dimensions)
    return df.groupBy(owner).agg(
        F.count("*").alias("vectors"),
        F.count(problem).alias("bad_vectors"),
        F.min(problem).alias("first_problem"),
        (F.count(problem) == 0).alias("publishable"),
    )


def repeated_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors carried by several rows, by digest: hot groups are counted, never gathered."""
    digest = F.sha2(F.to_json(F.col(vector)), 256)
    return (
        df.groupBy(digest.alias("digest"))
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
        .select("digest", "copies")
    )


def vector_drift(stored: DataFrame, text: str, vector: str, tolerance: float = 1e-5) -> DataFrame:
    """``stored`` with the Euclidean ``distance`` of each stored sparse vector to that of its text embedded again.

    Both vectors meet in the row: their slots are zipped, and a slot that one of them lacks counts as zero there.
    ``drifted`` marks distances above the tolerance; a missing vector is as far as the new one is long.
    """
    fresh = hash_embed_batches(stored.withColumnRenamed(vector, "_stored"), text)
    by_slot = lambda v: F.map_from_entries(F.coalesce(v, F.array().cast("array<struct<slot:int,q:bigint>>")))
    zero = F.lit(0).cast("bigint")
    squares = F.map_zip_with(
        by_slot(F.col("_stored")), by_slot(F.col("vector")),
        lambda slot, a, b: (F.coalesce(a, zero) - F.coalesce(b, zero)) * (F.coalesce(a, zero) - F.coalesce(b, zero)),
    )
    total = F.aggregate(F.map_values(squares), zero, lambda acc, x: acc + x)
    out = fresh.withColumn("distance", F.sqrt(total.cast("double")) / F.lit(float(vx.SCALE)))
    return out.withColumn("drifted", F.col("distance") > tolerance).drop("vector").withColumnRenamed("_stored", vector)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, df, n, idf_q): idf = ln(N / (1 + df)), kept as whole ten-thousandths."""
    distinct = df.select(tx.seal(F.array_distinct(tx.tokenize(F.col(text)))).alias("_t"))
    return _document_frequencies(distinct.select(F.explode("_t").alias("token")), df)


def _document_frequencies(tokens: DataFrame, df: DataFrame) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("df"))
    return counted.withColumn("n", n.scalar()).select(
        "token", "df", "n", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"),
        F.round(F.log(F.col("n") / (F.col("df") + 1)) * IDF_SCALE).cast("bigint").alias("idf_q"),
    )


def term_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the distinct tokens of each row with their counts, from its sorted tokens."""
    ordered = df.select(key, tx.seal(F.sort_array(tx.tokenize(F.col(text)))).alias("_t"))
    runs = ordered.select("*", tx.seal(vx.run_starts(F.col("_t"))).alias("_run"))
    pair = lambda s, j: F.struct(
        F.get("_t", s).alias("token"), (F.coalesce(F.get("_run", j + 1), F.size("_t")) - s).alias("tf")
    )
    return runs.select(key, tx.seal(F.transform("_run", pair)).alias("terms"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): one row per distinct token of a row."""
    return term_pairs(df, key, text).select(key, F.explode("terms").alias("x")).select(key, "x.token", "x.tf")


def searchable_terms(df: DataFrame, key: str, text: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors of the texts, kept to the tokens of ``asked(token)``, and the vocabulary of these tokens.

    The texts are tokenized once; counts, norms and kept weights come from the written terms. A vector is
    (key, features, weights, norm2, impact): the norm counts all tokens, and ``impact``, the kept part of the squared
    norm, bounds the squared cosine of the text with any question.
    """
    terms = stored(term_pairs(df, key, text), "terms")
    tokens = terms.select(F.explode("terms.token").alias("token"))
    marks = asked.select("token").filter("token is not null").distinct().withColumn("_asked", F.lit(True))
    known = stored(_document_frequencies(tokens, terms).join(marks, "token", "left"), "vocabulary")
    w = F.col("x.tf") * F.col("idf_q")
    square = F.col("w").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)")
    weighed = (
        terms.select(key, F.explode("terms").alias("x"))
        .join(known.select(F.col("token").alias("_token"), "idf_q", "_asked"), F.col("x.token") == F.col("_token"))
        .select(key, F.when(F.col("_asked"), F.col("x.token")).alias("token"), w.alias("w"))
        .groupBy(key)
        .agg(
            F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "w"))).alias("_tw"),
            F.sum(square.cast("decimal(38,0)")).cast("double").alias("norm2"),
            F.sum(F.when(F.col("token").isNotNull(), square.cast("decimal(38,0)"))).cast("double").alias("_kept"),
        )
        .select(
            key, F.col("_tw.token").alias("features"), F.col("_tw.w").alias("weights"), "norm2",
            F.coalesce(F.when(F.col("norm2") > 0, F.col("_kept") / F.col("norm2")), F.lit(0.0)).alias("impact"),
        )
    )
    empty = terms.filter(F.coalesce(F.size("terms"), F.lit(0)) <= 0).select(
        key, F.array().cast("array<string>").alias("features"), F.array().cast("array<bigint>").alias("weights"),
        F.lit(0.0).alias("norm2"), F.lit(0.0).alias("impact"),
    )
    return weighed.unionByName(empty), known.filter("_asked").drop("_asked")


def term_weights(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, token, tf, w): tf times idf, tokens outside the vocabulary left out.

    The join carries no hint: AQE broadcasts a vocabulary that turns out small and otherwise splits
    the partition of a token that a large share of the texts contain.
    """
    return term_counts(df, key, text).join(vocab.select("token", "idf_q"), "token").select(
        key, "token", "tf", (F.col("tf") * F.col("idf_q")).alias("w")
    )


def tfidf_vectors(weights: DataFrame, key: str) -> DataFrame:
    """One sparse row per text: features, weights and exact squared norm."""
    w = F.col("w").cast("decimal(19,0)")
    return weights.groupBy(key).agg(
        F.collect_list(F.struct("token", "w")).alias("_tw"),
        F.sum((w * w).cast("decimal(38,0)")).alias("norm2"),
    ).select(
        key,
        F.transform("_tw", lambda x: x.token).alias("features"),
        F.transform("_tw", lambda x: x.w).alias("weights"),
        "norm2",
    )
