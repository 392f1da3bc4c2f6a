"""Removal of word passages that occur earlier: Rabin-Karp hashes of fixed-length token windows, counted in Spark.

A window's anchor is the least hash of the runs of ANCHOR words inside it. Equal windows have equal anchors at the
same offset, so a window whose anchor is found at one place is unique and goes no further. Counted over the whole
corpus are first the anchors (about one per eight words), then the hashes of all windows that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_map, numbered, texts_of, written

WINDOW = 20
ANCHOR = 6
# Windows are judged in buckets of about this many.
BUCKET_WINDOWS = 1_000_000
# Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def rolling(tokens: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every run of ``width`` 64-bit tokens."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * _powers(base, n), out=sums[1:])
    runs = (sums[width:] - sums[:-width]) * _powers(_inverse(base), n - width + 1)
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    return runs ^ (runs >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _anchor_rows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """(th, text) -> (th, anchor, times): the anchors of a text, times 2 where their words come twice in it."""
    short, found = min(ANCHOR, window), []
    for text in texts_of(batch.column(1)):
        words = text.split()
        runs = rolling(token_hashes(words), short, BASES[0]) if len(words) >= window else np.zeros(0, np.uint64)
        values = np.unique(sliding_min(runs, window - short + 1)) if len(runs) else runs
        runs.sort()
        twice = np.searchsorted(runs, values, "right") - np.searchsorted(runs, values) > 1
        found.append((values.view(np.int64), 1 + twice.astype(np.int8)))
    rows = pa.array(np.repeat(np.arange(len(found)), [len(v) for v, _ in found]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), pa.array(np.concatenate([v for v, _ in found])),
         pa.array(np.concatenate([t for _, t in found]))],
        names=["th", "anchor", "times"],
    )


# Packed windows of one bucket: hash, check bits, number of the text in the batch, start.
PACKED = np.dtype([("h", "<u8"), ("check", "<u2"), ("text", "<u2"), ("start", "<u4")])
OUT = ["bucket", "th", "place", "data"]


def _window_rows(batch: pa.RecordBatch, window: int, buckets: int) -> pa.RecordBatch | None:
    """(th, place, text, anchors) -> packed windows per bucket.

    Only the earliest of equal windows of the batch is packed; the others are later ones already, and leave as
    finished marks (``place`` null). Each packed row lists the texts it refers to.
    """
    short, out = min(ANCHOR, window), {k: [] for k in OUT}
    anchors, ths, places = batch.column(3), batch.column(0).to_pylist(), batch.column(1).to_pylist()
    flat, ends = np.asarray(anchors.values), np.asarray(anchors.offsets)
    rank = np.empty(len(places), np.int64)
    rank[sorted(range(len(places)), key=lambda i: (places[i], ths[i]))] = np.arange(len(places))
    parts = []
    for i, text in enumerate(texts_of(batch.column(2))):
        tokens = token_hashes(text.split())
        least = sliding_min(rolling(tokens, short, BASES[0]), window - short + 1)
        at = np.flatnonzero(np.isin(least, flat[ends[i] : ends[i + 1]].view(np.uint64)))
        part = np.empty(len(at), PACKED)
        part["h"], part["check"] = rolling(tokens, window, BASES[0])[at], rolling(tokens, window, BASES[1])[at] >> np.uint64(48)
        part["text"], part["start"] = i, at
        parts.append(part)
    rows = np.concatenate(parts) if parts else np.zeros(0, PACKED)
    if not len(rows):
        return None
    rows = rows[np.lexsort((rows["start"], rank[rows["text"]], rows["check"], rows["h"]))]
    first = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["check"][1:] != rows["check"][:-1])]
    for i, starts in _by_text(rows[~first]):
        out["bucket"].append(int(ths[i] % buckets))
        out["th"].append([ths[i]])
        out["place"].append(None)
        out["data"].append(starts)
    rows = rows[first]
    of = (rows["h"] >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    rows, of = rows[order], of[order]
    for chunk in np.split(rows, np.flatnonzero(of[1:] != of[:-1]) + 1):
        texts, chunk["text"] = np.unique(chunk["text"], return_inverse=True)
        out["bucket"].append(int((int(chunk["h"][0]) >> 32) % buckets))
        out["th"].append([ths[i] for i in texts])
        out["place"].append([places[i] for i in texts])
        out["data"].append(chunk.tobytes())
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(batch.schema.field(1).type), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(OUT, kinds, strict=True)], names=OUT)


def _by_text(rows: np.ndarray):
    """(text, packed starts) of packed windows."""
    rows = rows[np.argsort(rows["text"], kind="stable")]
    for chunk in np.split(rows, np.flatnonzero(rows["text"][1:] != rows["text"][:-1]) + 1):
        if len(chunk):
            yield int(chunk["text"][0]), chunk["start"].astype("<u4").tobytes()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket -> (th, starts): windows whose words start in an earlier place."""

    def judge(ths: list, places: list, data: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in ths])
        flat_th = [t for part in ths for t in part]
        flat_place = [p for part in places for p in part]
        rank = np.empty(len(flat_th), np.int64)
        order = sorted(range(len(flat_th)), key=lambda i: (flat_place[i], flat_th[i]))
        rank[order] = np.arange(len(flat_th))
        rows = np.concatenate([np.frombuffer(d, PACKED) for d in data])
        text = np.repeat(np.cumsum(sizes) - sizes, [len(d) // PACKED.itemsize for d in data]) + rows["text"]
        order = np.lexsort((rows["start"], rank[text], rows["check"], rows["h"]))
        h, check, th = rows["h"][order], rows["check"][order], np.array(flat_th, np.int64)[text[order]]
        again = np.flatnonzero(np.r_[False, (h[1:] == h[:-1]) & (check[1:] == check[:-1])])
        th, start = th[again], rows["start"][order][again]
        order = np.argsort(th, kind="stable")
        th, start = th[order], start[order]
        heads = np.flatnonzero(np.r_[True, th[1:] != th[:-1]]) if len(th) else np.zeros(0, np.int64)
        cut = [s.astype("<u4").tobytes() for s in np.split(start, heads[1:])] if len(th) else []
        return pa.RecordBatch.from_arrays([pa.array(th[heads]), pa.array(cut, pa.binary())], names=["th", "starts"])

    bucket, held = None, ([], [], [])
    for batch in batches:
        for b, th, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place is None:
                yield pa.RecordBatch.from_arrays([pa.array(th), pa.array([data], pa.binary())], names=["th", "starts"])
                continue
            if b != bucket and held[0]:
                yield judge(*held)
                held = ([], [], [])
            bucket = b
            for kept, value in zip(held, (th, place, data), strict=True):
                kept.append(value)
    if held[0]:
        yield judge(*held)


def _cut(text: bytes, marks: list[bytes], window: int) -> tuple[np.ndarray, bytes]:
    """(first word and end of each removed run, what is left) of a text."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for m in marks:
        at = np.frombuffer(m, "<u4").astype(np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    covered = np.cumsum(gone)[:-1] > 0
    runs = np.flatnonzero(np.diff(np.r_[False, covered, False])).reshape(-1, 2)
    return runs, b" ".join([w for w, c in zip(words, covered, strict=True) if not c])


RESULT = "n_words long, n_removed long, spans array<struct<first: long, words: long>>, kept_sha256 string"


def _result(runs: list[np.ndarray], words: list[int], digests: list[str]) -> list[pa.Array]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    return [
        pa.array(words, pa.int64()),
        pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
        pa.array([[{"first": int(a), "words": int(b - a)} for a, b in r] for r in runs], span),
        pa.array(digests, pa.string()),
    ]


def passages(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """(id_column, n_words, n_removed, spans, kept_sha256), one row per row of ``docs``.

    A word goes if a window of ``window`` consecutive words covers it whose words also start earlier: in a row
    with a smaller id (null first), or earlier in the same row. ``spans`` lists maximal removed runs as (first
    word, number of words), ``kept_sha256`` digests the words left, joined by one space. Null and blank texts
    have no words; texts shorter than the window are kept. Of rows with one id and different texts, one comes
    first in an unspecified but fixed order; rows equal in id and text are one document with one result.

    Equal texts (64-bit hash) are worked on once: all but the first are windows that start earlier. Windows are
    told apart by 80 bits of two rolling hashes.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = numbered(docs.select(F.col(id_column).alias("id"), "text"))
    hashed = rows.select(
        "doc.id", F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("th"), "row", "doc.text",
    )
    place = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), F.col("row").alias("row"))
    firsts = hashed.select("th", place.alias("place")).groupBy("th").agg(F.min("place").alias("place"))

    anchors = arrow_map(hashed.select("th", "text"), lambda b: _anchor_rows(b, window), "th long, anchor long, times byte")
    repeated = (
        anchors.groupBy("anchor").agg(F.min("th").alias("low"), F.max("th").alias("high"), F.max("times").alias("times"))
        .filter("low <> high or times > 1").select("anchor")
    )
    wanted = written(
        anchors.select("th", "anchor").join(repeated, "anchor").groupBy("th").agg(F.collect_set("anchor").alias("anchors")),
        "anchors",
    )
    total = wanted.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    buckets = max(16, total * (window - ANCHOR) // BUCKET_WINDOWS)
    # By the row too, so that the copies of a text do not meet in one partition.
    one = hashed.join(wanted.join(firsts, "th").withColumn("row", F.col("place.row")), ["th", "row"])
    texts = written(one.select("th", F.col("place.id").alias("id"), "text", "anchors"), "texts")

    order = F.coalesce(F.col("id").cast("string"), F.lit("")) if kind == "string" else F.coalesce("id", F.lit(-(2**63)))
    packed = arrow_map(
        texts.select("th", order.alias("place"), "text", "anchors"), lambda b: _window_rows(b, window, buckets),
        f"bucket long, th array<long>, place array<{'string' if kind == 'string' else 'long'}>, data binary",
    )
    marks = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_later, "th long, starts binary")
    marks = marks.groupBy("th").agg(F.collect_list("starts").alias("starts"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, words, digests = [], [], []
        for text, m in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            r, kept = _cut(text, m, window)
            runs.append(r)
            words.append(len(text.split()))
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *_result(runs, words, digests)], names=["th", "n_words", "n_removed", "spans", "kept_sha256"]
        )

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [t.split() for t in texts_of(batch.column(2))]
        digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in parts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(w) for w in parts], pa.int64()), pa.array(digests)],
            names=["id", "th", "n", "sha"],
        )

    changed = arrow_map(texts.select("th", "text").join(marks, "th"), cut, f"th long, {RESULT}")
    base = arrow_map(hashed.select("id", "th", "text"), whole, f"id {kind}, th long, n long, sha string")
    joined = base.join(firsts, "th").join(changed, "th", "left")
    copy = ~F.col("id").eqNullSafe(F.col("place.id")) & (F.col("n") >= window)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("words")))
    none = F.array().cast("array<struct<first: long, words: long>>")
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, all_words).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
