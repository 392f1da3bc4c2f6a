"""Removal of repeated byte strings by grouping texts at content-defined triggers and ordering what surrounds them.

This is not prefix-free parsing, which would need suffix arrays of a phrase dictionary and of the parse: no order of
the whole corpus is built. A rolling hash picks triggers: of every REACH consecutive places the one with the least hash,
so every string of ``length`` bytes holds its own trigger near its start, whatever surrounds it. Spark counts the
contexts that follow triggers, by a 64-bit hash: a context found once cannot lie in a repeat, and goes no further. The
places of a repeated context are put in two orders, by the bytes before the trigger and by the text after it: strings
are equal where both orders put them within long enough common prefixes. The orders compare bytes.
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

LENGTH = 400
# Bytes hashed at a place; places of which one is the trigger, as a share of the length.
GRAM = 16
REACH_SHARE = 0.36
BASE = 0x9E3779B97F4A7C15
# Records put in order together; a context with more records than HOT is counted string by string instead.
CHUNK = 60_000
HOT = 50_000


def reach_of(length: int) -> int:
    return max(1, min(int(length * REACH_SHARE), length - GRAM))


class Parse:
    """Triggers of a text: place ``at``, first start that belongs to it ``low``, last start ``high``."""

    def __init__(self, text: bytes, length: int):
        self.text, n, reach = text, len(text), reach_of(length)
        if n < length:
            self.at = self.low = self.high = np.zeros(0, np.int64)
            self.context = np.zeros(0, np.uint64)
            return
        data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        power = np.full(n + 1, np.uint64(BASE))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * power[:n], out=sums[1:])
        back = np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        gram = min(GRAM, length)
        places = n - length + reach
        value = _mixed((sums[gram : gram + places] - sums[:places]) * back[:places])
        value = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)
        for span in _doubling(reach):
            value = np.minimum(value[:-span], value[span:])
        least = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        self.at, self.low, self.high = least[new], new, np.r_[new[1:], len(least)] - 1
        tail = length - reach + 1
        self.context = _mixed((sums[self.at + tail] - sums[self.at]) * back[self.at])


def _doubling(width: int) -> list[int]:
    """Shifts whose minima combine to the minimum of ``width`` neighbours."""
    out, span = [], 1
    while 2 * span <= width:
        out.append(span)
        span *= 2
    return [*out, width - span] if width > span else out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _contexts(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(th, text) -> (th, context, times), each context of a text once, times 2 where it comes again."""
    found = []
    for text in texts_of(batch.column(1)):
        values, times = np.unique(Parse(text, length).context, return_counts=True)
        found.append((values.view(np.int64), np.minimum(times, 2).astype(np.int8)))
    rows = pa.array(np.repeat(np.arange(len(found)), [len(v) for v, _ in found]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([t for _, t in found]))],
        names=["th", "context", "times"],
    )


RECORD = "context long, th long, at long, before binary, after binary"
RUNS = "th long, first long, last long"


def _records(batch: pa.RecordBatch, length: int) -> pa.RecordBatch | None:
    """(th, text, contexts) -> what stands before and after every trigger whose context is shared.

    Records of the batch that agree in both are repeats already: all but one leave as finished runs of starts
    (``before`` null), the one that stays is joined by its own run.
    """
    tail = length - reach_of(length) + 1
    lists, out, first_of = batch.column(2), [], {}
    flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    for i, (th, text) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
        parse = Parse(text, length)
        keep = np.flatnonzero(np.isin(parse.context, flat[ends[i] : ends[i + 1]].view(np.uint64)))
        for at, low, high, context in zip(*(x[keep].tolist() for x in (parse.at, parse.low, parse.high, parse.context.view(np.int64))), strict=True):
            before, after = text[low:at], text[at + tail : min(high + length, len(text))]
            known = first_of.get((context, before, after, at - high))
            if known is None:
                first_of[context, before, after, at - high] = [context, th, at, before, after, (low, high), False]
                continue
            out.append((low, th, high, None, None))
            if not known[-1]:
                known[-1] = True
                out.append((known[5][0], known[1], known[5][1], None, None))
    rows = out + [tuple(r[:5]) for r in first_of.values()]
    if not rows:
        return None
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["context", "th", "at", "before", "after"]
    )


def _padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8)
    return flat.reshape(len(strings), width), sizes


def _suffix_order(context: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by context and bytes, length of the prefix that each shares with the one before it)."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), context))
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.minimum(shared, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    shared[context[order[1:]] != context[order[:-1]]] = -1
    return order, np.r_[-1, shared]


def repeats(context: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> np.ndarray:
    """For every record and every number e of bytes before the trigger, whether the string that starts e before it
    is found in another record too."""
    n, reach = len(before), reach_of(length)
    width = -(-reach // 8) * 8
    left, left_size = _padded([b[::-1] for b in before], width)
    right, right_size = _padded(after, width)
    left_order, left_shared = _suffix_order(context, left, left_size)
    right_order, right_shared = _suffix_order(context, right, right_size)
    out = np.zeros((n, reach), bool)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    # Starts e lie before the trigger, so length - e - (context) bytes after the context must agree as well.
    for e in range(reach):
        r = reach - 1 - e
        fits = np.flatnonzero((left_size >= e) & (right_size >= r))
        if len(fits) < 2:
            continue
        l_class[left_order] = np.cumsum(left_shared < e)
        r_class[right_order] = np.cumsum(right_shared < r)
        both = l_class[fits] * (n + 1) + r_class[fits]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        out[fits[order], e] = np.r_[False, same] | np.r_[same, False]
    return out


def _runs(th: np.ndarray, at: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated starts of every record, as (th, first, last)."""
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(th[row]), pa.array(at[row] - end + 1), pa.array(at[row] - start)], names=["th", "first", "last"]
    )


def _ordered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Records sorted by context -> runs of repeated starts; contexts are never torn apart."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        context, th, at = (np.asarray(rows.column(i).combine_chunks()) for i in range(3))
        found = repeats(context, rows.column(3).to_pylist(), rows.column(4).to_pylist(), length)
        return _runs(th, at, found)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            table = pa.Table.from_batches(held)
            context = np.asarray(table.column(0).combine_chunks())
            last = int(np.searchsorted(context, context[-1]))
            if last:
                yield solve(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
                size = table.num_rows - last
    if held:
        yield solve(pa.Table.from_batches(held))


def _strings(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Records -> (h1, h2, th, start) of every string of their starts."""
    reach, out = reach_of(length), []
    for context, th, at, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        for e in range(len(before) + 1):
            if len(after) >= reach - 1 - e:
                rest = before[len(before) - e :] + context.to_bytes(8, "little", signed=True) + after[: reach - 1 - e]
                h = xxhash.xxh3_128_intdigest(rest)
                out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), th, at - e))
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "th", "first"])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id_column, n_bytes, n_removed, n_spans, spans, kept_sha256), one row per row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it starts anywhere else too, in any
    row; every copy goes. ``spans`` lists maximal removed runs as (start, bytes). Null texts are empty, texts
    shorter than ``length`` are kept, and rows that repeat an id or a text are documents of their own. Equal texts
    (64-bit hash) are worked on once. ``hot`` is the number of records of one context from which its strings are
    counted by hash rather than ordered; results are the same.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = numbered(docs.select(F.col(id_column).alias("id"), "text"))
    hashed = rows.select(
        "doc.id", F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("th"), "row", "doc.text",
    )
    firsts = hashed.groupBy("th").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    contexts = arrow_map(hashed.select("th", "text"), lambda b: _contexts(b, length), "th long, context long, times byte")
    shared = (
        contexts.groupBy("context").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.max("times").alias("times"))
        .filter("a <> b or times > 1").select("context")
    )
    wanted = contexts.select("th", "context").join(shared, "context").groupBy("th").agg(F.collect_set("context").alias("contexts"))
    wanted = written(wanted, "contexts")
    # By the row too, so that the copies of a text do not meet in one partition.
    one = hashed.join(wanted.join(firsts, "th"), ["th", "row"])
    texts = written(one.select("th", "text", "contexts"), "texts")
    records = written(arrow_map(texts, lambda b: _records(b, length), RECORD), "records")
    done = records.filter("before is null").select("th", F.col("context").alias("first"), F.col("at").alias("last"))
    real = records.filter("before is not null")
    sizes = real.groupBy("context").count()
    crowded = written(sizes.filter(F.col("count") > hot).select("context"), "crowded")
    runs = done
    if crowded.isEmpty():
        plain = real
    else:
        plain = real.join(crowded, "context", "left_anti")
        strings = arrow_map(real.join(crowded, "context").select(*real.columns), lambda b: _strings(b, length), "h1 long, h2 long, th long, first long")
        twice = strings.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
        runs = runs.unionByName(strings.join(twice, ["h1", "h2"]).select("th", "first", F.col("first").alias("last")))
    dealt = plain.repartition("context").sortWithinPartitions("context")
    runs = runs.unionByName(dealt.mapInArrow(lambda it: _ordered(it, length), RUNS))
    runs = runs.groupBy("th").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, digests = [], []
        lists = batch.column(2)
        flat, ends = lists.values, np.asarray(lists.offsets)
        first, last = (np.asarray(flat.field(i)) for i in (0, 1))
        for i, text in enumerate(texts_of(batch.column(1))):
            part = slice(ends[i], ends[i + 1])
            steps = np.zeros(len(text) + 1, np.int64)
            np.add.at(steps, first[part], 1)
            np.add.at(steps, last[part] + length, -1)
            edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(steps)[:-1] > 0, False])).reshape(-1, 2)
            keep = np.r_[0, edges.ravel(), len(text)].reshape(-1, 2)
            digests.append(hashlib.sha256(b"".join(text[a:b] for a, b in keep)).hexdigest())
            spans.append([{"start": int(a), "bytes": int(b - a)} for a, b in edges])
        span = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(digests)], names=["th", "spans", "kept"])

    changed = arrow_map(texts.select("th", "text").join(runs, "th"), cut, "th long, spans array<struct<start: long, bytes: long>>, kept string")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    base = hashed.select("id", "th", n.alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    joined = base.join(firsts.select("th", "copies"), "th").join(changed, "th", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("bytes")))
    spans = F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: long, bytes: long>>")))
    out = joined.withColumn("spans", spans)
    return out.select(
        F.col("id").cast(kind).alias(id_column), "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["bytes"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "spans",
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
