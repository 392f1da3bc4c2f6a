"""Line deduplication by an exact set-similarity join.

A line is the set of its words, A-Z lower-cased. Words are put in order of rarity; two sets of Jaccard similarity
``similarity`` or more share a word among the first n - ceil(similarity * n) + 1 of each. Lines meet at those words,
and pairs are dropped by their lengths, by the places of the shared word, and by a bitmap that bounds their
difference from below (of 64 bits, and of 256 where both lines have more than WIDE words, since those fill 64),
before the sets themselves are compared. A line goes if an earlier line is equal or similar.

Equal sets are one class, so that repeated lines never pair up. At a word, each class is paired with the earliest
class that passes the filters; only classes whose earliest candidates prove unlike meet all the others. A word of many
classes is dealt in parts, and a class there that finds nothing like it in its own part meets the other parts as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import seal
from ragframe.llm.common import arrow_map, dropped, numbered, stored, texts_of, written

SIMILARITY = 0.8
# Words are counted in this many hashed slots: any order makes the join exact, a rarer-first order makes it fast.
SLOTS = 1 << 18
# Packed entries per bucket, about.
BUCKET_ENTRIES = 500_000
# Prefix entries of one word in one task, about; words of more are dealt in parts by class.
WORD_ENTRIES = 500_000
# Candidates tried per word and class before a class meets all others.
TRIES = 8
# Classes and words of at most this many rows are broadcast to find what is left.
FEW = 200_000
BLOCK = 512
# Lines of more words have a bitmap of 256 bits.
WIDE = 64
# Words of at most this many classes are paired without a loop, about PAIRS pairs at a time; others by ROWS and BLOCK.
SMALL = 24
PAIRS = 1 << 18
ROWS = 1024
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[by]
    return h ^ (h >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_by_line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each word, counted over all texts; 64-bit hash of each word; lines of each text, 0 if empty)."""
    texts = [t for t in texts if t] if not all(texts) else texts
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] |= 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    breaks = np.flatnonzero(data == 10)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE))]
    word = (sums[ends] - sums[starts]) * _powers(len(data), pow(_BASE, -1, 1 << 64))[starts]
    return np.searchsorted(breaks, starts), _mixed(word, 0), breaks


def _line_counts(texts: list[bytes]) -> np.ndarray:
    return np.array([t.count(b"\n") + 1 if t else 0 for t in texts], np.int64)


def _word_hashes(texts: list[bytes]) -> np.ndarray:
    return words_by_line(texts)[1]


def rarity(docs: DataFrame, hashes: Callable[[list[bytes]], np.ndarray] = _word_hashes) -> np.ndarray:
    """Occurrences of words, or of other ``hashes``, by slot over all of ``docs``: SLOTS numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            if any(texts):
                total += np.bincount((hashes(texts) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        parts = total.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array([p.tobytes() for p in parts])], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()])], names=["part", "counts"])

    schema = "part long, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()  # 2 MB
    out = np.zeros((64, SLOTS // 64), np.int64)
    for part, counts in rows:
        out[part] = np.frombuffer(counts, np.int64)
    return out.ravel()


class LineSets:
    """The word sets of a batch's lines, rarest word first: words flat, with first word and size per line."""

    def __init__(self, texts: list[bytes], rare: np.ndarray | None):
        counts = _line_counts(texts)
        line, word, _ = words_by_line(texts) if any(texts) else (np.zeros(0, np.int64), np.zeros(0, np.uint64), None)
        seen = rare[(word & np.uint64(SLOTS - 1)).astype(np.int64)] if rare is not None else np.zeros(len(word))
        order = np.argsort(word) if rare is None else np.lexsort((word, seen))
        order = order[np.argsort(line[order].astype(np.uint16 if len(counts) and counts.sum() < 1 << 16 else np.int64), kind="stable")]
        line, word = line[order], word[order]
        new = np.r_[True, (line[1:] != line[:-1]) | (word[1:] != word[:-1])][: len(word)]
        self.word, line = word[new], line[new]
        self.first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
        self.size = np.diff(np.r_[self.first, len(line)])
        all_lines = line[self.first]
        ends = np.cumsum(counts)
        self.doc = np.searchsorted(ends, all_lines, "right")
        self.number = all_lines - (ends - counts)[self.doc]
        if len(self.first):
            self.key = np.add.reduceat(_mixed(self.word, 1), self.first)
            self.check = np.bitwise_xor.reduceat(_mixed(self.word, 2), self.first)
            bits = np.uint64(1) << (self.word >> np.uint64(58))
            self.bitmap = np.bitwise_xor.reduceat(bits, self.first)
            # Quarters of the bitmap, the first of which is what the others leave of its 64 bits.
            quarter = (self.word >> np.uint64(56)) & np.uint64(3)
            self.quarters = [
                np.where(self.size > WIDE, np.bitwise_xor.reduceat(np.where(quarter == q, bits, np.uint64(0)), self.first), np.uint64(0))
                for q in (1, 2, 3)
            ]
        else:
            self.key = self.check = self.bitmap = np.zeros(0, np.uint64)
            self.quarters = [self.bitmap] * 3


def shared_least(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Common words that sets of n and m need: J >= s iff common >= s / (1 + s) * (n + m)."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


ENTRY = ("token", "<u4"), ("key", "<u8"), ("bitmap", "<u8"), ("n", "<u4"), ("at", "<u4"), ("id", "<i8"), ("line", "<u4"), *((f"w{q}", "<u8") for q in (1, 2, 3))
ENTRY_BYTES = sum(np.dtype(kind).itemsize for _, kind in ENTRY)


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    raw = b"".join(columns[name].astype(kind).tobytes() for name, kind in ENTRY)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int) -> dict[str, np.ndarray]:
    raw = pa.decompress(data, decompressed_size=ENTRY_BYTES * rows, codec="zstd", asbytes=True)
    out, at = {}, 0
    for name, kind in ENTRY:
        out[name] = np.frombuffer(raw, kind, rows, at)
        at += out[name].nbytes
    return out


def _prefix_words(texts: list[bytes], rare: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix words of the batch's classes, as ``_entries`` deals them."""
    sets = LineSets(texts, rare)
    keep = np.unique(sets.key, return_index=True)[1]
    n = sets.size[keep]
    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    rows = np.repeat(np.arange(len(keep)), prefix)
    return sets.word[sets.first[keep][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(prefix) - prefix, prefix)]


def word_parts(docs: DataFrame, rare: np.ndarray, similarity: float) -> np.ndarray:
    """By slot of the word: in how many parts its prefix entries are dealt."""
    if rare.max() <= WORD_ENTRIES:  # a word has no more entries than occurrences
        return np.ones(SLOTS, np.int64)
    held = docs.sparkSession.sparkContext.broadcast(rare)  # SLOTS numbers
    counts = rarity(docs, lambda texts: _prefix_words(texts, held.value, similarity))
    return np.maximum(1, -(-counts // WORD_ENTRIES))


def _entries(
    batch: pa.RecordBatch, rare: np.ndarray, buckets: int, parts: np.ndarray, only: np.ndarray | None, similarity: float
) -> pa.RecordBatch | None:
    """(id, text) -> per bucket, the packed prefix entries of the batch's earliest line of every class.

    With ``only``, entries of these tokens. Parts of divided words have the buckets from ``buckets`` on, one each.
    """
    sets = LineSets(texts_of(batch.column(1)), rare)
    if not len(sets.first):
        return None
    ids = np.asarray(batch.column(0).fill_null(-(2**63)))[sets.doc]
    order = np.lexsort((sets.number, ids, sets.key))
    keep = order[np.r_[True, sets.key[order][1:] != sets.key[order][:-1]]]
    n = sets.size[keep]
    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    rows = np.repeat(np.arange(len(keep)), prefix)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = sets.word[sets.first[keep][rows] + at]
    if only is not None:
        asked = np.isin(word & np.uint64(0xFFFFFFFF), only)
        rows, at, word = rows[asked], at[asked], word[asked]
        if not len(rows):
            return None
    of = ((word >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    slot = (word & np.uint64(SLOTS - 1)).astype(np.int64)
    split = parts[slot] > 1
    own = (sets.key[keep][rows][split] % parts[slot[split]].astype(np.uint64)).astype(np.int64)
    extra = np.where(parts > 1, parts, 0)
    of[split] = buckets + (np.cumsum(extra) - extra)[slot[split]] + own
    cut = np.argsort(of, kind="stable")
    columns = {
        "token": (word & np.uint64(0xFFFFFFFF))[cut], "key": sets.key[keep][rows][cut], "bitmap": sets.bitmap[keep][rows][cut],
        "n": n[rows][cut], "at": at[cut], "id": ids[keep][rows][cut], "line": sets.number[keep][rows][cut],
        **{f"w{q}": w[keep][rows][cut] for q, w in enumerate(sets.quarters, 1)},
    }
    of = of[cut]
    heads = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
    data = [_pack({k: v[a:b] for k, v in columns.items()}) for a, b in zip(heads[:-1], heads[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(of[heads[:-1]]), pa.array(np.diff(heads)), pa.array(data, pa.binary())], names=["bucket", "rows", "data"]
    )


def _merged(data: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """Entries of a bucket sorted by (token, id, line, key), the earliest of each class at each token."""
    parts = [_unpack(d, n) for n, d in data]
    e = {name: np.concatenate([p[name] for p in parts]) for name, _ in ENTRY}
    order = np.lexsort((e["line"], e["id"], e["key"], e["token"]))
    again = (e["token"][order][1:] == e["token"][order][:-1]) & (e["key"][order][1:] == e["key"][order][:-1])
    order = order[np.r_[True, ~again]]
    order = order[np.lexsort((e["key"][order], e["line"][order], e["id"][order], e["token"][order]))]
    return {name: v[order] for name, v in e.items()}


def _passes(e: dict, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether entries a and b of one token can be similar: lengths, places of the token, bitmaps."""
    n, m = e["n"][a].astype(np.int64), e["n"][b].astype(np.int64)
    least = shared_least(n, m, similarity)
    fits = (least <= np.minimum(n, m)) & (1 + np.minimum(n - e["at"][a], m - e["at"][b]) - 1 >= least)
    most = n + m - 2 * least
    fits &= np.bitwise_count(e["bitmap"][a] ^ e["bitmap"][b]) <= most
    wide = np.flatnonzero(fits & (n > WIDE) & (m > WIDE))
    if len(wide):
        x, y = a[wide], b[wide]
        first = e["bitmap"][x] ^ e["bitmap"][y]
        differ = np.zeros(len(wide), np.int64)
        for name in ("w1", "w2", "w3"):
            part = e[name][x] ^ e[name][y]
            first ^= part
            differ += np.bitwise_count(part)
        fits[wide] = differ + np.bitwise_count(first) <= most[wide]
    return fits


def earliest(e: dict[str, np.ndarray], similarity: float, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, earlier entry, whether more could follow): up to ``tries`` earliest candidates of every entry."""
    token = e["token"]
    heads = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)]), len(token)]
    left, right, more = [], [], []
    sizes = np.diff(heads)
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    pairs = np.cumsum(sizes[small] * (sizes[small] - 1) // 2)
    for own in np.split(small, np.searchsorted(pairs, np.arange(PAIRS, pairs[-1] if len(pairs) else 0, PAIRS))):  # the many words of few lines
        start = np.repeat(heads[:-1][own], sizes[own])
        place = np.arange(len(start)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        x = np.repeat(start + place, place)
        y = np.repeat(start, place) + np.arange(len(x)) - np.repeat(np.cumsum(place) - place, place)
        ok = _passes(e, x, y, similarity)
        x, y = x[ok], y[ok]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        pick = rank <= tries
        left.append(x[pick])
        right.append(y[pick])
        more.append(rank[pick] == tries)
    for a, b in zip(heads[:-1][sizes > SMALL], heads[1:][sizes > SMALL], strict=True):
        open_rows, found = np.arange(a + 1, b), np.zeros(b - a, np.int64)
        for start in range(a, b - 1, BLOCK):
            open_rows = open_rows[open_rows > start]
            if not len(open_rows):
                break
            columns = np.arange(start, min(start + BLOCK, b - 1))
            for at in range(0, len(open_rows), ROWS):
                rows = open_rows[at : at + ROWS]
                x = np.repeat(rows, len(columns))
                y = np.tile(columns, len(rows))
                earlier = y < x
                ok = np.zeros(len(x), bool)
                ok[earlier] = _passes(e, x[earlier], y[earlier], similarity)
                grid = ok.reshape(len(rows), len(columns))
                rank = np.cumsum(grid, axis=1) + found[rows - a][:, None]
                pick = grid & (rank <= tries + 1)
                r, c = np.nonzero(pick)
                left.append(rows[r])
                right.append(columns[c])
                more.append(rank[r, c] > tries)
                found[rows - a] = np.minimum(rank[:, -1], tries + 1)
            open_rows = open_rows[found[open_rows - a] <= tries]
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    return np.concatenate(left), np.concatenate(right), np.concatenate(more)


def _by_bucket(batches: Iterator[pa.RecordBatch]):
    bucket, held = None, []
    for batch in batches:
        for b, rows, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield bucket, _merged(held)
                held = []
            bucket = b
            held.append((rows, data))
    if held:
        yield bucket, _merged(held)


PAIR = "a long, a_id long, a_line int, b long, b_id long, b_line int, more boolean"


def _pairs(batches: Iterator[pa.RecordBatch], similarity: float, tries: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Candidates; in a part of a divided word every class has more, and one without candidates comes with a null ``b``."""
    for bucket, e in _by_bucket(batches):
        side = lambda i: [pa.array(e["key"][i].view(np.int64)), pa.array(e["id"][i]), pa.array(e["line"][i].astype(np.int32))]  # noqa: E731, B023
        x, y, more = earliest(e, similarity, tries)
        if bucket >= buckets:
            more = np.ones(len(x), bool)
            alone = np.setdiff1d(np.arange(len(e["key"])), x)
            none = [pa.nulls(len(alone), t) for t in (pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*side(alone), *none, pa.array(np.ones(len(alone), bool))], names=["a", "a_id", "a_line", "b", "b_id", "b_line", "more"]
            )
        if len(x):
            yield pa.RecordBatch.from_arrays(
                [*side(x), *side(y), pa.array(more)], names=["a", "a_id", "a_line", "b", "b_id", "b_line", "more"]
            )


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            e = _unpack(data, rows)
            columns = [e["token"].astype(np.int64), e["key"].view(np.int64), e["bitmap"].view(np.int64), e["n"].astype(np.int32),
                       e["at"].astype(np.int32), e["id"], e["line"].astype(np.int32), *(e[f"w{q}"].view(np.int64) for q in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[name for name, _ in ENTRY])


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id") -> DataFrame:
    """(row, id_column, n_lines, removed) per row of ``docs``; ``removed`` lists line numbers from 0, ascending.

    ``row`` tells the rows of one result apart; another scan of ``docs`` may number them otherwise. Lines are what stands between line feeds. A line
    with a word goes if a line with a smaller (id, line number) has the same word set, or one whose Jaccard
    similarity is ``similarity`` or more; what that line's own fate is does not matter. Null ids count as smallest.
    Of rows that repeat an id, equal lines at one number keep one, and ties of similar lines go by hash. Null and
    empty texts have no lines; lines without a word stay. ``id_column`` is a whole number.
    """
    return _removed(numbered(docs.select(id_column, "text")), similarity, id_column)


def _removed(numbers: DataFrame, similarity: float, id_column: str) -> DataFrame:
    """``removed_lines`` of ``numbers(row, doc)``, a written table that every job reads."""
    rows = numbers.select("row", F.col("doc")[id_column].cast("long").alias("id"), F.col("doc.text").alias("text"))
    rare = rarity(rows)
    buckets = max(16, int(rare.sum()) // 5 // BUCKET_ENTRIES)
    spark, tries = rows.sparkSession, TRIES
    held = spark.sparkContext.broadcast(rare)  # SLOTS numbers

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = LineSets(texts_of(batch.column(2)), None)
        doc = pa.array(sets.doc)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(sets.number.astype(np.int32)),
             pa.array(sets.key.view(np.int64)), pa.array(sets.check.view(np.int64))],
            names=["row", "id", "line", "key", "check"],
        )

    lines = written(arrow_map(rows, keys, "row long, id long, line int, key long, check long"), "lines")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "line", "row")
    firsts = lines.groupBy("key", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = lines.join(firsts.select("key", "check", "first"), ["key", "check"]).filter(place != F.col("first")).select("row", "line")

    parts = word_parts(rows, rare, similarity)
    packed = _packed(rows, held, buckets, parts, similarity)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(lambda it: _pairs(it, similarity, tries, buckets), PAIR)
    found, *spent = stored(found.groupBy(*(c for c in found.columns if c != "more")).agg(F.max("more").alias("more")), "pairs")
    tried, alone = found.filter("b is not null"), found.filter("b is null").select("a", "a_id", "a_line")
    sets, path = _sets(rows, tried)
    spent.append(path)
    # Most lines are like the earliest line that they meet; the others are compared with the rest of theirs.
    nearest = tried.groupBy("a").agg(F.min(F.struct("b_id", "b_line", "b")).alias("e")).select("a", "e.b")
    alike = written(_similar(nearest, sets, similarity), "alike")
    rest, path = stored(tried.join(alike, "a", "left_anti"), "rest")
    spent.append(path)
    alike = alike.unionByName(written(_similar(rest.select("a", "b"), sets, similarity), "alike"))
    unsure = rest.filter("more").select("a", "a_id", "a_line").unionByName(alone).distinct()
    stubborn = written(unsure.join(alike, "a", "left_anti"), "stubborn")
    if not stubborn.isEmpty():
        deal = lambda texts, only=None: _packed(texts, held, buckets, parts, similarity, only)
        pairs, path = stored(_meet_all(rows, deal, stubborn, parts, similarity), "met")
        sets, more = _sets(rows, pairs)
        spent += [path, more]
        alike = alike.unionByName(written(_similar(pairs.select("a", "b"), sets, similarity), "alike"))
    for path in spent:  # what is alike is written, so nothing reads these again
        dropped(spark, path)
    similar = alike.distinct().join(lines.select(F.col("key").alias("a"), "row", "line"), "a").select("row", "line")
    marks = equal.unionByName(similar).groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    counted = rows.select(
        "row", F.col("id").alias(id_column),
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
    )
    return counted.join(marks, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def _packed(
    rows: DataFrame, rare: Broadcast, buckets: int, parts: np.ndarray, similarity: float, only: np.ndarray | None = None
) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((parts, only))  # SLOTS numbers, FEW at most
    return arrow_map(
        rows.select("id", "text"), lambda b: _entries(b, rare.value, buckets, *held.value, similarity), "bucket long, rows long, data binary"
    )


def _meet_all(
    rows: DataFrame, deal: Callable[..., DataFrame], stubborn: DataFrame, parts: np.ndarray, similarity: float
) -> DataFrame:
    """Every pair of a stubborn class and an earlier class that passes the filters; ``deal`` packs entries of texts."""
    fields = "token long, key long, bitmap long, n int, at int, id long, line int, w1 long, w2 long, w3 long"
    # The class's first line asks: its other lines are later than others that are like it.
    ids = stubborn.select(F.col("a_id").alias("known")).distinct()
    own = rows.join(_hinted(ids), F.coalesce("id", F.lit(-(2**63))) == F.col("known"), "left_semi")
    keys = stubborn.select(F.col("a").alias("key"), F.col("a_id").alias("id"), F.col("a_line").alias("line"))
    asked = written(deal(own).mapInArrow(_unfolded, fields).join(_hinted(keys), ["key", "id", "line"]).distinct(), "asked")
    tokens = written(asked.select("token").distinct(), "tokens")
    if tokens.count() <= FEW:
        only = np.array([t for (t,) in tokens.collect()], np.uint64)
        entries = deal(rows, only).mapInArrow(_unfolded, fields)
    else:
        entries = deal(rows).mapInArrow(_unfolded, fields).join(tokens, "token", "left_semi")
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c, _ in ENTRY if c != "token"]
    # A divided word's entries are dealt by class here too; those that ask go to all of its parts.
    split = rows.sparkSession.createDataFrame(
        [(int(s), int(parts[s])) for s in np.flatnonzero(parts > 1)], "slot long, parts long"
    )  # no more rows than entries / WORD_ENTRIES
    dealt = lambda df: df.withColumn("slot", F.col("token").bitwiseAND(SLOTS - 1)).join(F.broadcast(split), "slot", "left")
    n = F.coalesce("parts", F.lit(1))
    x = dealt(asked).select("token", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"), *named("a"))
    y = dealt(entries).select("token", F.pmod("key", n).alias("part"), *named("b"))
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    most = F.col("a_n") + F.col("b_n") - 2 * least
    differ = lambda name: F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}"))
    first = differ("bitmap").bitwiseXOR(differ("w1")).bitwiseXOR(differ("w2")).bitwiseXOR(differ("w3"))
    all_bits = F.bit_count(first) + F.bit_count(differ("w1")) + F.bit_count(differ("w2")) + F.bit_count(differ("w3"))
    fits = (
        (least <= F.least("a_n", "b_n"))
        & (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= least)
        & (F.bit_count(differ("bitmap")) <= most)
        & ((F.least("a_n", "b_n") <= WIDE) | (all_bits <= most))
        & (F.struct("b_id", "b_line", "b_key") < F.struct("a_id", "a_line", "a_key"))
    )
    return x.join(y, ["token", "part"]).filter(fits).select(
        F.col("a_key").alias("a"), "a_id", "a_line", F.col("b_key").alias("b"), "b_id", "b_line"
    ).distinct()


def _hinted(rows: DataFrame) -> DataFrame:
    """Written rows, broadcast only where their number proves them small."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _sets(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """(key, words) of the classes in ``pairs``, taken from the texts, and the folder they are in."""
    ends = pairs.select("a_id", "a_line", "a").unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("b_line").alias("a_line"), F.col("b").alias("a")))
    wanted = ends.distinct().groupBy("a_id").agg(F.collect_set("a_line").alias("lines"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = LineSets(texts_of(batch.column(0)), None)
        member = [set(x) for x in batch.column(1).to_pylist()]
        asked = np.array([int(n) in member[d] for d, n in zip(found.doc, found.number, strict=True)], bool)
        at = np.flatnonzero(asked)
        lengths = found.size[at]
        index = np.repeat(found.first[at], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        words = found.word[index].view(np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(found.key[at].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(words))], names=["key", "words"]
        )

    known = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("a_id"), "text").join(wanted, "a_id").select("text", "lines")
    return stored(arrow_map(known, sets, "key long, words array<long>").dropDuplicates(["key"]), "sets")


def _similar(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The classes ``a`` of the pairs whose word sets are similar."""
    joined = (
        pairs.join(words.select(F.col("key").alias("a"), F.col("words").alias("x")), "a")
        .join(words.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    )
    common = F.size(F.array_intersect("x", "y"))
    return joined.filter(common >= F.ceil(F.lit(similarity / (1 + similarity)) * (F.size("x") + F.size("y")) - 1e-9)).select("a").distinct()


def drop_lines(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id") -> DataFrame:
    """``docs`` without the removed lines, columns unchanged; documents that lose every line with a word go."""
    rows = numbered(docs)
    marks = _removed(rows, similarity, id_column).filter(F.size("removed") > 0).select("row", "removed")
    # Sealed, since a lambda or a filter would otherwise split the text again for every line.
    joined = rows.join(marks, "row", "left")
    parts = seal(F.when(F.col("removed").isNotNull(), F.split("doc.text", "\n", -1)))
    split = joined.select("removed", "doc", parts.alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get("parts", i)), "\n")
    fresh = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(kept)
    cut = split.select("removed", "doc", seal(fresh).alias("fresh"))
    cut = cut.filter(F.col("removed").isNull() | F.col("fresh").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(F.col("doc").withField("text", F.col("fresh")).alias("doc")).select("doc.*")
