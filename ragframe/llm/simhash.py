"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``distance`` bits of each other agree in at least one of ``distance + 1`` bit bands, so each
distinct fingerprint is dealt to one task group per band. Inside a task the groups form a forest: fingerprints
sorted by Gray rank fill leaves, a node keeps the mask and pattern of the bits that all below it share, and a pair
of nodes is dropped, with everything below it, as soon as the differences in their shared bits, added up level by
level, exceed the distance. A task returns a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_map, numbered, texts_of, written
from ragframe.llm.components import connected_components

DISTANCE = 4
SHINGLE = 4
SEED = 42
FANOUT = 16
# A band group of more fingerprints than this is dealt as pairs of tiles, so that no task holds all of it.
TILE = 20_000
CHUNK = 200_000
FRONTIER = 1 << 20


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of the ``words``-word shingles of a text; zero when it has no word."""
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(parts[i:] for i in range(words)), strict=False)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """``(id_column, fp)``: one row per row of ``docs``, null text as a text without words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts_of(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_map(docs.select(id_column, "text"), rows, f"`{id_column}` {kind}, fp long")


# ---- the index ----------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one height: shared mask and pattern, first child and number of children, and group."""

    def __init__(self, mask, pattern, group, first=None, count=None):
        self.mask, self.pattern, self.group, self.first, self.count = mask, pattern, group, first, count

    def parents(self) -> Level:
        """Runs of up to FANOUT neighbours of one group, with the bits they share factored out."""
        n = len(self.group)
        starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        inside = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        first = np.flatnonzero(inside % FANOUT == 0)
        count = np.diff(np.r_[first, n])
        base = np.repeat(self.pattern[first], count)
        mask = np.bitwise_and.reduceat(self.mask & ~(self.pattern ^ base), first)
        return Level(mask, self.pattern[first] & mask, self.group[first], first, count)


def forest(codes: np.ndarray, group: np.ndarray) -> list[Level]:
    """Levels from the codes, which are sorted by group and Gray rank, up to one root per group."""
    levels = [Level(np.full(len(codes), ~np.uint64(0)), codes, group)]
    while len(levels[-1].group) > 1 and (levels[-1].group[1:] == levels[-1].group[:-1]).any():
        levels.append(levels[-1].parents())
    return levels


def _children(level: Level, a: np.ndarray, b: np.ndarray):
    """All child pairs of node pairs, each unordered pair once; also the row of the parent pair."""
    sizes = level.count[a] * level.count[b]
    row = np.repeat(np.arange(len(a)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = level.count[b][row]
    left, right = level.first[a][row] + at // width, level.first[b][row] + at % width
    keep = (a[row] != b[row]) | (left <= right)
    return left[keep], right[keep], row[keep]


class Labels:
    """Least member of the group of linked codes that each code is in so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.of[self.of], self.of):
                self.of = self.of[self.of]


def linked(codes: np.ndarray, group: np.ndarray, distance: int) -> np.ndarray:
    """For codes sorted by (group, Gray rank): least index of the linked set that each code belongs to."""
    levels, labels = forest(codes, group), Labels(len(codes))
    roots = np.arange(len(levels[-1].group))
    work = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
    while work:
        height, a, b, seen, done = work.pop()
        if height and len(a) > 4096:
            half = len(a) // 2
            work += [(height, *(x[half:] for x in (a, b, seen, done))), (height, *(x[:half] for x in (a, b, seen, done)))]
            continue
        level = levels[height]
        shared = level.mask[a] & level.mask[b]
        total = seen + np.bitwise_count((level.pattern[a] ^ level.pattern[b]) & shared & ~done)
        near = total <= distance
        a, b, total, shared = a[near], b[near], total[near], shared[near]
        if not height:
            labels.join(a, b)
            continue
        if height == 1 and len(a):  # both leaves lie in one linked set already: nothing to learn
            first, last = level.first, level.first + level.count
            low, high = np.minimum.reduceat(labels.of, first), np.maximum.reduceat(labels.of, first)
            assert len(last) == len(low)
            news = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b, total, shared = a[news], b[news], total[news], shared[news]
        if len(a):
            left, right, row = _children(level, a, b)
            work.append((height - 1, left, right, total[row], shared[row]))
    return labels.of


def _groups(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (band key, tiles, fp) sorted by the first two -> (a, b): each fp and the first of its linked set."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
        order = np.lexsort((gray_rank(fps), group))
        codes = fps[order]
        root = codes[linked(codes, group[order], distance)]
        apart = root != codes
        return pa.RecordBatch.from_arrays(
            [pa.array(codes[apart].view(np.int64)), pa.array(root[apart].view(np.int64))], names=["a", "b"]
        )

    held_keys, held = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(i)) for i in (0, 1)])
        held_keys = np.concatenate([held_keys, keys])
        held = np.concatenate([held, np.asarray(batch.column(2)).view(np.uint64)])
        if len(held) >= CHUNK:
            last = int(np.flatnonzero((held_keys == held_keys[-1]).all(axis=1))[0])
            if last:
                yield links(held_keys[:last], held[:last])
                held_keys, held = held_keys[last:], held[last:]
    if len(held):
        yield links(held_keys, held)


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Distinct ``fps(fp)`` -> edges (a, b) whose components are those of all links of at most ``distance`` bits."""
    bands = distance + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    keys = [
        F.lit(i * 2**58).bitwiseXOR(F.shiftrightunsigned(F.shiftleft("fp", 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]))
        for i in range(bands)
    ]
    dealt = fps.select(F.explode(F.array(*keys)).alias("band"), "fp")
    sizes = dealt.groupBy("band").count().filter(F.col("count") > tile)
    tiles = F.coalesce(F.ceil(F.col("count") / tile), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (
        dealt.join(sizes, "band", "left").select("band", "fp", tiles.alias("tiles"))
        .select("band", "fp", "tiles", own.alias("own"))
        .select("band", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select("band", (F.least("own", "other") * 2**31 + F.greatest("own", "other")).cast("long").alias("tile"), "fp")
    )
    sorted_rows = tiled.repartition("band", "tile").sortWithinPartitions("band", "tile")
    return sorted_rows.mapInArrow(lambda it: _groups(it, distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """``(id_column, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the least id reachable over links of at most ``distance`` bits, ids that are null left
    out (null where a component has no other). Equal texts meet as one fingerprint. Texts that are null, empty
    or blank have fingerprint zero and link like any other. Rows that repeat an id are judged one by one.
    """
    prints = written(fingerprints(docs, id_column, words), "prints")
    nodes = prints.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = connected_components(links(nodes.select("fp"), distance))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(id_column, "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, the one of the least id (null last), columns unchanged."""
    rows = numbered(docs)
    classes = near_duplicates(rows.select("row", "doc.text"), distance, words, "row")
    ids = rows.select("row", F.col("doc")[id_column].alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = classes.join(ids, "row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")
