"""Near-duplicate documents by b-bit MinHash.

A document is the set of its word shingles. MINIMA hash functions give its minima; runs of ROWS of them, in whole, are
its bands, and documents that share a band are candidates. Of every minimum only the low BITS bits are retained, packed
as bit planes: two signatures agree at as many places as their planes differ nowhere, and since unlike minima agree by
chance once in 2^BITS, similarity is estimated as (agreement - chance) / (1 - chance). Candidates whose agreement a pair
of the least similarity would almost never fall short of are verified on the whole sets.

Equal sets are one class from the start. In a bucket the first class, the one of the least id, meets all others. Classes
that this leaves in different components are clustered by their candidate pairs, of which a task returns a forest, and
each cluster's texts meet once, in tiles, where candidates are compared until they are known to be linked or not. So
a group of copies costs as much as it has members, rows never grow with its pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import arrow_map, numbered, texts_of, written
from ragframe.llm.components import connected_components
from ragframe.llm.shingles import shingle_hashes
from ragframe.llm.simhash import Labels

SHINGLE = 5
PERCENT = 85
MINIMA = 128
BITS = 2
ROWS = 4
# A pair of similarity 0.85 shares none of 24 bands of 4 minima with probability 2e-8.
BANDS = 24
# Odds that a pair of the least similarity agrees at fewer places than are asked for.
MISS = 1e-8
# Members and shingles of a tile (a task compares two), and pairs verified against one copy of a document.
TILE = 4_000
TILE_SHINGLES = 1_000_000
SALT = 1_000
# Documents looked up by a broadcast list of at most this many row numbers.
FEW = 500_000
_WORDS = MINIMA // 64
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)
_MASKS = _random.integers(0, 2**64, MINIMA, dtype=np.uint64)


def least_agreement(percent: int = PERCENT, minima: int = MINIMA, bits: int = BITS) -> int:
    """Places at which signatures of sets of that similarity agree, but for MISS of them."""
    chance = 2.0**-bits
    p, below = chance + (1 - chance) * percent / 100, 0.0
    for k in range(minima + 1):
        below += comb(minima, k) * p**k * (1 - p) ** (minima - k)
        if below > MISS:
            return k
    return minima


def similarity(agreement: np.ndarray, minima: int = MINIMA, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of signatures that agree at so many places."""
    chance = 2.0**-bits
    return (agreement / minima - chance) / (1 - chance)


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


class Sets:
    """Distinct shingles of each text, ascending: hashes flat, with first hash and size per text."""

    def __init__(self, texts: list[bytes], words: int):
        of, h = shingle_hashes(texts, words)
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (h[1:] != h[:-1])][: len(h)]
        self.hash, of = h[new], of[new]
        self.size = np.bincount(of, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size

    def sums(self, factor: int) -> np.ndarray:
        total = np.r_[np.uint64(0), np.cumsum(_mixed(self.hash, factor))]
        return total[self.first + self.size] - total[self.first]

    def minima(self) -> np.ndarray:
        """Least value of every hash function over each set that has a shingle."""
        full = np.flatnonzero(self.size)
        out = np.empty((len(full), MINIMA), np.uint64)
        for at in range(0, len(full), 64):  # few sets at a time stay in the processor's cache
            some = full[at : at + 64]
            h = self.hash[self.first[some[0]] : self.first[some[-1]] + self.size[some[-1]]]
            heads = self.first[some] - self.first[some[0]]
            for j in range(MINIMA):
                out[at : at + len(some), j] = np.minimum.reduceat((h ^ _MASKS[j]) * _FACTORS[j], heads)
        return out


def signatures(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima as BITS planes of MINIMA bits: words of 64 bits, plane by plane."""
    low = minima ^ (minima >> np.uint64(32))  # a factor leaves the last bits of a product to the last bits of its number
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(BITS)]
    return np.column_stack(planes) if len(minima) else np.zeros((0, BITS * _WORDS), np.uint64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places at which signatures agree; the last axis holds their words."""
    differ = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1] + (_WORDS,), np.uint64)
    for plane in range(BITS):
        words = slice(plane * _WORDS, (plane + 1) * _WORDS)
        differ |= a[..., words] ^ b[..., words]
    return MINIMA - np.bitwise_count(differ).sum(-1, dtype=np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    h = np.zeros((len(minima), BANDS), np.uint64)
    grouped = minima[:, : BANDS * ROWS].reshape(len(minima), BANDS, ROWS)
    for i in range(ROWS):
        h = _mixed(h + grouped[:, :, i], 0x9E3779B97F4A7C15)
    return _mixed(h + np.arange(BANDS, dtype=np.uint64)[None, :], 0xD6E8FEB86659FD93)


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """``rows(row, text)`` -> (row, n, key, check, sig, bands)."""

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = Sets(texts_of(batch.column(1)), words)
        full, minima = sets.size > 0, sets.minima()
        lists = lambda flat, width: pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(full * width)].astype(np.int32)), pa.array(flat.ravel().view(np.int64))
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets.size), pa.array(sets.sums(0xBF58476D1CE4E5B9).view(np.int64)),
             pa.array(sets.sums(0x94D049BB133111EB).view(np.int64)), lists(signatures(minima), BITS * _WORDS), lists(_bands(minima), BANDS)],
            names=["row", "n", "key", "check", "sig", "bands"],
        )

    return arrow_map(rows, build, "row long, n long, key long, check long, sig array<long>, bands array<long>")


def _close(percent: int, n: Column, m: Column, x: Column, y: Column) -> Column:
    """Whether sizes and signatures leave a pair a chance."""
    total = F.lit(0)
    for w in range(_WORDS):
        planes = [x[p * _WORDS + w].bitwiseXOR(y[p * _WORDS + w]) for p in range(BITS)]
        either = planes[0]
        for plane in planes[1:]:
            either = either.bitwiseOR(plane)
        total = total + F.bit_count(either)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (total <= MINIMA - least_agreement(percent))


def _hinted(rows: DataFrame) -> DataFrame:
    """Written rows, broadcast only where their number proves them small."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose whole sets are similar enough.

    A document streams past the copies of the one it is compared with, which is dealt anew for every SALT pairs.
    """
    ends = written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "ends")
    bodies = written(rows.select("row", "text").join(_hinted(ends), "row"), "bodies")
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = pairs.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    members = dealt.join(bodies.withColumnRenamed("row", "b"), "b").select("a", "salt", "b", "text")
    first = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    first = first.join(bodies.withColumnRenamed("row", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    side = members.unionByName(first).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            sets = Sets(texts_of(batch.column(3)), words)
            a, b = np.asarray(batch.column(0)), batch.column(2)
            is_head = np.asarray(b.is_null())
            b = np.asarray(b.fill_null(-1))
            cuts = np.r_[0, np.flatnonzero(is_head), len(a)]
            good = np.zeros(len(a), bool)
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                at = start
                if is_head[start]:
                    head = sets.hash[sets.first[start] : sets.first[start] + sets.size[start]].copy()
                    at += 1
                if at == end:
                    continue
                h = sets.hash[sets.first[at] : sets.first[end - 1] + sets.size[end - 1]]
                found = head[np.minimum(np.searchsorted(head, h), len(head) - 1)] == h
                common = np.add.reduceat(found, sets.first[at:end] - sets.first[at], dtype=np.int64)
                good[at:end] = 100 * common >= percent * (len(head) + sets.size[at:end] - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return written(side.mapInArrow(run, "a long, b long"), "links")


def _open_pairs(roots: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, percent: int, block: slice) -> np.ndarray:
    """(rows of the block, all rows): pairs of different components whose sizes and signatures leave them a chance."""
    agree = agreement(sigs[block][:, None, :], sigs[None, :, :])
    small, large = np.minimum(sizes[block][:, None], sizes[None, :]), np.maximum(sizes[block][:, None], sizes[None, :])
    return (agree >= least_agreement(percent)) & (roots[block][:, None] != roots[None, :]) & (100 * small >= percent * large)


def _forest(roots: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, percent: int) -> np.ndarray:
    """For each member of a bucket or tile the first of those that candidate pairs connect it with."""
    labels = Labels(len(roots))
    for at in range(0, len(roots), 256):
        x, y = np.nonzero(_open_pairs(roots, sizes, sigs, percent, slice(at, at + 256)))
        labels.join(x + at, y)
    return labels.of


def _links(texts: list[bytes], roots: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, words: int, percent: int) -> list[tuple[int, int]]:
    """Spanning links between the components of the members: candidates compared on their whole sets, one after another."""
    sets, roots, out = Sets(texts, words), roots.copy(), []
    if not len(sets.hash):
        return out
    ids = np.unique(sets.hash, return_inverse=True)[1]
    own = np.zeros(ids.max() + 1, bool)
    for at in range(0, len(roots), 256):
        grid = _open_pairs(roots, sizes, sigs, percent, slice(at, at + 256))
        for x in np.flatnonzero(grid.any(1)) + at:
            y = np.flatnonzero(grid[x - at, x + 1 :] & (roots[x + 1 :] != roots[x])) + x + 1
            if not len(y):
                continue
            mine = ids[sets.first[x] : sets.first[x] + sets.size[x]]
            own[mine] = True
            heads = np.cumsum(sets.size[y]) - sets.size[y]
            flat = np.repeat(sets.first[y] - heads, sets.size[y]) + np.arange(sets.size[y].sum())
            common = np.add.reduceat(own[ids[flat]], heads, dtype=np.int64)
            own[mine] = False
            for other in y[100 * common >= percent * (sets.size[x] + sets.size[y] - common)]:
                if roots[other] != roots[x]:
                    out.append((x, other))
                    roots[roots == roots[other]] = roots[x]
    return out


def _tiled(members: DataFrame, key: str) -> DataFrame:
    """``members(key, row, root, n, ...)``, those of a large group dealt to every pair of its tiles, in order of it."""
    sizes = members.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")
    dealt = members.join(sizes, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = [c for c in members.columns if c != key]
    dealt = dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "row")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a group whose first three columns are equal and stand together, as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            if held and [held[0].column(i)[0].as_py() for i in range(3)] != keys[start].tolist():
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


def _numbers(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, components, sizes and signatures of a group."""
    rows, roots, sizes = (np.asarray(group.column(i)) for i in (3, 4, 5))
    return rows, roots, sizes, np.asarray(group.column(6).flatten()).view(np.uint64).reshape(len(rows), -1)


def _edges(rows: np.ndarray, left, right) -> pa.RecordBatch:
    index = lambda i: pa.array(rows[np.asarray(i, np.int64)])
    return pa.RecordBatch.from_arrays([index(left), index(right)], names=["a", "b"])


def _rest(members: DataFrame, classes: DataFrame, rows: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between members of a bucket that ``roots(row, root)`` leaves in different components.

    Candidates by signature are connected first, bucket by bucket; each of these clusters then brings its texts together
    once, in tiles, and a task returns the links that it verified, never more than it has members.
    """
    placed = members.join(roots, "row", "left").select("band", "row", F.coalesce("root", "row").alias("root"))
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    shapes = classes.select("row", "n", "sig")
    inside = placed.join(open_.select("band"), "band").join(shapes, "row").select("band", "row", "root", "n", "sig")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            numbers, roots, sizes, sigs = _numbers(group)
            first = _forest(roots, sizes, sigs, percent)
            more = np.flatnonzero(first != np.arange(len(first)))
            yield _edges(numbers, more, first[more])

    clusters = connected_components(_tiled(inside, "band").mapInArrow(connect, "a long, b long"))
    asked = clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    together = asked.join(roots, "row", "left").select("cluster", "row", F.coalesce("root", "row").alias("root"))
    together = written(together.join(shapes, "row").select("cluster", "row", "root", "n", "sig"), "clusters")
    bodies = rows.select("row", "text").join(_hinted(together.select("row")), "row", "left_semi")
    full = together.join(bodies, "row").select("cluster", "row", "root", "n", "sig", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            numbers, roots, sizes, sigs = _numbers(group)
            links = _links(texts_of(group.column(7)), roots, sizes, sigs, words, percent)
            yield _edges(numbers, [a for a, _ in links], [b for _, b in links])

    return written(_tiled(full, "cluster").mapInArrow(verify, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id") -> DataFrame:
    """``(id_column, n_shingles, component_id, kept)`` per row of ``docs``.

    Texts whose sets of ``words``-word shingles have ``100 * common >= percent * all`` are linked; ``component_id`` is
    the least id reachable, null ids left out (null where a component has no other), and ``kept`` says that it is the
    row's own. A text of fewer words is one shingle. Texts that are null, empty or blank have an empty set, are linked
    with nothing and kept. Rows that repeat an id are judged one by one.
    """
    rows = numbered(docs.select(id_column, "text")).select("row", F.col("doc")[id_column].alias("id"), F.col("doc.text").alias("text"))
    prints = written(_prints(rows.select("row", "text"), words), "prints")
    ids = rows.select("row", "id")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    alike = prints.filter("n > 0").select("row", "n", "key", "check").join(ids, "row").groupBy("n", "key", "check").agg(F.min(place).alias("first"))
    alike = written(alike.select("n", "key", "check", F.col("first.row").alias("row"), F.col("first.id").alias("least")), "alike")
    classes = written(prints.join(alike.select("row", "least"), "row").select("row", "least", "n", "sig", "bands"), "classes")

    dealt = classes.select("row", "least", F.explode("bands").alias("band"))
    order = F.struct(F.col("least").isNull().alias("none"), "least", "row")
    centers = dealt.groupBy("band").agg(F.min(order).alias("first"), F.count("*").alias("members")).filter("members > 1")
    members = written(dealt.select("band", "row").join(centers.select("band", F.col("first.row").alias("center")), "band"), "members")
    star = members.filter("row <> center").select(F.col("center").alias("a"), F.col("row").alias("b")).distinct()
    one = classes.select("row", "n", "sig")
    star = star.join(one.toDF("a", "n", "x"), "a").join(one.toDF("b", "m", "y"), "b")
    star = star.filter(_close(percent, F.col("n"), F.col("m"), F.col("x"), F.col("y"))).select("a", "b")
    links = _verified(written(star, "star"), rows, words, percent)
    roots = written(connected_components(links).withColumnRenamed("node", "row"), "roots")
    links = links.unionByName(_rest(members.select("band", "row"), classes, rows, roots, words, percent))
    roots = connected_components(links).withColumnRenamed("node", "row")
    placed = alike.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    known = placed.join(least, "root").select("n", "key", "check", "component")
    out = prints.select("row", "n", "key", "check").join(ids, "row").join(known, ["n", "key", "check"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    own = F.coalesce(component == F.col("id"), F.col("id").isNull() & component.isNull())
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), own.alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with the rows of the least id of each component, columns unchanged; every row of such an id stays."""
    out = near_duplicates(docs, words, percent, id_column)
    gone = out.filter(~F.col("kept")).select(F.col(id_column).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_column].eqNullSafe(F.col("gone_id")), "left_anti")
