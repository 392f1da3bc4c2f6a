"""Vector code compression: product codes whose codebooks are fitted by exact whole-number k-means.

A vector of whole numbers is cut into equal parts, and each part is replaced by the index of the nearest entry of its
position's codebook. Rounds of assigning and averaging fit the codebooks. Between rounds every part keeps Drake-Hamerly
bounds in a written table: an upper bound of the distance to its own entry, the b next closest entries with lower
bounds in order, and one outer bound for all the others. Entries that move shift the bounds; a part whose upper bound
stays below the lower ones keeps its entry unseen. The others are settled by whole-number distances, to as many
of the listed entries as the bounds leave open, or to all if the outer bound fails. b shrinks to what was needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ragframe.llm.common import dropped, stored, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Listed entries at the first round, at least, and the share of uncertain parts that a list has to serve.
LISTED = ENTRIES // 16
LISTED_LEAST = ENTRIES // 64
SERVED = 0.99
# Rows of a distance matrix held at once.
ROWS = 4096
# Bounds are kept as 32-bit floats, each moved outwards by more than what its rounding can take.
_SLACK = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """Entries by part and index: whole numbers of shape (parts, entries, width of a part)."""

    entries: np.ndarray

    def text(self) -> str:
        """All components in order of part, entry and position, comma-joined."""
        return ",".join(str(int(v)) for v in self.entries.ravel())

    def decode(self, codes: DataFrame, code: str = "code") -> DataFrame:
        """``codes`` with ``vector``, the whole numbers that its binary code stands for (null for none)."""
        books = [[[int(v) for v in entry] for entry in book] for book in self.entries]

        at = codes.columns.index(code)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [
                    None if c is None else [v for p, i in enumerate(c) for v in books[p][i]] for c in batch.column(at).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.int64()))], names=[*batch.schema.names, "vector"])

        return codes.mapInArrow(rows, StructType([*codes.schema.fields, StructField("vector", ArrayType(LongType()))]))


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component."""
    return F.transform(vectors[vector], lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vectors[vector], lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors[vector].isNotNull() & ~F.coalesce(bad, F.lit(True))


# ---- numbers ------------------------------------------------------------------------------------


def _exact(x: np.ndarray) -> np.ndarray:
    """Numbers in which squared distances are exact: doubles where they hold them, else Python's whole numbers."""
    most = int(np.abs(x.astype(object)).max()) if x.size and np.abs(x.astype(np.float64)).max() > 2**20 else 2**20
    return x.astype(np.float64) if 4 * x.shape[-1] * most * most < 2**53 else x.astype(object)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries)."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def _up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(squared.astype(np.float64)) * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(squared: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(squared.astype(np.float64)) * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))


def bounds(listed: int) -> np.dtype:
    """What a part remembers: own entry, upper bound, listed entries with lower bounds, bound of the others, list used."""
    return np.dtype([("code", "u1"), ("used", "u1"), ("upper", "<f4"), ("outer", "<f4"), ("low", "<f4", (listed,)), ("near", "u1", (listed,))])


def assigned(x: np.ndarray, book: np.ndarray, listed: int) -> np.ndarray:
    """Bounds of parts ``x`` from all distances: nearest entry, ties to the lower index."""
    k = len(book)
    out = np.zeros(len(x), bounds(listed))
    for at in range(0, len(x), ROWS):
        d = _distances(x[at : at + ROWS], book)
        rows, state = np.arange(len(d)), out[at : at + ROWS]
        code = d.argmin(1)
        order = np.argsort(d, axis=1, kind="stable")
        others = order[order != code[:, None]].reshape(len(d), k - 1)
        state["code"], state["upper"] = code, _up(d[rows, code])
        far = np.take_along_axis(d, others, 1)
        state["near"], state["low"] = others[:, :listed], _down(far[:, :listed])
        state["outer"] = _down(far[:, listed]) if listed < k - 1 else np.inf
    out["used"] = listed + 1
    return out


def moved(state: np.ndarray, x: np.ndarray, book: np.ndarray, moves: np.ndarray, listed: int) -> np.ndarray:
    """Bounds after the entries moved by at most ``moves``, with lists cut to ``listed``."""
    had = state["low"].shape[1]
    if x.dtype == object:
        return assigned(x, book, listed)
    upper = _wide(state["upper"] + moves[state["code"]], up=True)
    low = _wide(state["low"] - moves[state["near"]], up=False)
    outer = _wide(state["outer"] - moves.max(), up=False)
    floor = np.minimum.accumulate(np.column_stack([low, outer])[:, ::-1], axis=1)[:, ::-1]  # least bound from each place on
    code, near, used = state["code"].copy(), state["near"].copy(), np.zeros(len(state), np.uint8)

    open_rows = np.flatnonzero(~(upper < floor[:, 0]))
    own = book[code[open_rows]]
    here = ((x[open_rows] - own) ** 2).sum(1)
    upper[open_rows] = _up(here)
    still = ~(upper[open_rows] < floor[open_rows, 0])
    open_rows, here = open_rows[still], here[still]
    certain = upper[open_rows][:, None] < floor[open_rows]
    some = certain.any(1)
    need = np.where(some, certain.argmax(1), had + 1)
    used[open_rows] = need

    rows = open_rows[some]
    for at in range(0, len(rows), ROWS):
        r, z = rows[at : at + ROWS], need[some][at : at + ROWS]
        width = z.max(initial=1)
        index = np.column_stack([code[r], near[r, :width]]).astype(np.int64)
        d = np.column_stack([here[some][at : at + ROWS], ((x[r][:, None, :] - book[near[r, :width]]) ** 2).sum(2)]).astype(np.float64)
        d[:, 1:][np.arange(width)[None, :] >= z[:, None]] = np.inf
        order = np.lexsort((index, d), axis=1)  # whole-number distances, ties to the lower index
        index, d = np.take_along_axis(index, order, 1), np.take_along_axis(d, order, 1)
        code[r], upper[r] = index[:, 0], _up(d[:, 0])
        fresh = np.isfinite(d[:, 1:])
        near[r, :width] = np.where(fresh, index[:, 1:], near[r, :width])
        low[r, :width] = np.where(fresh, _down(np.where(fresh, d[:, 1:], 0)), low[r, :width])

    out = np.zeros(len(state), bounds(listed))
    out["code"], out["used"], out["upper"] = code, used, upper
    out["near"], out["low"] = near[:, :listed], low[:, :listed]
    out["outer"] = np.minimum(outer, low[:, listed:].min(axis=1, initial=np.inf))
    lost = open_rows[~some]
    if len(lost):
        out[lost] = assigned(x[lost], book, listed)
        out["used"][lost] = had + 1
    return out


def _wide(bound: np.ndarray, up: bool) -> np.ndarray:
    return np.nextafter(bound.astype(np.float32), np.float32(np.inf if up else -np.inf))


# ---- rounds -------------------------------------------------------------------------------------


def _fields(parts: int) -> str:
    return ", ".join(f"p{i} binary" for i in range(parts))


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, parts, -1)
    return x


def _assign(source: DataFrame, books: np.ndarray, moves: np.ndarray | None, had: list[int], listed: list[int]) -> DataFrame:
    """``source(x, key, p0...)`` with the bounds of the next round."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, states = _parts(batch, parts), []
            for p in range(parts):
                exact = _exact(np.concatenate([x[:, p], books[p]]))
                part, book = exact[: len(x)], exact[len(x) :]
                if moves is None:
                    state = assigned(part, book, listed[p])
                else:
                    before = np.frombuffer(b"".join(batch.column(2 + p).to_pylist()), bounds(had[p]))
                    state = moved(before, part, book, moves[p], listed[p])
                size, raw = state.dtype.itemsize, state.tobytes()
                states.append(pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *states], names=["x", "key", *(f"p{i}" for i in range(parts))])

    return source.mapInArrow(run, f"x array<bigint>, key bigint, {_fields(parts)}")


def _averaged(state: DataFrame, books: np.ndarray, listed: list[int]) -> np.ndarray:
    """Every entry as the floor of the mean of its parts; entries without parts stay."""
    parts, k, width = books.shape
    kinds = [bounds(n) for n in listed]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            x = _parts(batch, parts)
            for p in range(parts):
                code = np.frombuffer(b"".join(batch.column(1 + p).to_pylist()), kinds[p])["code"]
                np.add.at(total[p], code, np.column_stack([x[:, p], np.ones(len(x), np.int64)]))
        at = np.flatnonzero(np.repeat(total[:, :, -1] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    found = state.select("x", *(f"p{i}" for i in range(parts))).mapInArrow(sums, "at bigint, v bigint")
    total = np.zeros(parts * k * (width + 1), object)
    for at, v in found.groupBy("at").agg(F.sum("v")).collect():  # one row per codebook component
        total[at] = v
    total = total.reshape(parts, k, width + 1)
    out = books.copy()
    used = total[:, :, -1] > 0
    out[used] = (total[used][:, :-1] // total[used][:, -1:]).astype(np.int64)
    return out


def _lists(state: DataFrame, had: list[int], least: int) -> list[int]:
    """Per part position, the shortest list that served the share SERVED of the parts that the bounds left open."""
    out = []
    for p, n in enumerate(had):
        used = F.conv(F.hex(F.substring(F.col(f"p{p}"), 2, 1)), 16, 10).cast("int").alias("used")  # second byte of the bounds
        counts = dict(state.select(used).groupBy("used").count().collect())  # at most n + 2 rows
        asked = sorted((u, c) for u, c in counts.items() if 0 < u <= n)
        sums = np.cumsum([c for _, c in asked])
        need = asked[int(np.searchsorted(sums, SERVED * sums[-1]))][0] if asked else least
        out.append(min(n, max(least, need)))
    return out


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(row of ``vectors`` as struct ``doc``, ``code`` binary, ``error`` long) and the codebooks.

    Vectors that are null or hold null or non-finite components are dropped. ``error`` is the squared distance to what
    the code stands for. Codebooks start as the vectors of the smallest ids (null last, ties by the vector). Vectors
    whose length is not that of the first of them, and all if that length cannot be cut in ``parts``, get a null code
    and error and take no part, as does an error beyond a long. Rows that repeat an id are coded one by one. Without
    vectors the result is empty and so are the codebooks.
    """
    everything = F.struct(*(F.col(f"`{c}`") for c in vectors.columns if c != vector)).alias("doc")
    kept = vectors.filter(usable(vectors, vector)).select(
        F.monotonically_increasing_id().alias("key"), everything, vectors[id_column].alias("id"), whole_numbers(vectors, vector, scale).alias("x")
    )
    kept = written(kept, "vectors")
    order = [F.col("id").isNull(), F.col("id"), F.col("x")]
    head = kept.orderBy(*order).select(F.size("x")).first()
    width = head[0] if head else 0
    if not width or width % parts:
        return kept.select("doc", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), Codebooks(np.zeros((parts, 0, 0), np.int64))
    fits = kept.filter(F.size("x") == width)
    first = fits.orderBy(*order).select("x").limit(entries).collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    least = min(max(1, LISTED_LEAST), max(len(first) - 1, 0))
    listed = had = [min(LISTED, len(first) - 1)] * parts
    state, moves, path = fits.select("x", "key"), None, None
    for turn in range(rounds + 1):
        before = path
        state, path = stored(_assign(state, books, moves, had, listed), "bounds")
        if before is not None:
            dropped(kept.sparkSession, before)
        if turn == rounds:
            break
        fresh = _averaged(state, books, listed)
        moves = _up(((fresh - books).astype(object) ** 2).sum(2))
        books, had = fresh, listed
        if turn:
            listed = _lists(state, had, least)
    kinds = [bounds(n) for n in listed]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, total = _parts(batch, parts), 0
            codes = np.column_stack([np.frombuffer(b"".join(batch.column(2 + p).to_pylist()), kinds[p])["code"] for p in range(parts)])
            for p in range(parts):
                exact = _exact(np.concatenate([x[:, p], books[p]]))
                total = total + ((exact[: len(x)] - exact[len(x) :][codes[:, p]]) ** 2).sum(1)
            error = [int(v) if v < 2**63 else None for v in total]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())], names=["key", "code", "error"]
            )

    coded = state.mapInArrow(finish, "key bigint, code binary, error bigint")
    return kept.select("key", "doc").join(coded, "key", "left").select("doc", "code", "error"), Codebooks(books)


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: error summed over the rows of equal labels, nulls together."""
    name = F.col("doc")[label]
    sums = coded.groupBy(name.alias("label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, name.eqNullSafe(sums["label"])).select("doc", "code", "error", "label_error")
