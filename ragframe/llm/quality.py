"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage becomes a vector of character-shape pairs and word statistics, an
encoder turns it into a hidden vector, gated attention (tanh times sigmoid) weighs the passages of a document, and
a logistic unit scores the weighted sum. Only document labels are needed to learn all three. The weights are fitted
on the driver from a bounded sample of labelled documents; scoring runs over every whole text in Arrow batches.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ragframe.llm.common import arrow_map, texts_of

PASSAGE = 64
PAIRS = 128
STATS = 6
WIDTH = PAIRS + STATS
HIDDEN = 24
GATE = 12
# Fitting sample: at most this many labelled documents of each label, none longer than SAMPLE_CHARS.
SAMPLE = 1500
SAMPLE_CHARS = 200_000
EPOCHS = 30
MINIBATCH = 128
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.3
FOLDS = 5
# Longer texts are encoded piece by piece, each cut at white space.
PIECE = 1 << 20


def _shapes() -> np.ndarray:
    """Class of each byte: 0 space, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 control, then every mark its own."""
    out = np.zeros(256, np.int64)
    marks = 6
    for b in range(256):
        if b in b" \t\n\r\v\f":
            out[b] = 0
        elif 97 <= b <= 122:
            out[b] = 1
        elif 65 <= b <= 90:
            out[b] = 2
        elif 48 <= b <= 57:
            out[b] = 3
        elif b >= 128:
            out[b] = 4
        elif b < 32 or b == 127:
            out[b] = 5
        else:
            out[b] = marks
            marks += 1
    return out


SHAPES = _shapes()
_PAIR_OF = ((np.arange(64)[:, None] * 64 + np.arange(64)) * 2654435761 % (1 << 32) >> 25).astype(np.int64)


def pieces_of(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > PIECE:
        to = max(text.rfind(b" ", at, at + PIECE), text.rfind(b"\n", at, at + PIECE))
        to = to if to > at else at + PIECE
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text); a text without words is one empty passage."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends_of_text = np.cumsum(sizes)
    shape = SHAPES[data]
    space = shape == 0
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    text_of = np.searchsorted(ends_of_text, starts, "right")
    words = np.bincount(text_of, minlength=len(texts))
    count = np.maximum(1, -(-words // PASSAGE))
    base = np.cumsum(count) - count
    inside = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passage = base[text_of] + inside // PASSAGE
    total = int(count.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if len(starts):
        heads = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        spans = np.diff(np.r_[starts[heads], len(data)])
        of_byte = np.repeat(passage[heads], spans)
        codes = _PAIR_OF[shape[starts[0] : -1], shape[starts[0] + 1 :]]
        # Up to the line feed that ends the text: what follows it in the batch must not count.
        own = np.arange(starts[0], len(data) - 1) < np.repeat(ends_of_text[text_of[heads]] - 1, spans)[:-1]
        pairs = np.bincount(of_byte[:-1][own] * PAIRS + codes[own], minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, :PAIRS] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
        n = np.bincount(passage, minlength=total)
        n1 = np.maximum(n, 1)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data) - 1, np.uint64(0x9E3779B97F4A7C15))])
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)]
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data) - 1, inverse)])
        word = (sums[ends] - sums[starts]) * back[starts]
        length = ends - starts
        again = np.r_[False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]
        order = np.lexsort((word, passage))
        w, p = word[order], passage[order]
        distinct = np.bincount(p[np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])]], minlength=total)
        first, last = shape[starts], shape[ends - 1]
        stats = [
            np.log1p(n) / 4,
            np.bincount(passage, length, total) / n1 / 8,
            np.bincount(passage, again, total) / n1,
            distinct / n1,
            np.bincount(passage, (first == 2) & (last == 2), total) / n1,
            np.bincount(passage, last >= 6, total) / n1,
        ]
        out[:, PAIRS:] = np.stack(stats, 1)
    return out, count


def encode_whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, in pieces of bounded size."""
    features, counts, held, size, owner = [], np.zeros(len(texts), np.int64), [], 0, []

    def flush() -> None:
        if held:
            f, c = encode(held)
            features.append(f)
            np.add.at(counts, owner, c)
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            if held and size + len(piece) > PIECE:
                flush()
                size = 0
            held.append(piece)
            owner.append(i)
            size += len(piece)
    flush()
    return (np.concatenate(features) if features else np.zeros((0, WIDTH), np.float32)), counts


@dataclass
class Model:
    """Weights of encoder (E, e), attention (V, U, w) and score (c, b)."""

    E: np.ndarray
    e: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def forward(self, x: np.ndarray, counts: np.ndarray):
        heads = np.cumsum(counts) - counts
        h = np.tanh(x @ self.E + self.e)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-np.clip(h @ self.U, -30, 30)))
        raw = (t * g) @ self.w
        top = np.repeat(np.maximum.reduceat(raw, heads), counts)
        a = np.exp(raw - top)
        a /= np.repeat(np.add.reduceat(a, heads), counts)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b[0], -30, 30)))
        return p, (heads, h, t, g, a, z)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        p, (heads, h, t, g, a, z) = self.forward(x, counts)
        d = (p - y) * weight / weight.sum()
        dz = np.repeat(d[:, None] * self.c, counts, axis=0)
        along = (dz * h).sum(1)
        draw = a * (along - np.repeat(np.add.reduceat(a * along, heads), counts))
        dt, dg = draw[:, None] * self.w * g * (1 - t * t), draw[:, None] * self.w * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ draw, z.T @ d, np.array([d.sum()])]


def new_model(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda *s: r.normal(0, s[0] ** -0.5, s)
    return Model(
        normal(WIDTH, HIDDEN) * 3, np.zeros(HIDDEN), normal(HIDDEN, GATE), normal(HIDDEN, GATE), normal(GATE),
        normal(HIDDEN), np.zeros(1),
    )


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Weights by Adam over balanced logistic loss. Without documents, or with one label, the score is constant."""
    model = new_model(seed)
    fields = list(vars(model))
    if not len(labels) or labels.min() == labels.max():
        model.c[:] = 0
        model.b[:] = 0.0 if not len(labels) else (5.0 if labels[0] else -5.0)
        return model
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    r = np.random.default_rng(seed)
    first, second, step = {f: 0.0 for f in fields}, {f: 0.0 for f in fields}, 0
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for at in range(0, len(order), MINIBATCH):
            pick = order[at : at + MINIBATCH]
            x = np.concatenate([features[i] for i in pick])
            counts = np.array([len(features[i]) for i in pick])
            step += 1
            for f, grad in zip(fields, model.gradients(x, counts, labels[pick], weights[pick]), strict=True):
                value = getattr(model, f)
                grad = grad + DECAY * value
                first[f] = 0.9 * first[f] + 0.1 * grad
                second[f] = 0.999 * second[f] + 0.001 * grad * grad
                value -= RATE * (first[f] / (1 - 0.9**step)) / (np.sqrt(second[f] / (1 - 0.999**step)) + 1e-8)
    return model


# ---- on tables ----------------------------------------------------------------------------------


def held_out(id_column: Column) -> Column:
    """Whether a document never serves for fitting: crc32 of its id as text is divisible by FOLDS."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", target: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled rows of each label, the first in the order of the id's hash.

    Labels that are null, held out, or of documents without a row are left out; of several labels of one document
    the least counts. ``docs`` rows that repeat an id are all used.
    """
    known = (
        labels.filter(F.col(id_column).isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col(id_column)))
        .groupBy(id_column).agg(F.min(target).cast("int").alias("label"))
    )
    hashed = F.xxhash64(F.lit("fit"), id_column)
    picked = [known.filter(F.col("label") == y).orderBy(hashed).limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample narrow rows
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).select(id_column, "text").join(chosen, id_column)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode_whole(texts_of(batch.column(1)))
        cut = np.split(x, np.cumsum(counts)[:-1])
        packed = pa.array([zlib.compress(f.astype("<f4").tobytes(), 1) for f in cut], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed], names=["h", "label", "x"])

    rows = rows.select(hashed.alias("h"), "text", "label")
    got = arrow_map(rows, features, "h long, label int, x binary").orderBy("label", "h", F.xxhash64("x")).toArrow()
    x = [np.frombuffer(zlib.decompress(v), "<f4").reshape(-1, WIDTH).astype(np.float64) for v in got.column(2).to_pylist()]
    return fit(x, np.asarray(got.column(1).combine_chunks()).astype(np.float64))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= THRESHOLD) after its own columns.

    Null and blank texts are one empty passage. Only ``text`` is read; rows that repeat an id score alike when
    their texts do. Columns of the same names are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode_whole(texts_of(batch.column(at)))
        p, _ = model.forward(x.astype(np.float64), counts)
        p = np.round(p, 9)
        more = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "score", "predicted"])

    base = docs.select(*(F.col(f"`{c}`") for c in names))
    more = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return arrow_map(base, rows, StructType([*base.schema.fields, *more]))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    at = docs.columns.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode_whole(texts_of(batch.column(at)))
        return batch.filter(pa.array(np.round(model.forward(x.astype(np.float64), counts)[0], 9) >= THRESHOLD))

    return arrow_map(docs, rows, docs.schema)
