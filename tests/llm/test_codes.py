"""Vector codes against k-means over all distances, bounds against the distances, defined cases."""

import numpy as np
import pytest

from ragframe.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, key int"


def plain(vectors, parts, entries, rounds):
    """(codes, errors, codebooks) of ``(id, whole numbers)`` in order of id, by comparing all with all."""
    x = np.array([v for _, v in sorted(vectors)], dtype=object).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        out = np.zeros((len(x), parts), int)
        errors = np.zeros(len(x), object)
        for p in range(parts):
            d = np.array([[sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]] for v in x[:, p]], dtype=object)
            out[:, p] = [min(range(len(row)), key=lambda i: (row[i], i)) for row in d]
            errors += d[np.arange(len(x)), out[:, p]]
        return out, errors

    for _ in range(rounds):
        own, _ = nearest()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = x[own[:, p] == i, p]
                if len(mine):
                    books[p][i] = [int(c) // len(mine) for c in mine.sum(0)]
    return *nearest(), books


@pytest.mark.parametrize("entries, spread", [(8, 1.0), (32, 0.05), (5, 1000.0)])
def test_codes_like_all_distances(spark, entries, spread):
    rng = np.random.default_rng(entries)
    centers = rng.normal(size=(6, 8))
    rows = [(int(i * 3 - 40), [float(c) for c in (centers[i % 6] + rng.normal(size=8) * spread)], int(i % 3), "a", 1) for i in range(150)]
    rows += [(1000 + i, rows[i][1], None, "a", 1) for i in range(20)]
    bad = [(-99, None, 1, "a", 1), (-98, [1.0, None] * 4, 1, "a", 1), (-97, [float("nan")] * 8, 1, "a", 1), (-96, [float("inf")] * 8, 1, "a", 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(3)
    out, books = codes.compress(df, parts=4, entries=entries, rounds=4)
    got = {r["doc"]["vec_id"]: r for r in codes.label_errors(out).collect()}
    whole = [(r[0], [int(np.floor(1024 * c)) for c in r[1]]) for r in rows]
    want_codes, want_errors, want_books = plain(whole, 4, entries, 4)
    assert (books.entries == want_books.astype(np.int64)).all()
    assert len(got) == len(rows)
    labels = {}
    for (vec_id, _), code, error in zip(sorted(whole), want_codes, want_errors, strict=True):
        assert list(got[vec_id]["code"]) == list(code)
        assert got[vec_id]["error"] == error
        labels[got[vec_id]["doc"]["label"]] = labels.get(got[vec_id]["doc"]["label"], 0) + error
    assert all(r["label_error"] == labels[r["doc"]["label"]] for r in got.values())
    for r in books.decode(out.select("doc.vec_id", "code")).collect():
        assert r["vector"] == [int(v) for p, i in enumerate(r["code"]) for v in want_books[p][i]]


def test_bounds_hold_and_shrink():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-900, 900, (3000, 4)).astype(float), rng.integers(-900, 900, (64, 4)).astype(float)
    state = codes.assigned(x, book, 16)
    looked = []
    for listed in (16, 9, 4, 4):
        fresh = book + np.floor(rng.normal(size=book.shape) * 15)
        moves = codes._up(((fresh - book) ** 2).sum(1))
        state, book = codes.moved(state, x, fresh, moves, listed), fresh
        d = np.sqrt(codes._distances(x, book))
        assert (state["code"] == d.argmin(1)).all()
        assert (state["upper"] >= d.min(1)).all()
        assert (state["low"] <= np.take_along_axis(d, state["near"].astype(int), 1)).all()
        others = d.copy()
        np.put_along_axis(others, state["near"].astype(int), np.inf, 1)
        others[np.arange(len(x)), state["code"]] = np.inf
        assert (state["outer"] <= others.min(1)).all()
        looked.append((state["used"] == 0).mean())
    assert min(looked) > 0.1  # parts that kept their entry without any distance


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out, books = codes.compress(empty)
    assert out.collect() == [] and books.text() == ""
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "a", 1), (2, [], 1, "a", 1)], SCHEMA)
    rows = codes.label_errors(codes.compress(odd)[0]).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in rows] == [(None, None, None)] * 2
    mixed = spark.createDataFrame([(1, [1.0] * 4, 1, "a", 1), (2, [1.0] * 8, 1, "a", 1), (None, [2.0] * 4, None, "a", 1), (1, [1.0] * 4, 2, "a", 1)], SCHEMA)
    rows = {(r["doc"]["vec_id"], r["doc"]["label"]): r for r in codes.label_errors(codes.compress(mixed)[0]).collect()}
    assert rows[(2, 1)]["code"] is None and rows[(1, 1)]["code"] == rows[(1, 2)]["code"] and rows[(None, None)]["error"] == 0
    huge = spark.createDataFrame([(1, [0.0] * 4, 1, "a", 1), (2, [2.0**45] * 4, 1, "a", 1)], SCHEMA)
    rows = {r["doc"]["vec_id"]: r for r in codes.compress(huge, entries=1, rounds=0)[0].collect()}
    assert rows[1]["error"] == 0 and rows[2]["error"] is None
