"""b-bit MinHash against all pairs of whole sets, its estimate, groups of copies, defined cases."""

import random

import numpy as np
import pytest

from ragframe.llm import minhash

SCHEMA = "doc_id long, text string, root long, n int, row string"
WORDS = [f"w{i}" for i in range(4000)]


def shingles(text, words=5):
    parts = (text or "").encode().lower().split()
    if not parts:
        return set()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def plain(rows, percent=85):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, percent=85):
    df = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, percent=percent).collect()}
    want = plain(rows, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def edited(rng, text, edits):
    parts = text.split()
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = rng.choice(WORDS)
    return " ".join(parts)


def test_links_like_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(6, 400))) for _ in range(25)]
    rows = []
    for text in base:
        rows.append((len(rows) + 5, text))
        for edits in range(rng.randint(0, 8)):
            rows.append((len(rows) + 5, edited(rng, text, edits)))
    passage = " ".join(rng.choices(WORDS, k=60))
    rows += [(1000 + i, f"{passage} {' '.join(rng.choices(WORDS, k=rng.randint(3, 60)))}") for i in range(30)]
    rows += [(2000, "One two"), (2001, "one\ttwo "), (2002, "one two three"), (2003, ""), (2004, None), (2005, " \n"), (2006, "ONE TWO")]
    rows += [(3000, " ".join(rng.choices(WORDS, k=60_000)))]
    rows += [(3001, edited(rng, rows[-1][1], 1500))]
    rng.shuffle(rows)
    check(spark, rows)


def test_a_group_without_a_center(spark, monkeypatch):
    """Copies that are like their original, which does not come first, and unlike each other; small tiles."""
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "SALT", 8)
    rng = random.Random(5)
    text = " ".join(rng.choices(WORDS, k=150))
    rows = [(i, edited(rng, text, 2)) for i in range(70)]
    rows.insert(35, (500, text))
    chain = [text.split()[:100]]
    for _ in range(12):
        chain.append(chain[-1][2:] + rng.choices(WORDS, k=2))
    rows += [(600 + i, " ".join(c)) for i, c in enumerate(chain)]
    check(spark, rows)


@pytest.mark.parametrize("common", [20, 60, 90])
def test_estimate(common):
    rng = random.Random(common)
    both = [" ".join(rng.choices(WORDS, k=5)) for _ in range(10 * common)]
    sides = [[" ".join(rng.choices(WORDS, k=5)) for _ in range(10 * (100 - common) // 2)] for _ in range(2)]

    class Given(minhash.Sets):
        def __init__(self, lists):
            self.hash = np.concatenate([np.unique(np.array([hash(s) & (2**64 - 1) for s in x], np.uint64)) for x in lists])
            self.size = np.array([len(set(x)) for x in lists])
            self.first = np.cumsum(self.size) - self.size

    a, b = minhash.signatures(Given([both + s for s in sides]).minima())
    true = len(set(both)) / len(set(both + sides[0] + sides[1]))
    assert abs(float(minhash.similarity(minhash.agreement(a, b))) - true) < 0.16
    assert minhash.similarity(np.array(minhash.least_agreement())) < 0.75


def test_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "a b c d e f g"
    rows = [(7, text, 1, 1, "x"), (7, text, 2, 1, "x"), (None, text, 3, 1, "x"), (None, "z", 4, 1, "x"), (9, text + " h", 5, 1, "x"), (3, None, 6, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (None, 1, None, True), (9, 4, 9, True), (3, 0, 3, True)], key=str
    )
    kept = minhash.drop_near_duplicates(df, percent=70)
    assert kept.columns == df.columns
    assert sorted(r["root"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 6]
