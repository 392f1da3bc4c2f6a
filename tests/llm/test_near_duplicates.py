"""The pipeline's near-duplicate stage beside brute force on planted copies."""

import random

import pytest

from ragframe.llm import shingles


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def kept_by_force(rows):
    sets, label = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                old, new = label[i], label[j]
                label = [new if c == old else c for c in label]
    first = {}
    for (i, _), c in zip(rows, label, strict=True):
        first[c] = min(first.get(c, (True, 0)), (i is None, i or 0))
    return sorted(i for none, i in first.values() if not none), len(first)


@pytest.fixture(scope="module")
def planted():
    """Texts of 400 words and copies with 2 to 12 words replaced: Jaccard from about 0.95 down to below 0.8."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, near = [], []
    for i in range(12):
        base = [word() for _ in range(400)]
        rows.append((100 * i, " ".join(base)))
        for n in range(2, 13):
            copy = base[:]
            for at in rng.sample(range(0, 400, 6), n):
                copy[at] = word()
            rows.append((100 * i + n, " ".join(copy)))
            x, y = sets_of(rows[-1 - (n - 1)][1]), sets_of(rows[-1][1])
            near.append(len(x & y) / len(x | y))
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (5004, "a c"), (None, rows[0][1])]
    return rows, near


def test_stage_finds_planted_copies(spark, planted):
    import corpus_pipeline as cp

    rows, near = planted
    assert min(near) < 0.8 and sum(0.8 <= j < 0.95 for j in near) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, "").collect()]
    want, n = kept_by_force(rows)
    assert (sorted(i for i in got if i is not None), len(got)) == (want, n)


def test_each_pair_by_itself(spark, planted):
    """One text and one copy at a time, so that no third text can link them."""
    rows, _ = planted
    by_id = dict(rows[:-6])
    for i in (0, 100):
        for n in range(2, 13, 5):
            pair = [(1, by_id[i]), (2, by_id[i + n])]
            got = shingles.keep_one(spark.createDataFrame(pair, "doc_id long, text string")).count()
            assert got == kept_by_force(pair)[1]


def test_stage_takes_links_from_the_simhash_index(spark, planted, monkeypatch):
    import corpus_pipeline as cp
    from ragframe.llm import simhash

    rows, _ = planted
    found, original = [], simhash.links

    def links(fps, *args):
        edges = original(fps, *args)
        found.append(edges.count())
        return edges

    monkeypatch.setattr(simhash, "links", links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cp.near_duplicate_stage(spark, docs, "").count() == kept_by_force(rows)[1]
    assert len(found) == 1 and found[0] > 0
