"""Line deduplication where the lines of one template share their prefix words."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from ragframe.llm import lines
from ragframe.llm.common import numbered


@pytest.fixture(scope="module")
def template():
    """Lines of ten words with one field that varies, of six with two (never similar), and lines of their own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(150):
        part = [f"one two three four five {word()} seven eight nine ten" for _ in range(2)]
        part += [f"alpha beta gamma delta {word()} {word()}", " ".join(word() for _ in range(8))]
        rng.shuffle(part)
        rows.append((i, "\n".join(part)))
    return rows


def by_force(rows):
    every, gone = [], collections.defaultdict(list)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            words = frozenset(line.split())
            if any(10 * len(words & e) >= 8 * len(words | e) for e in every):
                gone[i].append(k)
            every.append(words)
    return [(i, gone[i]) for i, _ in rows]


@pytest.mark.parametrize("bound", [lines.BUCKET_ENTRIES, 40])
def test_divided_words_lose_no_line(spark, template, bound, monkeypatch):
    monkeypatch.setattr(lines, "WORD_ENTRIES", bound)
    docs = spark.createDataFrame(template, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], list(r["removed"])) for r in lines.removed_lines(docs).collect()]
    assert sorted(got) == by_force(template)


def test_no_task_holds_a_word(spark, template, monkeypatch):
    monkeypatch.setattr(lines, "WORD_ENTRIES", 40)
    docs = numbered(spark.createDataFrame(template, "id long, text string").repartition(5))
    rows = docs.select("row", "doc.id", "doc.text")
    rare = lines.rarity(rows)
    parts = lines.word_parts(rows, rare, 0.8)
    packed = lines._packed(rows, spark.sparkContext.broadcast(rare), 16, parts, 0.8).collect()
    held, words = collections.Counter(), collections.Counter()
    for bucket, n, data in packed:
        for token in lines._unpack(bytes(data), n)["token"].tolist():
            held[bucket, token] += 1
            words[token] += 1
    assert max(words.values()) >= 150 and max(held.values()) <= 80
    assert (parts > 1).sum() >= 2 and len({b for b, *_ in packed if b >= 16}) == int(np.where(parts > 1, parts, 0).sum())


def test_long_lines_that_share_a_rare_word_are_no_candidates():
    """Long lines fill a bitmap of 64 bits, so that it tells nothing of them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts = [" ".join(["shared", *(word() for _ in range(150))]).encode() for _ in range(40)]
    texts += [texts[0] + b" more", b" ".join(texts[1].split()[:-9])]
    rare = np.full(lines.SLOTS, 5)
    rare[int(lines._word_hashes([b"shared"])[0]) & lines.SLOTS - 1] = 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.decode() for t in texts])], names=["id", "text"])
    packed = lines._entries(batch, rare, 1, np.ones(lines.SLOTS, np.int64), None, 0.8)
    e = lines._merged(list(zip(packed.column(1).to_pylist(), packed.column(2).to_pylist(), strict=True)))
    x, y, _ = lines.earliest(e, 0.8, 8)
    assert set(zip(e["id"][x].tolist(), e["id"][y].tolist(), strict=True)) == {(40, 0), (41, 1)}


def test_first_line_of_a_stubborn_class_stays(spark, monkeypatch):
    """A class whose candidates prove unlike asks by its first line, not by a later one behind a line that is like it."""
    monkeypatch.setattr(lines, "TRIES", 0)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    bit = lambda w: int(lines._word_hashes([w.encode()])[0]) >> 58

    def twin(w):
        while bit(v := word()) != bit(w):
            pass
        return v

    texts = collections.defaultdict(list)
    for _ in range(12):
        first = [word() for _ in range(9)]
        unlike = [twin(first[0]), twin(first[1]), *first[2:]]  # the same bitmap, two words too few
        like = [*first, word()]
        for i, line in ((1, unlike), (5, first), (20, like), (50, first)):
            texts[i].append(" ".join(line))
    rows = [(i, "\n".join(t)) for i, t in sorted(texts.items())]
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # the two first lines reach the buckets apart
    docs = own.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id")
    got = [(r["doc_id"], list(r["removed"])) for r in lines.removed_lines(docs).collect()]
    assert sorted(got) == by_force(rows)
