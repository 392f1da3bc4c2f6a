"""Marks stay on their rows when the splits of a scan change between the jobs of an operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ragframe.llm import common, decontaminate, lines, shingles, simhash, substrings, suffixes


@pytest.fixture()
def shifting(spark, tmp_path, monkeypatch):
    """A table of one file with many row groups, and a session whose splits change with every table that is written."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(400)]
    rows = [(i, rows[i - 1][1] if i % 10 == 7 else t) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).option(
        "parquet.page.size", 1024
    ).option("parquet.page.row.count.limit", 10).option("parquet.block.size.row.check.min", 10).parquet(f"{tmp_path}/docs")
    name, old, plain = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.openCostInBytes"), common.written
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    counts = [1, 5, 2, 7, 3, 9, 4, 11, 6, 13, 8]

    def written(df, table):
        spark.conf.set(name, str(counts[0]))
        counts.append(counts.pop(0))
        out = plain(df, table)
        spark.conf.set(name, str(counts[0]))
        return out

    for module in (common, decontaminate, lines, shingles, simhash, substrings, suffixes):
        monkeypatch.setattr(module, "written", written, raising=False)
    spark.conf.set(name, "6")
    yield rows, spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.unset(name)
    spark.conf.set("spark.sql.files.openCostInBytes", old)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_splits_do_change(spark, shifting):
    _, docs = shifting
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    few = docs.select("doc_id").rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.minPartitionNum", "9")
    assert few < spark.read.parquet(docs.inputFiles()[0]).rdd.getNumPartitions()


def test_contaminated_rows_go(spark, shifting):
    rows, docs = shifting
    items = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 400, 9)], "item_id long, text string")
    bad = {t for i, t in rows if i % 9 == 0}
    assert ids(decontaminate.drop_documents(docs, items)) == [i for i, t in rows if t not in bad]
    cut = decontaminate.drop_spans(docs, items).filter("text = ''")
    assert ids(cut) == [i for i, t in rows if t in bad]


@pytest.mark.parametrize("operator", [lines.drop_lines, simhash.keep_one, shingles.keep_one])
def test_copies_go(shifting, operator):
    rows, docs = shifting
    assert ids(operator(docs)) == [i for i, _ in rows if i % 10 != 7]


def planted(rows, docs):
    """Every twentieth text ends with the same passage; copies of whole texts are there already."""
    passage = " ".join(f"shared{i:03d}" for i in range(60))
    ends = F.col("doc_id") % 20 == 3
    texts = docs.withColumn("text", F.when(ends, F.concat("text", F.lit(" " + passage))).otherwise(F.col("text")))
    return passage, texts


def test_repeated_windows_go(shifting):
    rows, docs = shifting
    passage, texts = planted(rows, docs)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.passages(texts).collect()}
    want = {i: (60, 60 if i % 10 == 7 else 0) for i, _ in rows}
    want.update({i: (120, 0 if i == 3 else 60) for i in range(3, 400, 20)})
    assert got == want


def test_repeated_bytes_go(shifting):
    rows, docs = shifting
    passage, texts = planted(rows, docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.repeated_bytes(texts).collect()}
    whole = {i: f"{t} {passage}" if i % 20 == 3 else t for i, t in rows}
    times = Counter(t[a : a + 400] for t in whole.values() for a in range(len(t) - 399))
    want = {}
    for i, t in whole.items():
        gone = {b for a in range(len(t) - 399) if times[t[a : a + 400]] > 1 for b in range(a, a + 400)}
        want[i] = (len(t), len(gone))
    assert got == want and sum(n > 0 for _, n in want.values()) == 100
