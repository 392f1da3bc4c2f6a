"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows, a small table whose size is checked, are the broadcast hash set; every window of every
document is looked up in it by its words, so a hit is exact. One scan finds hits and word counts; only hits and one
row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import ascii_lower, numbered, written

WINDOW = 13
# A document is contaminated when at least 1 / SHARE of its words are hit.
SHARE = 20
# Fixed value: characters between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word of the text as it stands, with what precedes it; or what follows the last word.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
# Above either bound the windows are joined by a shuffle instead; results are the same.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-case words of a text, none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _windows(words: Column, length: int) -> Column:
    """Every window of ``length`` words as (start, length, window)."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(words, i + 1, length), " ").alias("window")
        ),
    )


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``items(item_id, text)`` -> distinct (item_id, length, window); an item of fewer words is one window.

    Items without a word give none; an item without an id is named by the empty string.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w"))
    sized = words.filter(F.size("w") > 0).withColumn("length", F.least(F.lit(window), F.size("w")))
    starts = sized.select("item_id", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    return starts.select("item_id", "length", F.array_join(F.slice("w", F.col("i"), F.col("length")), " ").alias("window")).distinct()


def _covered(hits: Column) -> Column:
    """Number of words in the union of (start, length) intervals."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(hits), zero,
        lambda acc, h: F.struct(
            F.greatest(acc["to"], h["start"] + h["length"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(acc["to"], h["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def scan(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: (row, id_column, n_words, n_hit, n_items, items, contaminated, hits).

    ``row`` tells the rows of one result apart; another scan of ``docs`` may number them otherwise. ``items`` holds
    the sorted ids of the items with a window in the text, ``hits`` the (start, length) of each occurrence. Null texts
    and texts without words are clean. Rows that repeat an id, and repeated items, are judged one by one.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), "text")
    return _scan(rows, items, id_column, window)


def _scan(rows: DataFrame, items: DataFrame, id_column: str, window: int = WINDOW) -> DataFrame:
    """``scan`` of ``rows(row, id, text)``."""
    bench = written(benchmark_windows(items, window), "windows")
    sets = bench.select("length", "window").distinct().withColumn("window_id", F.xxhash64("length", "window"))
    size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    small = size[0] <= BROADCAST_WINDOWS and size[1] <= BROADCAST_BYTES
    hinted = F.broadcast if small else (lambda df: df)
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())  # at most ``window`` numbers

    sentinel = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("window")))
    worded = rows.select("row", "id", words_of(F.col("text")).alias("words")).select(
        "row", "id", F.size("words").cast("long").alias("n_words"), "words"
    )
    windows = worded.select(
        "row", "id", "n_words", F.inline(F.concat(sentinel, *[_windows(F.col("words"), n) for n in lengths]))
    )
    found = windows.join(hinted(sets.drop("length")), "window", "left").filter("window_id is not null or start < 0")
    real = F.col("window_id").isNotNull()
    per_row = written(
        found.groupBy("row", "id", "n_words").agg(
            F.collect_list(F.when(real, F.struct("start", "length"))).alias("hits"),
            F.collect_set(F.when(real, F.col("window_id"))).alias("window_ids"),
        ),
        "hits",
    )
    named = bench.select(F.xxhash64("length", "window").alias("window_id"), "item_id")
    met = (
        per_row.select("row", F.explode("window_ids").alias("window_id"))
        .join(hinted(named), "window_id").groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    n_hit = _covered(F.col("hits"))
    return (
        per_row.filter(F.size("hits") > 0).join(met, "row")
        .unionByName(per_row.filter(F.size("hits") == 0).withColumn("items", F.array().cast("array<string>")))
        .withColumn("n_hit", n_hit)
        .select(
            "row", F.col("id").alias(id_column), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
            ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits",
        )
    )


def _fields(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.select("row", F.col("doc")[id_column].alias("id"), F.col("doc.text").alias("text"))


def drop_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` without its contaminated rows, columns unchanged."""
    rows = numbered(docs)
    bad = _scan(_fields(rows, id_column), items, id_column).filter("contaminated").select("row")
    return rows.join(bad, "row", "left_anti").select("doc.*")


def drop_spans(docs: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with hit words, and what stands before each of them, cut from ``text``; other rows are unchanged."""
    rows = numbered(docs)
    hits = written(_scan(_fields(rows, id_column), items, id_column).filter("n_hit > 0").select("row", "hits"), "spans")
    pieces = rows.join(hits, "row").select(
        "row", F.posexplode(F.regexp_extract_all("doc.text", F.lit(PIECE), F.lit(0))).alias("at", "piece")
    )
    gone = hits.select("row", F.explode("hits").alias("h")).select(
        "row", F.explode(F.sequence(F.col("h.start"), F.col("h.start") + F.col("h.length") - 1)).alias("at")
    ).distinct()
    left = F.array_sort(F.collect_list(F.struct("at", "piece")))
    kept = pieces.join(gone, ["row", "at"], "left_anti").groupBy("row").agg(
        F.array_join(F.transform(left, lambda p: p["piece"]), "").alias("cut")
    )
    cut = F.when(F.col("hit"), F.coalesce("cut", F.lit(""))).otherwise(F.col("doc.text"))
    joined = rows.join(hits.select("row", F.lit(True).alias("hit")), "row", "left").join(kept, "row", "left")
    return joined.select(F.col("doc").withField("text", cut).alias("doc")).select("doc.*")
