"""Four chunking strategies over page bundles.

A bundle is one row a document, so every strategy is a projection without a shuffle. Packing words
greedily under a character budget is what one greedy regular expression does, so the word-stream
strategies never touch single words: pages are joined into one blank-separated string, the pattern
cuts it, and running offsets lead every piece back to its pages. Only overlapping windows need a
kernel, and that sees word lengths alone, never text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions import text as tx

# ---- fixed values -----------------------------------------------------------------------------
STRATEGIES = ["fixed", "token", "overlap", "paragraph"]
DEFAULT_TOKENS = 512
DEFAULT_CHARS = 2048
DEFAULT_OVERLAP = 128
MIN_TOKENS = 16
MAX_TOKENS = 4096
CHARS_PER_TOKEN = 4
# -----------------------------------------------------------------------------------------------

def _spans(starts: Column, total: Column) -> Column:
    """Turn 0-based start positions into (start, count) spans over ``total`` units."""
    return F.transform(
        starts,
        lambda s, i: F.struct(
            s.cast("int").alias("s"),
            (F.coalesce(F.get(starts, i + 1), total) - s).cast("int").alias("n"),
        ),
    )


def greedy_spans(lengths: Column, budget_chars: int, sep: int = 1, sealed: Column | None = None) -> Column:
    """Greedy packing as a fold holding only a running length and the starts found so far.

    A unit opens a new span when joining it would pass the budget; a unit too long by itself stays
    alone. ``sealed`` flags (aligned with ``lengths``) force a unit to stand alone.
    """
    units = (
        F.transform(lengths, lambda x: F.struct(x.alias("len"), F.lit(False).alias("solo")))
        if sealed is None
        else F.zip_with(lengths, sealed, lambda x, z: F.struct(x.alias("len"), z.alias("solo")))
    )
    zero = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).cast("bigint").alias("len"),
        F.lit(False).alias("solo"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, u: Column) -> Column:
        opens = (acc.i == 0) | acc.solo | u.solo | (acc.len + sep + u.len > budget_chars)
        return F.struct(
            (acc.i + 1).alias("i"),
            F.when(opens, u.len.cast("bigint")).otherwise(acc.len + sep + u.len).alias("len"),
            u.solo.alias("solo"),
            F.when(opens, F.concat(acc.starts, F.array(acc.i))).otherwise(acc.starts).alias("starts"),
        )

    return F.aggregate(units, zero, step, lambda acc: acc.starts)


def window_spans(lengths: np.ndarray, budget_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """Overlapping windows as (offset, length) in characters of the blank-joined words.

    Prefix sums and binary search: linear in words plus windows.
    """
    total = len(lengths)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)  # joined length of words 0..i, plus one
    begins = ends - lengths - 1
    spans: list[tuple[int, int]] = []
    start = 0
    while start < total:
        stop = int(np.searchsorted(ends, begins[start] + budget_chars + 1, side="right"))
        stop = max(stop, start + 1)
        spans.append((int(begins[start]), int(ends[stop - 1] - 1 - begins[start])))
        if stop >= total:
            break
        if overlap_chars <= 0:
            start = stop
            continue
        # first word whose tail up to the window end still fits; the last word always counts
        tail = int(np.searchsorted(begins, ends[stop - 1] - 1 - overlap_chars, side="left"))
        start = max(min(tail, stop - 1), start + 1)
    return spans


def _window_udf(budget_chars: int, overlap_chars: int):
    """Spans as one flat array [offset, length, offset, length, ...]."""

    def cut(lengths: pd.Series) -> pd.Series:
        spans = (window_spans(np.asarray(x, dtype=np.int64), budget_chars, overlap_chars) for x in lengths)
        return pd.Series([np.array(s, dtype=np.int32).ravel() for s in spans], dtype=object)

    return F.pandas_udf(cut, "array<int>")


def packed(text: Column, budget_chars: int) -> Column:
    """Longest runs of whole words within the budget; an over-long word stands alone.

    ``text`` holds words separated by single blanks.
    """
    pattern = rf"(?s)([^ ].{{0,{budget_chars - 1}}}|[^ ]+)(?: |$)"
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _offsets(texts: Column) -> Column:
    """Start of each text in the blank-joined whole."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("seen"))
    return F.aggregate(
        texts,
        zero,
        lambda acc, t: F.struct(
            (acc.at + F.length(t) + 1).alias("at"), F.concat(acc.seen, F.array(acc.at)).alias("seen")
        ),
        lambda acc: acc.seen,
    )


def _paragraph_units(pages: Column, budget_chars: int) -> Column:
    """Paragraphs of all pages; one over budget is cut at words into pieces that stand alone."""

    def pieces(text: Column, o: Column) -> Column:
        unit = lambda t, solo: F.struct(t.alias("text"), o.alias("o"), F.lit(solo).alias("solo"))
        cut = F.transform(packed(tx.fold_ws(text), budget_chars), lambda t: unit(t, True))
        return F.when(F.length(text) > budget_chars, cut).otherwise(F.array(unit(text, False)))

    per_page = F.transform(
        pages,
        lambda p, o: F.flatten(F.transform(tx.split_paragraphs(p.content), lambda t: pieces(t, o))),
    )
    return F.flatten(per_page)


def validate(strategy: str, tokens: int | None, chars: int | None, overlap: int | None) -> tuple[int, int, int]:
    """Resolve defaults, clamp token budgets, and refuse impossible settings."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; choose from {STRATEGIES}")
    budget = min(max(tokens or DEFAULT_TOKENS, MIN_TOKENS), MAX_TOKENS)
    size = chars or DEFAULT_CHARS
    tail = DEFAULT_OVERLAP if overlap is None else overlap
    if strategy == "fixed" and size < 1:
        raise ValueError("chunk_chars must be >= 1")
    if strategy == "overlap" and not 0 <= tail < budget:
        raise ValueError("overlap_tokens must be >= 0 and below chunk_tokens")
    return budget, size, tail


def _outlines(pages: Column) -> Column:
    """Pages without their texts: every chunk's row gets a copy of them."""
    return F.transform(pages, lambda p: F.struct(
        p.page_number.alias("page_number"), p.section.alias("section"), p.source.alias("source"),
    ))


def _cut_paragraphs(rows: DataFrame, keep: list[str], budget: int) -> DataFrame:
    units = tx.seal(_paragraph_units(F.col("pages"), budget)).alias("_units")
    rows = rows.select(*keep, _outlines(F.col("pages")).alias("pages"), units)
    lengths = F.transform("_units", lambda u: F.length(u.text))
    starts = greedy_spans(lengths, budget, 2, F.transform("_units", lambda u: u.solo))
    rows = rows.select("*", tx.seal(starts).alias("_starts"))

    def piece(span: Column) -> Column:
        return tx.let(F.slice("_units", span.s + 1, span.n), lambda part: F.struct(
            tx.trim_ws(F.array_join(F.transform(part, lambda u: u.text), "\n\n")).alias("content"),
            F.element_at(part, 1).o.alias("first"), F.element_at(part, -1).o.alias("last"),
        ))

    spans = _spans(F.col("_starts"), F.size("_units"))
    rows = rows.select(*keep, "pages", tx.seal(F.transform(spans, piece)).alias("_cuts"))
    cut = rows.select(*keep, "pages", F.posexplode("_cuts").alias("chunk_index", "_cut"))
    return cut.select(
        *keep, "chunk_index", F.col("_cut.content").alias("content"),
        F.slice("pages", F.col("_cut.first") + 1, F.col("_cut.last") - F.col("_cut.first") + 1).alias("_pages"),
    )


def _cut_words(rows: DataFrame, keep: list[str], budget: int, overlap: int | None) -> DataFrame:
    texts = F.transform("pages", lambda p: tx.fold_ws(p.content))
    rows = rows.select(*keep, _outlines(F.col("pages")).alias("pages"), tx.seal(texts).alias("_texts"))
    rows = rows.select(*keep, "pages", "_texts", tx.seal(_offsets(F.col("_texts"))).alias("_page_at"))
    whole = F.array_join("_texts", " ").alias("_whole")
    if overlap is None:
        rows = rows.select(*keep, "pages", "_page_at", tx.seal(packed(whole, budget)).alias("_cuts"))
        rows = rows.select("*", _offsets(F.col("_cuts")).alias("_cut_at"))
        zipped = F.arrays_zip(F.col("_cuts").alias("text"), F.col("_cut_at").alias("at"))
        rows = rows.select(*keep, "pages", "_page_at", tx.seal(zipped).alias("_zipped"))
        cut = rows.select(*keep, "pages", "_page_at", F.posexplode("_zipped").alias("chunk_index", "_cut"))
    else:
        rows = rows.select(*keep, "pages", "_page_at", whole)
        lengths = F.transform(F.filter(F.split("_whole", " "), lambda w: w != ""), F.length)
        rows = rows.select(*keep, "pages", "_page_at", "_whole", _window_udf(budget, overlap)(lengths).alias("_flat"))
        at = F.when(F.size("_flat") > 0, F.sequence(F.lit(0), F.size("_flat") - 2, F.lit(2)))
        piece = lambda i: F.struct(
            F.col("_whole").substr(F.get("_flat", i) + 1, F.get("_flat", i + 1)).alias("text"),
            F.get("_flat", i).cast("bigint").alias("at"),
        )
        rows = rows.select(*keep, "pages", "_page_at", tx.seal(F.transform(at, piece)).alias("_cuts"))
        cut = rows.select(*keep, "pages", "_page_at", F.posexplode("_cuts").alias("chunk_index", "_cut"))
    page_no = lambda at: F.size(F.filter("_page_at", lambda s: s <= at))
    start = F.col("_cut.at")
    ranged = cut.select(
        *keep, "pages", "chunk_index", F.col("_cut.text").alias("content"),
        page_no(start).alias("_first"), page_no(start + F.length("_cut.text") - 1).alias("_last"),
    )
    return ranged.select(
        *keep, "chunk_index", "content",
        F.slice("pages", F.col("_first"), F.col("_last") - F.col("_first") + 1).alias("_pages"),
    )


def chunk_bundles(
    bundles: DataFrame,
    strategy: str = "paragraph",
    *,
    chunk_tokens: int | None = None,
    chunk_chars: int | None = None,
    overlap_tokens: int | None = None,
) -> DataFrame:
    """Chunk rows of every bundled document, contiguously indexed from zero."""
    tokens, chars, overlap = validate(strategy, chunk_tokens, chunk_chars, overlap_tokens)
    budget = chars if strategy == "fixed" else tokens * CHARS_PER_TOKEN
    keep = [c for c in bundles.columns if c not in ("pages", "truncated", "raw_pages")]
    rows = bundles.select(*keep, F.filter("pages", lambda p: tx.trim_ws(p.content) != "").alias("pages"))
    if strategy == "paragraph":
        placed = _cut_paragraphs(rows, keep, budget)
    else:
        placed = _cut_words(rows, keep, budget, None if strategy != "overlap" else overlap * CHARS_PER_TOKEN)
    sections = F.filter(F.transform("_pages", lambda p: p.section), lambda s: s.isNotNull() & (s != ""))
    page_start = F.element_at("_pages", 1).page_number
    return placed.select(
        *keep,
        "chunk_index",
        page_start.alias("page_number"),
        "content",
        tx.estimate_tokens(F.col("content")).alias("token_count"),
        F.lit(strategy).alias("strategy"),
        F.get(sections, F.lit(0)).alias("section"),
        F.element_at("_pages", 1).source.alias("source"),
        page_start.alias("page_start"),
        F.element_at("_pages", -1).page_number.alias("page_end"),
    )


def chunk_pages(pages: DataFrame, strategy: str = "paragraph", **budgets) -> DataFrame:
    """The same over a page table: one shuffle on the document, then as above."""
    from ragframe.operators.pages import bundle_pages

    return chunk_bundles(bundle_pages(pages), strategy, **budgets)


def unit_spans(sizes: list[int], alone: list[bool], budget_chars: int, sep: int) -> list[tuple[int, int]]:
    """Greedy packing of units as (first, last): one that would pass the budget, or stands alone, opens a new span."""
    spans: list[tuple[int, int]] = []
    length = 0
    for i, size in enumerate(sizes):
        if spans and not (alone[i] or alone[i - 1] or length + sep + size > budget_chars):
            spans[-1] = (spans[-1][0], i)
            length += sep + size
        else:
            spans.append((i, i))
            length = size
    return spans


def _shape(lengths: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, numbers: np.ndarray, repeated: int) -> dict:
    """Counts of a document's chunks of these lengths, from and to these pages."""
    tokens = np.maximum(1, -(-lengths // CHARS_PER_TOKEN))
    return {
        "chunks": len(lengths), "tokens": int(tokens.sum()), "max_tokens": int(tokens.max(initial=0)),
        "pages": int((numbers[lasts] - numbers[firsts] + 1).sum()), "repeated_chars": repeated,
    }


def document_shapes(
    words: np.ndarray, page_at: np.ndarray, numbers: np.ndarray, para_page: np.ndarray, para_size: np.ndarray,
    para_words: list[np.ndarray], settings: list[tuple[str, int, int]],
) -> list[dict]:
    """Shapes of one document's chunks for every (strategy, budget, overlap) in characters, from lengths alone."""
    out = []
    for strategy, budget, overlap in settings:
        if strategy == "paragraph":
            units = [
                (size, page, alone)
                for page, whole, inside in zip(para_page, para_size, para_words, strict=True)
                for size, alone in ([(n, True) for _, n in window_spans(inside, budget, 0)] if whole > budget else [(int(whole), False)])
                for page in (page,)
            ]
            sizes = [u[0] for u in units]
            spans = unit_spans(sizes, [u[2] for u in units], budget, 2)
            lengths = np.array([sum(sizes[a : b + 1]) + 2 * (b - a) for a, b in spans], np.int64)
            at = np.array([[units[a][1], units[b][1]] for a, b in spans], np.int64).reshape(-1, 2)
            out.append(_shape(lengths, at[:, 0], at[:, 1], numbers, 0))
            continue
        spans = np.array(window_spans(words, budget, overlap), np.int64).reshape(-1, 2)
        start, length = spans[:, 0], spans[:, 1]
        place = lambda x: np.searchsorted(page_at, x, "right") - 1
        # Every word belongs to a chunk; what the chunks hold beyond the words is repeated.
        repeated = int((length + 1).sum() - (words + 1).sum())
        out.append(_shape(length, place(start), place(start + length - 1), numbers, repeated))
    return out


def chunking_report(bundles: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Chunks, tokens, page span and repeated tokens for each named configuration, from one pass over the documents.

    Python sees lengths of words and paragraphs, never text: the chunk boundaries of every budget follow from their
    prefix sums. ``redundant_tokens`` are the words (with their blanks) that stand in more than one chunk, each time
    after the first, in tokens.
    """
    settings = []
    for config in configs.values():
        strategy = config.get("strategy", "paragraph")
        tokens, chars, overlap = validate(strategy, config.get("chunk_tokens"), config.get("chunk_chars"), config.get("overlap_tokens"))
        budget = chars if strategy == "fixed" else tokens * CHARS_PER_TOKEN
        settings.append((strategy, budget, overlap * CHARS_PER_TOKEN if strategy == "overlap" else 0))
    rows = bundles.select(F.filter("pages", lambda p: tx.trim_ws(p.content) != "").alias("pages"))
    texts = F.transform("pages", lambda p: tx.fold_ws(p.content))
    rows = rows.select("pages", tx.seal(texts).alias("_texts"))
    paragraphs = F.flatten(F.transform(
        "pages", lambda p, o: F.transform(tx.split_paragraphs(p.content), lambda t: F.struct(o.alias("page"), t.alias("text")))
    ))
    rows = rows.select("pages", "_texts", tx.seal(paragraphs).alias("_paras"))
    sizes = lambda text: F.transform(F.filter(F.split(text, " "), lambda w: w != ""), F.length)
    measured = rows.select(
        F.flatten(F.transform("_texts", sizes)).alias("words"), _offsets(F.col("_texts")).alias("page_at"),
        F.transform("pages", lambda p: p.page_number).alias("numbers"), F.transform("_paras", lambda p: p.page).alias("para_page"),
        F.transform("_paras", lambda p: F.length(p.text)).alias("para_size"),
        F.transform("_paras", lambda p: sizes(tx.fold_ws(p.text))).alias("para_words"),
    )

    def shapes(words, page_at, numbers, para_page, para_size, para_words):
        whole = lambda x: np.asarray(x, dtype=np.int64)
        return pd.Series([
            document_shapes(whole(w), whole(at), whole(no), whole(pp), whole(ps), [whole(x) for x in pw], settings)
            for w, at, no, pp, ps, pw in zip(words, page_at, numbers, para_page, para_size, para_words, strict=True)
        ], dtype=object)

    fields = "chunks bigint, tokens bigint, max_tokens bigint, pages bigint, repeated_chars bigint"
    udf = F.pandas_udf(shapes, f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    done = measured.select(tx.seal(udf(*measured.columns)).alias("s"))
    sums = [
        f(F.col("s")[i][c]).alias(f"{c}{i}")
        for i in range(len(settings)) for c, f in (("chunks", F.sum), ("tokens", F.sum), ("max_tokens", F.max), ("pages", F.sum), ("repeated_chars", F.sum))
    ]
    wide = done.agg(*sums)
    lines = F.array(*[
        F.struct(
            F.lit(label).alias("config"), F.coalesce(f"chunks{i}", F.lit(0)).alias("chunks"), F.col(f"tokens{i}").alias("tokens"),
            F.nullif(f"max_tokens{i}", F.lit(0)).alias("max_tokens"),
            F.when(F.col(f"chunks{i}") > 0, F.col(f"pages{i}") / F.col(f"chunks{i}")).alias("mean_span"),
            F.ceil(F.coalesce(f"repeated_chars{i}", F.lit(0)) / CHARS_PER_TOKEN).alias("redundant_tokens"),
        )
        for i, label in enumerate(configs)
    ])
    return wide.select(F.explode(lines).alias("r")).select("r.*")
