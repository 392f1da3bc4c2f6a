"""Page assembly, outlines and sections.

A document is one row, so cutting it into pages is a projection: no shuffle, and a tenant that owns
a third of the corpus is spread over as many tasks as its files have splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import text as tx

PAGE_LINES = 8


def _heading_flags(lines: Column) -> Column:
    """Positions (0-based) and titles of heading-looking lines among ``lines``."""
    sentence_end = f"[{tx.SENTENCE_END}]$"
    hits = lambda lines: F.transform(
        lines,
        lambda line, i: F.when(
            (line != "")
            & (F.length(line) <= 60)
            & ~line.rlike(sentence_end)
            & F.coalesce(F.get(lines, i + 1), F.lit("")).rlike("^[A-Z]"),
            F.struct(i.alias("pos"), line.alias("title")),
        ),
    )
    return F.filter(tx.let(lines, hits), lambda h: h.isNotNull())


def document_bundles(
    documents: DataFrame, page_lines: int = PAGE_LINES, page_limit: int | None = None
) -> DataFrame:
    """Each document with its ordered ``pages`` array, built inside the row.

    Blank pages are dropped while numbering goes on. Whole documents are read; where a ``page_limit`` is
    asked for, pages past it are cut off and the document is flagged ``truncated``. ``section`` is the last heading at or before the page.
    """
    keep = [c for c in documents.columns if c != "text"]
    lines = documents.select(*keep, F.split("text", "\n").alias("_lines"))
    counted = lines.select(
        "*",
        F.ceil(F.size("_lines") / page_lines).cast("int").alias("_n"),
        tx.seal(F.transform(
            _heading_flags(F.transform("_lines", tx.trim_ws)),
            lambda h: F.struct(
                (F.floor(h.pos / page_lines).cast("int") + 1).alias("page"), h.title.alias("title")
            ),
        )).alias("_outline"),
    )
    source = F.concat(
        F.lit("s3://"), "organization_id", F.lit("/"), F.col("document_id").cast("string")
    )

    def page(p: Column) -> Column:
        raw = F.array_join(F.slice("_lines", (p - 1) * page_lines + 1, page_lines), "\n")
        at_or_before = F.filter("_outline", lambda h: h.page <= p)
        return F.struct(
            p.alias("page_number"),
            tx.normalize_text(raw).alias("content"),
            F.try_element_at(at_or_before, F.lit(-1)).title.alias("section"),
            source.alias("source"),
        )

    last = F.col("_n") if page_limit is None else F.least("_n", F.lit(page_limit))
    numbered = F.transform(F.sequence(F.lit(1), last), page)
    return counted.select(
        *keep,
        tx.seal(F.filter(numbered, lambda p: p.content != "")).alias("pages"),
        (F.lit(False) if page_limit is None else F.col("_n") > page_limit).alias("truncated"),
        F.col("_n").alias("raw_pages"),
    )


def assemble_pages(documents: DataFrame, **limits: int) -> DataFrame:
    """Page rows of every document."""
    rows = document_bundles(documents, **limits).select(
        "document_id", "organization_id", F.explode("pages").alias("p")
    )
    return rows.select(
        "document_id",
        "organization_id",
        "p.page_number",
        "p.content",
        tx.estimate_tokens(F.col("p.content")).alias("token_count"),
        "p.section",
        "p.source",
    )


def bundle_pages(pages: DataFrame) -> DataFrame:
    """Gather a page table into one row a document: a group is one document's pages."""
    bad = F.raise_error(F.lit("page_number must be >= 1"))
    checked = pages.withColumn(
        "page_number", F.when(F.col("page_number") < 1, bad).otherwise(F.col("page_number"))
    )
    page = F.struct("page_number", "content", "section", "source")
    return checked.groupBy("document_id", "organization_id").agg(
        F.sort_array(F.collect_list(page)).alias("pages")
    )


def extraction_summary(documents: DataFrame, page_limit: int | None = None, **limits: int) -> DataFrame:
    """Pages, blank pages, tokens and flags per document; documents without pages stay in."""
    seen = F.col("raw_pages") if page_limit is None else F.least("raw_pages", F.lit(page_limit))
    sizes = F.transform("pages", lambda p: tx.estimate_tokens(p.content))
    return document_bundles(documents, page_limit=page_limit, **limits).select(
        "document_id",
        "raw_pages",
        F.size("pages").alias("pages"),
        (seen - F.size("pages")).alias("blank_pages"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total_tokens"),
        (F.size("pages") == 0).alias("empty"),
        "truncated",
    )


def text_outline(documents: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """Heading-looking lines as outline rows (document_id, page_number, ord, title)."""
    found = documents.select(
        "document_id", F.transform(F.split("text", "\n"), tx.trim_ws).alias("_lines")
    ).select("document_id", tx.seal(_heading_flags(F.col("_lines"))).alias("_h"))
    found = found.select("document_id", F.explode("_h").alias("h"))
    return found.select(
        "document_id",
        (F.floor(F.col("h.pos") / page_lines) + 1).cast("int").alias("page_number"),
        F.col("h.pos").alias("ord"),
        F.col("h.title").alias("title"),
    )


def html_outline(pages: DataFrame) -> DataFrame:
    """``<h1>``..``<h6>`` of raw web pages in document order, tags inside the title dropped."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    inner = F.regexp_replace("raw", r"<[^>]*>", " ")
    return rows.select(
        "page_id",
        "ord",
        F.regexp_extract("raw", r"(?i)^<h([1-6])", 1).cast("int").alias("level"),
        tx.fold_ws(inner).alias("title"),
    )


def section_fill(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """As-of join: each page takes the title of the last outline entry at or before it.

    One union and one window per document, so pages are never paired with outline entries.
    """
    marks = outline.select(
        "document_id", "page_number", F.lit(0).alias("kind"), F.col("ord").cast("int").alias("ord"), "title"
    )
    rows = pages.select(
        "document_id", "page_number", F.lit(1).alias("kind"), F.lit(0).alias("ord"),
        F.lit(None).cast("string").alias("title"),
    )
    w = Window.partitionBy("document_id").orderBy("page_number", "kind", "ord")
    filled = marks.unionByName(rows).withColumn("section", F.last("title", ignorenulls=True).over(w))
    return filled.filter(F.col("kind") == 1).select("document_id", "page_number", "section")
