"""Registered queries: each runs one operator over whole given tables.

Derived inputs (file names, statuses, prompts, replies) are computed from the tables by Spark. Every
callable takes (spark, table folder) and returns a DataFrame of scalar columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import text as tx
from ragframe.functions import vectors as vx
from ragframe.operators import (
    ann, answering, catalog, chunking, conversations, embedding, evaluation, ledger, pages, retrieval, telemetry,
)
from ragframe.plans import flows
from ragframe.session import checkpoint_dir, cut_lineage, pin_session, stored
from ragframe.sources import files, sinks, tables
from ragframe.streaming import jobs as streams
from ragframe.streaming import timed_ledger

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
AS_OF = "timestamp'2024-02-01 00:00:00'"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fn(pin_session(spark), root)

    REGISTRY[fn.__name__] = run
    return fn


# ---- shared inputs ------------------------------------------------------------------------------


def _docs(spark, root) -> DataFrame:
    return tables.spread(tables.corpus_documents(spark, root), "document_id")


def _bundles(spark, root) -> DataFrame:
    return pages.document_bundles(_docs(spark, root))


def _chunks(spark, root, strategy="fixed", **budgets) -> DataFrame:
    return chunking.chunk_bundles(_bundles(spark, root), strategy, **budgets)


def _embedded(spark, root, **budgets) -> DataFrame:
    return embedding.hash_embed_batches(_chunks(spark, root, **budgets))


def _questions(spark, root) -> DataFrame:
    return tables.questions(spark, root).withColumnRenamed("question_id", "query_id")


def _scoped_questions(spark, root) -> DataFrame:
    """Every question is asked by one tenant and owner."""
    q = _questions(spark, root)
    return q.select(
        "*",
        F.concat(F.lit("src"), F.col("query_id") % 20).alias("organization_id"),
        F.concat(F.lit("u"), F.col("query_id") % 3).alias("uploaded_by"),
    )


def _vectors(spark, root) -> DataFrame:
    return tables.scan(spark, root, "embeddings").select(
        "vec_id", "label", vx.quantize(F.col("embedding")).alias("q")
    )


def _hits(spark, root, k=retrieval.DEFAULT_K, floor=None) -> DataFrame:
    return retrieval.search(_questions(spark, root), _embedded(spark, root), k, floor, ("model",))


def _contexts(spark, root, max_tokens=answering.CONTEXT_TOKENS, k=retrieval.DEFAULT_K) -> DataFrame:
    """Chunks are searched and then read for their texts: cut and embedded once, as a written table."""
    c = stored(_embedded(spark, root), "chunks")
    return answering.gather_context(retrieval.search(_questions(spark, root), c, k, None, ("model",)), c, max_tokens)


def _answers(spark, root, min_score=None) -> DataFrame:
    return answering.extractive_answers(_questions(spark, root), _contexts(spark, root), min_score)


# ---- sources and sinks --------------------------------------------------------------------------


@query
def scan_documents(spark, root):
    return tables.corpus_documents(spark, root).select(
        "document_id", "organization_id", "uploaded_by", "title", "filename", "source_type", "size", "status",
        "embedding_status", F.unix_seconds("created_at").alias("created_s"),
    )


@query
def admit_files(spark, root):
    d = _docs(spark, root)
    i = F.col("document_id")
    head = (
        F.when((F.col("source_type") == "pdf") & (i % 2 == 0), "%PDF-1.7 ")
        .when((F.col("source_type") == "docx") & (i % 3 == 0), "PK\x03\x04")
        .when(i % 7 == 0, "a\x00b")
        .otherwise("")
    )
    name = F.concat(F.lit("C:\\up/"), F.when(i % 13 == 0, F.lit("...")).otherwise(F.concat(F.lit(".."), "filename")),
                    F.when(i % 17 == 0, F.lit(".exe")).otherwise(F.lit("")))
    raw = d.select("document_id", name.alias("filename"), F.encode(F.concat(head, "text"), "UTF-8").alias("content"))
    out = files.admit(raw.withColumn("length", F.octet_length("content")), max_bytes=20_000)
    return out.select("document_id", "filename", "title", "source_type", "mime_type", "error")


def _vector_rows(spark, root, statuses: list[str], version: int) -> DataFrame:
    return tables.corpus_documents(spark, root).filter(F.col("embedding_status").isin(*statuses)).select(
        "document_id", F.lit(embedding.HASH_MODEL).alias("model"), F.lit(version).alias("version"),
        (F.length("text") * version).cast("bigint").alias("payload"),
    )


@query
def upsert_embeddings(spark, root):
    old = _vector_rows(spark, root, ["ready", "processing"], 1)
    new = _vector_rows(spark, root, ["processing", "failed"], 2)
    return sinks.upsert(old, new, ["document_id", "model"])


@query
def upsert_repeated_embeddings(spark, root):
    """Vectors delivered in several versions at once: the newest counts."""
    old = _vector_rows(spark, root, ["ready", "processing"], 1)
    new = _vector_rows(spark, root, ["processing", "failed"], 2).unionByName(_vector_rows(spark, root, ["failed"], 3))
    return sinks.upsert(old, new, ["document_id", "model"], F.col("version"))


@query
def scan_raw_files(spark, root):
    """Stored text objects of every tenant, read back as bytes."""
    path = _scratch(spark, "objects")
    _docs(spark, root).select("organization_id", "text").write.partitionBy("organization_id").text(path)
    tenant = F.regexp_extract("organization_id", "=(.*)$", 1).alias("organization_id")
    return files.scan_files(spark, path, "*.txt").groupBy(tenant).agg(F.sum("length").alias("bytes"))


@query
def report_round_trip(spark, root):
    path = _scratch(spark, "report")
    kinds = tables.corpus_documents(spark, root).groupBy("organization_id", "source_type")
    sinks.write_report(kinds.agg(F.count("*").alias("documents"), F.sum("size").alias("size")), path)
    return sinks.read_report(spark, path, "organization_id string, source_type string, documents bigint, size bigint")


@query
def ensure_jobs(spark, root):
    d = tables.corpus_documents(spark, root)
    kinds = F.explode(F.array(F.lit("process"), F.lit("embed"))).alias("kind")
    known = d.select("document_id", kinds)
    unknown = d.select((-F.col("document_id") - 1).alias("document_id"), kinds)
    again = known.unionByName(known).unionByName(unknown)
    return sinks.insert_missing(again, tables.jobs(spark, root), ["document_id", "kind"], d, "document_id")


@query
def publishable_documents(spark, root):
    ok = (F.size(tx.tokenize(F.col("content"))) > 0) & (F.col("token_count") <= 510)
    return sinks.publishable(_chunks(spark, root), "document_id", ok, _docs(spark, root))


def _children(spark, root) -> dict[str, DataFrame]:
    return {
        "document_pages": pages.assemble_pages(_docs(spark, root)).select("document_id"),
        "chunks": _chunks(spark, root).select("document_id"),
        "ingestion_jobs": tables.jobs(spark, root).select("document_id"),
    }


@query
def cascade_delete(spark, root):
    d = _docs(spark, root).select("document_id", "status")
    kept = sinks.cascade_delete(d, _children(spark, root), d.filter(F.col("status") == "failed"))
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("child"), "rows") for n, df in kept.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def orphan_audit(spark, root):
    live = _docs(spark, root).select("document_id", "status").filter(F.col("status") != "failed")
    return sinks.orphan_audit(live, _children(spark, root))


# ---- text ---------------------------------------------------------------------------------------


@query
def normalize_text(spark, root):
    return _docs(spark, root).select("document_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query
def estimate_tokens(spark, root):
    return _docs(spark, root).select(
        "document_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.estimate_words(F.col("text")).alias("word_tokens")
    )


@query
def assemble_pages(spark, root):
    return pages.assemble_pages(_docs(spark, root)).select(
        "document_id", "page_number", "content", "token_count", "section", "source"
    )


@query
def extraction_summary(spark, root):
    return pages.extraction_summary(_docs(spark, root))


@query
def section_fill(spark, root):
    d = _docs(spark, root)
    return pages.section_fill(pages.assemble_pages(d), pages.text_outline(d))


@query
def html_outline(spark, root):
    return pages.html_outline(tables.spread(tables.scan(spark, root, "pages"), "page_id"))


@query
def split_paragraphs(spark, root):
    rows = pages.assemble_pages(_docs(spark, root))
    return rows.select(
        "document_id", "page_number", F.posexplode(tx.split_paragraphs(F.col("content"))).alias("pos", "paragraph")
    )


@query
def sentences(spark, root):
    return _docs(spark, root).select("document_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def tokenize(spark, root):
    t = tx.tokenize(F.col("text"))
    return _docs(spark, root).select("document_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@query
def content_tokens(spark, root):
    return _docs(spark, root).select(
        "document_id",
        F.array_join(F.sort_array(tx.content_tokens(F.col("text"))), " ").alias("tokens"),
        F.array_join(F.sort_array(tx.eval_content_tokens(F.col("text"))), " ").alias("eval_tokens"),
    )


@query
def slugify(spark, root):
    return _docs(spark, root).select("document_id", tx.slugify(F.col("text")).alias("slug"))


@query
def sanitize_filename(spark, root):
    i = F.col("document_id")
    raw = F.concat(F.lit("..\\x/"), F.col("organization_id"), F.lit("\\"), F.repeat(F.lit("."), (i % 3).cast("int")),
                   F.lit(" no\x07te "), i.cast("string"), F.lit(".Tar."), F.upper("source_type"))
    safe = tx.sanitize_filename(raw)
    return _docs(spark, root).select(
        "document_id", safe.alias("safe"), tx.extension(safe).alias("extension"), tx.title_from_filename(safe).alias("title")
    )


@query
def normalize_route(spark, root):
    r = tables.requests(spark, root)
    h = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    path = (
        F.when(F.col("event_id") % 5 == 0, F.lit(""))
        .when(F.col("event_id") % 5 == 1, F.concat("path", F.lit("/pages/"), h))
        .when(F.col("event_id") % 5 == 2, F.concat("path", F.lit("/"), uuid, F.lit("/chunks")))
        .when(F.col("event_id") % 5 == 3, F.concat("path", F.lit("/x"), h))
        .otherwise(F.col("path"))
    )
    return r.groupBy(tx.normalize_route(path).alias("route")).agg(F.count("*").alias("requests"))


# ---- chunking -----------------------------------------------------------------------------------

CHUNK_COLUMNS = ["document_id", "chunk_index", "page_number", "content", "token_count", "section", "page_start", "page_end"]


@query
def chunk_fixed(spark, root):
    return _chunks(spark, root, "fixed", chunk_chars=512).select(*CHUNK_COLUMNS)


@query
def chunk_token(spark, root):
    return _chunks(spark, root, "token", chunk_tokens=512).select(*CHUNK_COLUMNS)


@query
def chunk_overlap(spark, root):
    return _chunks(spark, root, "overlap", chunk_tokens=512, overlap_tokens=128).select(*CHUNK_COLUMNS)


@query
def chunk_paragraph(spark, root):
    return _chunks(spark, root, "paragraph", chunk_tokens=128).select(*CHUNK_COLUMNS)


# ---- fixed values: the chunk settings that the evaluation compares ------------------------------
CHUNK_CONFIGS = {
    "paragraph 512": {"strategy": "paragraph", "chunk_tokens": 512},
    "paragraph 256": {"strategy": "paragraph", "chunk_tokens": 256},
    "paragraph 128": {"strategy": "paragraph", "chunk_tokens": 128},
    "token 256": {"strategy": "token", "chunk_tokens": 256},
    "token 128": {"strategy": "token", "chunk_tokens": 128},
    "token 64": {"strategy": "token", "chunk_tokens": 64},
    "overlap 256/128": {"strategy": "overlap", "chunk_tokens": 256, "overlap_tokens": 128},
    "overlap 256/32": {"strategy": "overlap", "chunk_tokens": 256, "overlap_tokens": 32},
    "overlap 128/32": {"strategy": "overlap", "chunk_tokens": 128, "overlap_tokens": 32},
    "fixed 512 chars": {"strategy": "fixed", "chunk_chars": 512},
    "fixed 1024 chars": {"strategy": "fixed", "chunk_chars": 1024},
}
# -------------------------------------------------------------------------------------------------


@query
def chunking_report(spark, root):
    report = chunking.chunking_report(_bundles(spark, root), {**CHUNK_CONFIGS, "token 512": {"strategy": "token", "chunk_tokens": 512}})
    return report.withColumn("mean_span", F.round("mean_span", 6))


# ---- embedding ----------------------------------------------------------------------------------


@query
def hash_embed_sparse(spark, root):
    rows = _embedded(spark, root).select("document_id", "chunk_index", F.explode("vector").alias("x"))
    return rows.select("document_id", "chunk_index", "x.slot", "x.q")


def _checksum(dense) -> F.Column:
    at = F.transform(dense, lambda v, i: F.round(v * vx.SCALE).cast("bigint") * (i + 1))
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query
def hash_embed_dense(spark, root):
    dense = vx.to_dense(F.col("vector"))
    rows = _embedded(spark, root).select("document_id", "chunk_index", dense.alias("d"))
    return rows.select("document_id", "chunk_index", F.size("d").alias("dimensions"), _checksum(F.col("d")).alias("checksum"))


def trigram_model(texts: Sequence[str]) -> np.ndarray:
    """A model foreign to the engine: counts of hashed character trigrams, all texts of a slice at once."""
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64) for t in texts]
    slots = [(c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 256 for c in points]
    return np.stack([np.bincount(s, minlength=256) for s in slots]).astype(float)


@query
def score_in_batches(spark, root):
    rows = _chunks(spark, root).select("document_id", "chunk_index", "content")
    scored = embedding.score_in_batches(rows, trigram_model)
    weighed = F.transform("vector", lambda v, i: v.cast("bigint") * (i + 1))
    return scored.select(
        "document_id", "chunk_index", F.size("vector").alias("dimensions"),
        F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"),
    )


@query
def validate_vectors(spark, root):
    v = tables.scan(spark, root, "embeddings")
    # every seventh row of a label is damaged in one of four ways
    i = F.col("vec_id")
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = (
        F.when(i % 28 == 0, F.slice(x, 1, 63))
        .when(i % 28 == 7, F.transform(x, lambda e, n: F.when(n == 3, F.lit(float("nan"))).otherwise(e)))
        .when(i % 28 == 14, F.transform(x, lambda e: F.lit(0.0)))
        .when(i % 28 == 21, F.array().cast("array<double>"))
        .otherwise(x)
    )
    owner = F.concat("label", F.lit("/"), i % 7)
    return embedding.validate_vectors(v.select(owner.alias("owner"), bad.alias("v")), "owner", "v", 64)


@query
def vector_integrity(spark, root):
    copies = embedding.repeated_vectors(_embedded(spark, root), "vector")
    return copies.groupBy("copies").agg(F.count("*").alias("groups"))


@query
def vector_drift(spark, root):
    """Stored vectors, some of them damaged, beside those of their text embedded again."""
    rows = _embedded(spark, root).select("document_id", "chunk_index", "content", "vector")
    moved = F.transform("vector", lambda x, i: F.struct(x.slot.alias("slot"), (x.q + F.when(i == 0, 500_000).otherwise(0)).alias("q")))
    stored = rows.withColumn("vector", F.when(F.col("document_id") % 50 == 7, moved).otherwise(F.col("vector")))
    path = _scratch(spark, "stored")
    stored.write.parquet(path)
    found = embedding.vector_drift(spark.read.parquet(path), "content", "vector")
    return found.select("document_id", "chunk_index", F.round("distance", 6).alias("distance"), "drifted")


@query
def idf(spark, root):
    return embedding.vocabulary(_docs(spark, root), "text").select("token", "df", "n", "idf_q")


@query
def tfidf(spark, root):
    d = _docs(spark, root)
    return embedding.term_weights(d, "document_id", "text", embedding.vocabulary(d, "text"))


@query
def l2_normalize(spark, root):
    v = tables.scan(spark, root, "embeddings")
    doubled = F.transform("embedding", lambda e: e.cast("double") * (F.col("label") + 1))
    rows = v.select("vec_id", vx.l2_normalize(doubled).alias("u"))
    return rows.select("vec_id", F.posexplode("u").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


# ---- retrieval ----------------------------------------------------------------------------------


@query
def retrievable_chunks(spark, root):
    c = _chunks(spark, root).select("document_id", "chunk_index", "token_count")
    return retrieval.retrievable(c, tables.corpus_documents(spark, root)).select(
        "document_id", "chunk_index", "token_count", "organization_id", "uploaded_by", "source_type"
    )


@query
def metadata_filter(spark, root):
    r = tables.requests(spark, root)
    return r.filter(retrieval.metadata_contains(F.col("props"), {"k": 69})).select("event_id", "client", "props")


@query
def similarity_floor(spark, root):
    return _hits(spark, root, 20, 0.4)


@query
def topk_cosine(spark, root):
    items = retrieval.dense_items(_vectors(spark, root), "vec_id", "q")
    hits = retrieval.topk(retrieval.as_queries(items), items, 5)
    return hits.select("query_id", "rank", F.col("item_id").alias("vec_id"), F.round("score", 6).alias("similarity"))


@query
def topk_sparse(spark, root):
    return _hits(spark, root)


@query
def scoped_search(spark, root):
    ready = retrieval.retrievable(
        _embedded(spark, root), tables.corpus_documents(spark, root)
    ).filter(F.col("source_type").isin("pdf", "md", "txt"))
    return retrieval.search(_scoped_questions(spark, root), ready)


@query
def tenant_audit(spark, root):
    q = _scoped_questions(spark, root)
    ready = retrieval.retrievable(_embedded(spark, root), tables.corpus_documents(spark, root))
    asked = q.select(
        "query_id", F.col("organization_id").alias("query_organization"), F.col("uploaded_by").alias("query_owner")
    )
    found = retrieval.search(q, ready).join(asked, "query_id")
    return catalog.tenant_audit(found, tables.corpus_documents(spark, root))


@query
def vector_distances(spark, root):
    v = _vectors(spark, root)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q").alias("p"))
    pair = v.join(nxt, "vec_id")
    q, p = F.col("q"), F.col("p")
    return pair.select(
        "vec_id", vx.dot(q, p).alias("dot"), F.round(vx.cosine(q, p), 6).alias("cosine"),
        F.round(vx.euclidean(q, p), 6).alias("euclidean"),
    )


@query
def tfidf_topk(spark, root):
    return retrieval.tfidf_topk(_questions(spark, root), _docs(spark, root), "document_id", "text", 3, "cosine")


@query
def tfidf_euclidean(spark, root):
    return retrieval.tfidf_topk(_questions(spark, root), _docs(spark, root), "document_id", "text", 3, "euclidean")


SEARCHED = "vec_id % 20 = 0"


def _ann(spark, root) -> DataFrame:
    v = _vectors(spark, root)
    path = _scratch(spark, "cells")
    ann.write_cells(v, "q", path, dimensions=64)
    return ann.stored_topk(spark.read.parquet(path), v.filter(SEARCHED), "vec_id", "q", dimensions=64)


@query
def ann_topk(spark, root):
    found = _ann(spark, root)
    return found.select("query_id", "rank", F.col("item_id").alias("vec_id"), F.round("score", 6).alias("similarity"))


@query
def ann_recall(spark, root):
    items = retrieval.dense_items(_vectors(spark, root), "vec_id", "q")
    asked = retrieval.dense_items(_vectors(spark, root).filter(SEARCHED), "vec_id", "q")
    return ann.recall(_ann(spark, root), retrieval.topk(retrieval.as_queries(asked), items, 5))


@query
def filtered_search(spark, root):
    """One search under tenant, owner, source type, chunk metadata and floor together."""
    rows = _embedded(spark, root).withColumn("metadata", F.to_json(F.struct(F.col("page_start").alias("page"), F.lit("fixed").alias("strategy"))))
    return retrieval.filtered_search(
        _scoped_questions(spark, root), rows, tables.corpus_documents(spark, root), source_type="md",
        metadata={"page": 1, "strategy": "fixed"}, floor=0.1, k=10,
    )


@query
def title_search(spark, root):
    found = retrieval.title_search(tables.corpus_documents(spark, root), "NOTE-1")
    return found.select("document_id", "title", "filename")


# ---- answering ----------------------------------------------------------------------------------


@query
def overlap_ratio(spark, root):
    """How much of each golden's wording its document's best and first pages would carry."""
    g = tables.goldens(spark, root).select("item_id", "expected_answer", F.col("expected_document").alias("document_id"))
    p = pages.assemble_pages(_docs(spark, root)).select("document_id", "page_number", "content")
    ratio = tx.overlap_ratio(tx.content_tokens(F.col("expected_answer")), tx.content_tokens(F.col("content")))
    return g.join(p, "document_id").select("item_id", "document_id", "page_number", F.round(ratio, 6).alias("overlap"))


@query
def context_budget(spark, root):
    rows = _contexts(spark, root, 800, 20).select("query_id", F.explode("context").alias("c"))
    return rows.select("query_id", "c.pos", "c.document_id", "c.chunk_index", tx.estimate_tokens(F.col("c.text")).alias("tokens"))


@query
def refusals(spark, root):
    return _answers(spark, root, 0.5).select("query_id", "refused", "reason")


@query
def extractive_answers(spark, root):
    return _answers(spark, root).select(
        "query_id", "answer", "refused", F.round("overlap", 6).alias("overlap"), "evidence_index", "citation",
        "document_id", "chunk_index", "page", "similarity",
    )


@query
def parse_citations(spark, root):
    t = F.col("turn").cast("string")
    text = F.concat("text", F.lit(" ["), t, F.lit("] [0] [x] ["), (F.col("turn") % 3).cast("string"), F.lit("][12] ["), t, F.lit("]"))
    return tables.scan(spark, root, "conversations").select(
        "conv_id", "turn", F.array_join(tx.citation_ids(text).cast("array<string>"), ",").alias("citations")
    )


@query
def resolve_citations(spark, root):
    """The answers' own marks plus marks that point nowhere."""
    a = _answers(spark, root).withColumn("answer", F.concat("answer", F.lit(" [2] [99] [1]")))
    return answering.resolve_citations(a).select("query_id", "ord", "citation", "document_id", "chunk_index", "page")


@query
def render_context(spark, root):
    return _contexts(spark, root).select("query_id", answering.render_context(F.col("context")).alias("rendered"))


@query
def render_history(spark, root):
    h = conversations.history_window(tables.messages(spark, root), 4, 200)
    return h.select("conversation_id", "position", answering.render_history(F.col("history")).alias("rendered"))


@query
def prompt_table(spark, root):
    p = answering.prompt_table(_questions(spark, root), _contexts(spark, root))
    return p.select("query_id", F.posexplode("messages").alias("pos", "m")).select("query_id", "pos", "m.role", "m.content")


@query
def generate_answers(spark, root):
    p = answering.prompt_table(_questions(spark, root), _contexts(spark, root))
    return answering.generate_answers(p).select("query_id", "answer", "refused", "prompt_words", "completion_words")


@query
def post_check(spark, root):
    c = tables.scan(spark, root, "conversations").filter(F.col("role") == "assistant")
    i = F.col("conv_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit(" I  don't\nKNOW about "), "text")).when(
        i % 4 == 1, F.concat(F.lit("I do not know. "), "text")
    ).when(i % 4 == 2, F.concat("text", F.lit(" [2]"))).otherwise(F.col("text"))
    rows = c.select("conv_id", "turn", reply.alias("reply"))
    return answering.post_check(rows, "reply", F.lit(True)).select("conv_id", "turn", "refused", "answer")


@query
def answer_usage(spark, root):
    return answering.answer_usage(_answers(spark, root))


# ---- conversations ------------------------------------------------------------------------------


@query
def referential_turns(spark, root):
    return conversations.referential_turns(tables.messages(spark, root))


@query
def expand_followups(spark, root):
    return conversations.expand_followups(tables.messages(spark, root))


@query
def history_window(spark, root):
    h = conversations.history_window(tables.messages(spark, root), 5, 150)
    kept = F.transform("history", lambda t: F.concat(t.position.cast("string"), F.lit(":"), t.role))
    return h.select("conversation_id", "position", F.array_join(kept, ",").alias("kept"))


@query
def conversation_answers(spark, root):
    """User turns answered from the corpus, follow-ups expanded by what the conversation remembers."""
    chunks = stored(flows.embedded_chunks(_docs(spark, root), "fixed"), "chunks")
    a = flows.converse(tables.messages(spark, root), chunks)
    return a.select("conversation_id", "position", "query", "document_id", "chunk_index", "similarity", "answer", "refused")


@query
def turn_pairs(spark, root):
    return conversations.turn_pairs(tables.messages(spark, root))


@query
def conversation_list(spark, root):
    return conversations.conversation_list(tables.messages(spark, root), limit=25, offset=10)


@query
def transcripts(spark, root):
    return conversations.transcripts(tables.messages(spark, root))


# ---- library ------------------------------------------------------------------------------------


@query
def document_list(spark, root):
    page = catalog.document_list(
        tables.corpus_documents(spark, root), status="ready", embedding_status="ready", query="NOTE", limit=50, offset=25
    )
    return page.select("document_id", "title", "filename", "source_type", "matching_total", "has_more")


@query
def document_status(spark, root):
    d = _docs(spark, root)
    ready = d.filter(F.col("status") == "ready")
    p = pages.assemble_pages(ready)
    c = stored(chunking.chunk_bundles(pages.document_bundles(ready), "fixed").select("document_id", "embedding_status"), "chunks")
    return catalog.document_status(d, p, c, c.filter(F.col("embedding_status") == "ready"))


@query
def ingestion_state(spark, root):
    return ledger.ingestion_state(tables.corpus_documents(spark, root), tables.jobs(spark, root))


@query
def source_view(spark, root):
    d = _docs(spark, root)
    return catalog.source_view(d, pages.assemble_pages(d)).select(
        "document_id", "title", "filename", "source_type", "mime_type", "size", "status", "page_count"
    )


@query
def member_report(spark, root):
    return catalog.member_report(tables.members(spark, root), "admin")


@query
def expiry_report(spark, root):
    """Each member's sign-in token (a week from last use) and invitation (two weeks), at a fixed time."""
    m = tables.members(spark, root)
    as_of = F.expr("timestamp'2024-01-08 00:00:00'")
    week = lambda n: F.col("last_seen_at") + F.expr(f"interval {7 * n} days")
    revoked = F.when(F.col("role") == "viewer", F.col("last_seen_at"))
    status = F.when(F.col("role") == "owner", "accepted").otherwise("pending")
    return m.select(
        "user_id", catalog.live_token(revoked, week(1), as_of).alias("token_live"),
        catalog.invitation_status(status, F.col("last_seen_at") + F.expr("interval 448 minutes") + F.expr("interval 6 days"), as_of).alias("invitation"),
    )


@query
def duplicate_invitations(spark, root):
    """Uploads read as invitations: pending while the document is not ready."""
    d = tables.corpus_documents(spark, root).select(
        "organization_id", F.concat(F.upper("uploaded_by"), F.lit("@example.org")).alias("email"),
        F.when(F.col("status") == "ready", "accepted").otherwise("pending").alias("status"),
    )
    return catalog.duplicate_pending(d)


@query
def multi_tenant_emails(spark, root):
    return catalog.multi_tenant_emails(tables.members(spark, root))


@query
def child_tenant_audit(spark, root):
    return catalog.child_tenant_audit(_chunks(spark, root), tables.corpus_documents(spark, root))


# ---- evaluation ---------------------------------------------------------------------------------


def _study_queries(spark, root) -> DataFrame:
    return _questions(spark, root).select(F.lit("").alias("scope"), "query_id", "question", F.col("question").alias("gold"))


def _study_chunks(spark, root, **config) -> DataFrame:
    """Embedded chunks feed several scored passes: one written table, of which each pass reads its own columns."""
    return stored(_embedded(spark, root, **config), "study").withColumn("scope", F.lit(""))


def _grid(spark, root, **config) -> DataFrame:
    return evaluation.scored_grid(_study_queries(spark, root), _study_chunks(spark, root, **config))


@query
def coverage_at_k(spark, root):
    g = _grid(spark, root).filter(F.col("floor") == 0.0)
    return g.select("query_id", "k", F.round("coverage", 6).alias("coverage"))


@query
def hit_mrr(spark, root):
    g = _grid(spark, root).filter((F.col("k") == 5) & (F.col("floor") == 0.0))
    return g.select("query_id", "rank", "hit", F.round("rr", 6).alias("rr"), "kept", "best_span")


@query
def resolve_goldens(spark, root):
    return evaluation.resolve_goldens(tables.goldens(spark, root), pages.assemble_pages(_docs(spark, root))).select(
        "item_id", "expected_document", "expected_page"
    )


def _goldens(spark, root) -> DataFrame:
    """Goldens with their pages, written once: finding them reads the corpus, and each metric reads them several times."""
    return stored(evaluation.resolve_goldens(tables.goldens(spark, root), pages.assemble_pages(_docs(spark, root))), "goldens")


def _metrics(spark, root) -> DataFrame:
    c = _study_chunks(spark, root)
    _, top = evaluation.standings(_study_queries(spark, root), c, 5)
    return evaluation.retrieval_metrics(_goldens(spark, root), top, c, [1, 3, 5])


@query
def retrieval_metrics(spark, root):
    m = _metrics(spark, root)
    return m.select(
        "item_id", "expected_document", "k", "document_hit", "page_hit",
        F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
    )


def _judged(spark, root) -> DataFrame:
    c = _study_chunks(spark, root)
    hits = retrieval.search(_questions(spark, root), c, 5, None, ("model",))
    answers = answering.extractive_answers(_questions(spark, root), answering.gather_context(hits, c))
    return evaluation.judge_answers(_goldens(spark, root), answers, c)


@query
def answer_correct(spark, root):
    return _judged(spark, root).select("item_id", "expected_document", "answer_correct")


@query
def citation_metrics(spark, root):
    return _judged(spark, root).select(
        "item_id", "expected_document", "citation_document_correct", "citation_page_exact", "citation_page_covers", "citation_correct"
    )


@query
def hallucination(spark, root):
    """Replies judged against the turn before them, over all conversations."""
    m = tables.messages(spark, root)
    prev = m.select("conversation_id", (F.col("position") + 1).alias("position"), F.col("content").alias("context"))
    a = m.filter(F.col("role") == "assistant").join(prev, ["conversation_id", "position"], "left")
    ctx = F.array_compact(F.array("context"))
    return a.select("conversation_id", "position", evaluation.hallucinated(F.col("content"), ctx).alias("hallucinated"))


@query
def eval_report(spark, root):
    flags = ["answer_correct", "hallucinated", "citation_document_correct", "citation_page_exact",
             "citation_page_covers", "citation_correct", "refused"]
    return evaluation.flag_rates(_judged(spark, root), flags)


@query
def retrieval_report(spark, root):
    return evaluation.retrieval_rates(_metrics(spark, root))


@query
def eval_sweep(spark, root):
    """All chunk settings at every k and floor in one search: a setting is a scope, and numbers its own ids."""
    configs = {**CHUNK_CONFIGS, "fixed 2048 chars": {"strategy": "fixed", "chunk_chars": 2048}}
    n = len(configs)
    bundles = stored(_bundles(spark, root).select("document_id", "organization_id", "pages"), "bundles")
    parts = [
        embedding.hash_embed_batches(chunking.chunk_bundles(bundles, **config)).select(
            F.lit(label).alias("scope"), (F.col("document_id") * n + i).alias("document_id"), "chunk_index", "content",
            "page_start", "page_end", "vector",
        )
        for i, (label, config) in enumerate(configs.items())
    ]
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part)
    scopes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("label")) for i, label in enumerate(configs)]))
    q = _study_queries(spark, root).withColumn("c", scopes)
    q = q.select(F.col("c.label").alias("scope"), (F.col("query_id") * n + F.col("c.i")).alias("query_id"), "question", "gold")
    grid = evaluation.scored_grid(q, stored(chunks, "sweep"))
    labels = F.array(*map(F.lit, configs))
    grid = grid.withColumn("config", F.get(labels, (F.col("query_id") % n).cast("int")))
    return evaluation.roll_up(grid, "config")


def _headed(bundles: DataFrame) -> DataFrame:
    """Pages whose section is their own opening line."""
    head = lambda p: F.element_at(F.split(p.content, "\n"), 1)
    return bundles.withColumn(
        "pages",
        F.transform("pages", lambda p: F.struct(p.page_number.alias("page_number"), p.content.alias("content"),
                                                head(p).alias("section"), p.source.alias("source"))),
    )


@query
def section_gate_study(spark, root):
    bundles = _headed(_bundles(spark, root))
    g = _goldens(spark, root).filter(F.col("expected_page").isNotNull())
    heads = bundles.select("document_id", F.explode("pages").alias("p")).select(
        F.col("document_id").alias("expected_document"), F.col("p.page_number").alias("expected_page"), F.col("p.section").alias("section")
    )
    q = g.join(heads, ["expected_document", "expected_page"]).select(
        F.xxhash64("item_id", "expected_document").alias("query_id"),
        F.col("expected_answer").alias("question"), F.col("expected_answer").alias("gold"),
        F.col("expected_document").alias("document_id"), "section",
    )
    q = cut_lineage(q)
    out = None
    for label, chars in (("fixed 512", 512), ("fixed 2048", 2048)):
        c = embedding.hash_embed_batches(chunking.chunk_bundles(bundles, "fixed", chunk_chars=chars))
        c = stored(c.select("document_id", "chunk_index", "content", "section", "page_start", "page_end", "vector"), "study")
        one = evaluation.section_gate_study(q, c).select(F.lit(label).alias("config"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def eval_misses(spark, root):
    return evaluation.misses(_grid(spark, root, chunk_chars=512))


@query
def demo_check(spark, root):
    return evaluation.demo_check(tables.goldens(spark, root), _answers(spark, root))


# ---- ledger and telemetry -----------------------------------------------------------------------


@query
def request_counts(spark, root):
    return telemetry.request_counts(tables.requests(spark, root))


@query
def sliding_rate(spark, root):
    r = telemetry.sliding_rate(tables.requests(spark, root), "method")
    return r.select(F.unix_seconds("window_start").alias("start_s"), "method", "events", F.round("per_second", 9).alias("per_second"))


@query
def error_pct(spark, root):
    e = telemetry.error_pct(tables.requests(spark, root), "method")
    return e.withColumn("error_pct", F.round("error_pct", 6))


@query
def latency_histogram(spark, root):
    h = telemetry.latency_histogram(tables.requests(spark, root), "seconds", "operation")
    return h.select("operation", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_number("le", 3)).alias("le"), "cumulative")


def _le(h: DataFrame, label: str) -> DataFrame:
    return h.select(label, F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.format_number("le", 3)).alias("le"), "cumulative")


@query
def ai_duration_histogram(spark, root):
    """Model calls on their own ladder of buckets."""
    calls = tables.requests(spark, root).filter("method = 'POST'")
    return _le(telemetry.latency_histogram(calls, "seconds", "operation", telemetry.AI_BUCKETS), "operation")


@query
def job_outcomes(spark, root):
    o = ledger.outcome_counts(ledger.run_outcomes(tables.jobs(spark, root)))
    return o.withColumn("failure_rate", F.round("failure_rate", 6))


@query
def job_duration_histogram(spark, root):
    runs = ledger.run_outcomes(tables.jobs(spark, root))
    return _le(telemetry.latency_histogram(runs, "seconds", "outcome", telemetry.JOB_BUCKETS), "outcome")


@query
def auth_rate_breaches(spark, root):
    """Signups and errors read as calls of the sign-in routes, half of them through a proxy; ten calls a week."""
    r = tables.requests(spark, root).filter(F.col("operation").isin("signup", "error"))
    proxied = F.when(F.col("client") % 2 == 0, F.concat(F.lit(" "), F.col("client"), F.lit(" , 10.0.0.1"))).when(F.col("client") % 3 == 0, "")
    called = r.withColumn("client", telemetry.client_of(proxied, F.concat(F.lit("socket "), F.col("client"))))
    b = telemetry.rate_limit_breaches(called, telemetry.AUTH_RATE_LIMIT, "7 days")
    return b.select(F.unix_seconds("window_start").alias("start_s"), "client", "requests", "rejected")


@query
def histogram_quantile(spark, root):
    h = telemetry.latency_histogram(tables.requests(spark, root), "seconds", "operation")
    out = None
    for q in (0.5, 0.95, 0.99):
        one = telemetry.histogram_quantile(h, "operation", q).select("operation", F.lit(q).alias("q"), F.round("quantile", 6).alias("quantile"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def token_usage(spark, root):
    m = tables.messages(spark, root)
    calls = m.select(
        F.col("role").alias("operation"), F.lit("hash").alias("provider"),
        tx.estimate_tokens(F.col("content")).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", tx.estimate_words(F.col("content"))).otherwise(0).alias("completion_tokens"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return telemetry.token_usage(calls)


@query
def job_timings(spark, root):
    return ledger.job_timings(tables.jobs(spark, root), F.expr(AS_OF))


@query
def stale_jobs(spark, root):
    return ledger.stale_jobs(tables.jobs(spark, root), F.expr(AS_OF))


@query
def latency_summary(spark, root):
    return telemetry.latency_summary(tables.requests(spark, root), "seconds", "operation")


@query
def throughput(spark, root):
    t = telemetry.throughput(tables.requests(spark, root), "ts", "operation")
    return t.select("operation", "n", F.round("seconds", 3).alias("seconds"), F.round("per_minute", 6).alias("per_minute"))


@query
def retry_schedule(spark, root):
    return ledger.retry_schedule(tables.jobs(spark, root))


@query
def ledger_replay(spark, root):
    r = ledger.replay(tables.spread(tables.ledger_events(spark, root), "document_id"))
    return r.select(
        "document_id", "kind", "status", "attempts", "ignored", "error",
        F.unix_seconds("started_at").alias("started_s"), F.unix_seconds("finished_at").alias("finished_s"),
    )


@query
def rate_limit_breaches(spark, root):
    b = telemetry.rate_limit_breaches(tables.requests(spark, root), 3, "1 day")
    return b.select(F.unix_seconds("window_start").alias("start_s"), "client", "requests", "rejected")


# ---- streaming ----------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for one streaming run, next to the cluster's checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_stream(spark, df: DataFrame, path: str) -> DataFrame:
    """Rows derived by Spark, written out and read back as a file stream."""
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")


@query
def stream_ingest(spark, root):
    """Three deliveries: all documents; every third one cut to half, twice; every fifth one turned round."""
    path = _scratch(spark, "ingest")
    docs = _docs(spark, root).select("document_id", "organization_id", "uploaded_by", "text")
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    cut = docs.filter("document_id % 3 = 0").withColumn("text", half)
    turned = docs.filter("document_id % 5 = 0").withColumn("text", F.reverse("text"))
    for version, rows in enumerate((docs, cut.unionByName(cut), turned)):
        rows = rows.withColumn("version", F.lit(version).cast("bigint"))
        rows.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        streams.run_once(source, f"{path}/ck", streams.ingest_writer(f"{path}/out", "fixed"))
    chunks = streams.current_chunks(spark, f"{path}/out")
    return chunks.select("document_id", "chunk_index", "token_count", F.size("vector").alias("slots"))


@query
def stream_telemetry(spark, root):
    """Hourly counts of the closed windows: the last one stays open behind the watermark."""
    path = _scratch(spark, "telemetry")
    requests = _as_stream(spark, tables.requests(spark, root), path)
    streams.run_once(
        streams.telemetry_counts(requests), f"{path}/ck",
        lambda batch, n: batch.write.mode("append").parquet(f"{path}/out"),
    )
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.unix_seconds("window_start").alias("start_s"), "method", "requests", "errors", "le_5")


def _drained(spark, stream: DataFrame, path: str) -> DataFrame:
    streams.run_once(stream, f"{path}/ck", lambda batch, n: sinks.write_batch(batch, f"{path}/out", n))
    return spark.read.parquet(f"{path}/out")


@query
def stream_rates(spark, root):
    """Sliding rates of the closed windows, requests deduplicated first."""
    path = _scratch(spark, "rates")
    out = _drained(spark, streams.telemetry_rates(_as_stream(spark, tables.requests(spark, root), path), "method"), path)
    return out.select(F.unix_seconds("window_start").alias("start_s"), "method", "events", F.round("per_second", 9).alias("per_second"))


@query
def stream_breaches(spark, root):
    """Clients over three requests a day, for the closed days; requests delivered twice count once."""
    path = _scratch(spark, "breaches")
    requests = tables.requests(spark, root)
    twice = requests.unionByName(requests.filter("event_id % 4 = 0"))
    out = _drained(spark, streams.breaches(_as_stream(spark, twice, path), 3, "1 day"), path)
    return out.select(F.unix_seconds("window_start").alias("start_s"), "client", "requests", "rejected")


@query
def stream_late(spark, root):
    """Requests behind the watermark, as rows: four deliveries in order of time, every seventh request one delivery late."""
    path = _scratch(spark, "late")
    requests = tables.requests(spark, root)
    lo, hi = requests.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    quarter = F.floor((F.unix_seconds("ts") - F.lit(lo)) * 4 / F.lit(max(1, (hi or 0) - (lo or 0) + 1)))
    dealt = requests.withColumn("part", quarter + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    for n in range(5):
        dealt.filter(F.col("part") == n).drop("part").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(requests.schema).parquet(f"{path}/in")
        streams.run_once(source, f"{path}/ck", streams.split_writer(f"{path}/out"))
    late = spark.read.parquet(f"{path}/out/late")
    return late.select("event_id", "method", F.unix_micros("watermark").alias("watermark_us"))


@query
def stream_ledger(spark, root):
    path = _scratch(spark, "ledger")
    events = _as_stream(spark, tables.spread(tables.ledger_events(spark, root), "document_id"), path)
    streams.run_once(events, f"{path}/ck", streams.ledger_merge_writer(f"{path}/out"))
    jobs = streams.current_jobs(spark, f"{path}/out")
    return jobs.select("document_id", "kind", "status", "attempts", "ignored", "error")


@query
def stream_ledger_timeouts(spark, root):
    """The ledger in event time with its time-out: four deliveries, events up to five minutes out of order."""
    path = _scratch(spark, "timed-ledger")
    events = stored(tables.ledger_events(spark, root), "timed-events")
    lo, hi = events.agg(F.min(F.unix_seconds("at")), F.max(F.unix_seconds("at"))).first()
    arrival = F.unix_seconds("at") + F.pmod(F.xxhash64("document_id", "kind", "seq"), F.lit(300))
    part = F.least(F.floor((arrival - F.lit(lo)) * 4 / F.lit(max(1, (hi or 0) - (lo or 0)))), F.lit(3))
    dealt = events.withColumn("part", part)
    for n in range(4):
        dealt.filter(F.col("part") == n).drop("part").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        streams.run_once(source, f"{path}/ck", timed_ledger.timed_merge_writer(f"{path}/out"))
    r = streams.current_jobs(spark, f"{path}/out/jobs")
    return r.select(
        "document_id", "kind", "status", "attempts", "ignored", "error",
        F.unix_seconds("started_at").alias("started_s"), F.unix_seconds("finished_at").alias("finished_s"),
    )


@query
def stream_memory(spark, root):
    path = _scratch(spark, "memory")
    messages = _as_stream(spark, tables.messages(spark, root), path)
    streams.run_once(
        streams.streaming_memory(messages), f"{path}/ck",
        lambda batch, n: batch.write.mode("append").parquet(f"{path}/out"),
    )
    out = spark.read.parquet(f"{path}/out")
    return out.select("conversation_id", "position", "expanded", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


# ---- flagship -----------------------------------------------------------------------------------


@query
def ask_corpus(spark, root):
    """Documents to pages, chunks, vectors, exact top-k, budgeted context and cited answers."""
    chunks = stored(flows.embedded_chunks(_docs(spark, root), "fixed"), "chunks")
    answers = flows.ask(_questions(spark, root), chunks, scope_columns=("model",))
    return answers.select("query_id", "document_id", "chunk_index", "similarity", "answer", "refused")
