"""Corpus scans and the tables that the engine derives from the given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe import schemas
from ragframe.functions import text as tx
from ragframe.operators.joins import reduce_to
from ragframe.session import cut_lineage


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One given table with its declared schema; columns and filters reach the parquet reader."""
    return spark.read.schema(schemas.INPUT[name]).parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out where a scan has fewer splits than the cluster has cores; else leave them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def _pick(n: Column, values: list[str]) -> Column:
    """values[n mod len(values)]"""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def corpus_documents(spark: SparkSession, root: str) -> DataFrame:
    """documents as an uploaded library: tenant, owner, file name, and both status columns."""
    d = scan(spark, root, "documents")
    i = F.col("doc_id")
    kind = _pick(i, schemas.SOURCE_TYPES)
    status = (
        F.when(i % 11 == 8, "queued").when(i % 11 == 9, "processing").when(i % 11 == 10, "failed").otherwise("ready")
    )
    embedding = (
        F.when(i % 11 >= 8, "none").when(i % 7 == 5, "processing").when(i % 7 == 6, "failed").otherwise("ready")
    )
    return d.select(
        i.alias("document_id"),
        F.col("source").alias("organization_id"),
        F.concat(F.lit("u"), i % 3).alias("uploaded_by"),
        F.concat("source", F.lit(" note "), i).alias("title"),
        F.concat(F.lit("note-"), i, F.lit("."), kind).alias("filename"),
        kind.alias("source_type"),
        F.col("n_chars").alias("size"),
        status.alias("status"),
        embedding.alias("embedding_status"),
        F.timestamp_micros(F.lit(1704067200000000) + i * 60000000).alias("created_at"),
        "text",
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    """events as an HTTP request log."""
    kind = F.col("event_type")
    return scan(spark, root, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client"),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/v1/documents/"), F.col("user_id")).alias("path"),
        F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200).alias("status"),
        (F.col("value") / 100.0).alias("seconds"),
        kind.alias("operation"),
        "props",
    )


def messages(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, "conversations").select(
        F.col("conv_id").alias("conversation_id"),
        (F.col("turn") + 1).alias("position"),
        "role",
        F.col("text").alias("content"),
    )


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Every benchmark passage asked as a question."""
    return scan(spark, root, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )


# Passages of one or two words are looked for in every text, so many at a time.
SHORT_BLOCK = 1000
# Up to so many keys are held beside every document, so that its other runs never leave the row.
HELD_KEYS = 10_000
# A passage brings its inner words along as whole words: its key is a run of at most so many of them.
RUN = 3


def _runs(tokens: Column, length: int) -> Column:
    """Hashes of all runs of so many neighbouring words."""
    at = F.sequence(F.lit(0), F.size(tokens) - length)
    run = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(length)])
    return F.when(F.size(tokens) >= length, F.transform(at, run)).otherwise(F.array().cast("array<bigint>"))


def passages_in_documents(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(passage_id, document_id) for every document whose text holds the whole passage verbatim.

    A contained passage brings its inner words along as whole words, so they, or the first three of them, must occur as
    a run in the document: an equality join on hashes of such runs finds every candidate without comparing all
    passages with all texts, and ``contains`` settles each one. While the keys are counted to be few, a document's runs
    meet them inside the row, so that only candidates are shuffled; more of them are joined. Passages of one or two
    words have no inner word: blocks of them are looked for in every text, one written block after the other.
    """
    n = F.size("_w")
    worded = passages.select("passage_id", "passage", tx.seal(tx.words(F.col("passage"))).alias("_w"))
    inner = lambda length: F.xxhash64(*[F.get("_w", F.lit(1 + j)) for j in range(length)])
    keys = worded.filter(n >= 3).select(
        "passage_id", F.least(n - 2, F.lit(RUN)).alias("length"),
        F.when(n == 3, inner(1)).when(n == 4, inner(2)).otherwise(inner(RUN)).alias("run"),
    )
    keys = cut_lineage(keys)
    lengths = [r.length for r in keys.select("length").distinct().collect()]  # at most RUN numbers
    spoken = documents.select("document_id", tx.seal(tx.words(F.col("text"))).alias("_w"))
    hashed = spoken.select("document_id", tx.seal(F.concat(F.array().cast("array<bigint>"), *[_runs(F.col("_w"), i) for i in lengths])).alias("_r"))
    own = F.col("_r")
    if keys.count() <= HELD_KEYS:
        own = F.array_intersect("_r", keys.agg(F.collect_set("run")).scalar())
    runs = hashed.select("document_id", F.explode(F.array_distinct(own)).alias("run"))
    candidates = cut_lineage(runs.join(keys, "run").select("passage_id", "document_id").distinct())
    found = (
        candidates.join(passages, "passage_id")
        .join(reduce_to(documents.select("document_id", "text"), candidates, ["document_id"]), "document_id")
        .filter(F.col("text").contains(F.col("passage")))
        .select("passage_id", "document_id", "passage")
    )
    brief = cut_lineage(worded.filter(n < 3).select("passage_id", "passage"))
    blocks = -(-brief.count() // SHORT_BLOCK)
    for block in range(blocks):
        mine = brief.filter(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == block).collect()  # about SHORT_BLOCK passages
        if mine:
            listed = F.array(*[F.struct(F.lit(r.passage_id).alias("passage_id"), F.lit(r.passage).alias("passage")) for r in mine])
            held = F.filter(listed, lambda p: F.col("text").contains(p["passage"]))
            direct = documents.select("document_id", F.explode(held).alias("p")).select("p.passage_id", "document_id", "p.passage")
            found = found.unionByName(cut_lineage(direct))
    return found


def goldens(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, expected_answer, expected_document): benchmark passages found in documents."""
    passages = scan(spark, root, "benchmark").select(
        F.col("item_id").alias("passage_id"), F.col("text").alias("passage")
    )
    docs = corpus_documents(spark, root).select("document_id", "text")
    return passages_in_documents(passages, docs).select(
        F.col("passage_id").alias("item_id"),
        F.col("passage").alias("expected_answer"),
        F.col("document_id").alias("expected_document"),
    )


def members(spark: SparkSession, root: str) -> DataFrame:
    """Users who uploaded something; the same e-mail recurs across tenants on purpose."""
    d = corpus_documents(spark, root)
    n = F.substring("uploaded_by", 2, 10).cast("int")
    return (
        d.groupBy("organization_id", "uploaded_by")
        .agg(F.count("*").alias("documents"), F.max("created_at").alias("last_seen_at"))
        .select(
            "organization_id",
            F.concat("organization_id", F.lit("/"), "uploaded_by").alias("user_id"),
            F.concat(F.lit("u"), n, F.lit("@example.org")).alias("email"),
            _pick(n + F.length("organization_id"), ["owner", "admin", "member", "viewer"]).alias("role"),
            "documents",
            "last_seen_at",
        )
    )


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """Ledger rows: a process job for each document, an embed job once processing is through."""
    d = corpus_documents(spark, root).select(
        "document_id", "organization_id", "size", "status", "embedding_status", "created_at"
    )
    i = F.col("document_id")
    process = (
        F.when(F.col("status") == "ready", "succeeded").otherwise(F.col("status"))
    )
    embed = (
        F.when(F.col("status") != "ready", F.lit(None))
        .when(F.col("embedding_status") == "ready", "succeeded")
        .otherwise(F.col("embedding_status"))
    )
    both = d.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit("process").alias("kind"), process.alias("job_status")),
                F.struct(F.lit("embed").alias("kind"), embed.alias("job_status")),
            )
        ).alias("j"),
    ).filter(F.col("j.job_status").isNotNull())
    created = F.unix_micros("created_at")
    started = created + (i % 17) * 1000000
    state = F.col("j.job_status")
    failed = state == "failed"
    return both.select(
        "document_id",
        "organization_id",
        F.col("j.kind").alias("kind"),
        state.alias("status"),
        F.when(state == "queued", F.lit(0)).when(failed, (i % 4 + 1).cast("int")).otherwise(1).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.when(failed, _pick(i, ["pdf extraction failed: bad header", "connection reset",
                                 "model said 400, not retryable", "retries exhausted after 3"])).alias("error"),
        F.col("created_at").alias("enqueued_at"),
        F.when(state != "queued", F.timestamp_micros(started)).alias("started_at"),
        F.when(
            state.isin("succeeded", "failed"),
            F.timestamp_micros(started + F.floor(F.col("size") / 100) * 1000),
        ).alias("finished_at"),
    )


def ledger_events(spark: SparkSession, root: str) -> DataFrame:
    """The claims, requeues and outcomes behind the ledger: doc_id mod 4 failed runs come first.

    Some embed jobs are claimed a day before they exist.
    """
    j = jobs(spark, root).select("document_id", "kind", "status", "enqueued_at")
    i = F.col("document_id")
    bounce = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(3)),
            lambda n: F.when(
                (n < i % 4) & (F.col("status") != "queued"),
                F.array(F.lit("claim"), F.lit("fail"), F.lit("requeue")),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    last = (
        F.when(F.col("status") == "succeeded", F.array(F.lit("claim"), F.lit("succeed")))
        .when(F.col("status") == "failed", F.array(F.lit("claim"), F.lit("fail")))
        .when(F.col("status") == "processing", F.array(F.lit("claim")))
        .otherwise(F.array(F.lit("succeed")))  # an outcome nobody claimed: must be ignored
    )
    steps = j.select(
        "document_id", "kind", "enqueued_at",
        F.posexplode(F.concat(F.array(F.lit("enqueue")), bounce, last)).alias("seq", "action"),
    )
    early = j.filter((F.col("kind") == "embed") & (i % 5 == 1)).select(
        "document_id", "kind", (F.col("enqueued_at") - F.expr("interval 1 day")).alias("enqueued_at"),
        F.lit(-1).alias("seq"), F.lit("claim").alias("action"),
    )
    return steps.unionByName(early).select(
        "document_id",
        "kind",
        F.col("seq").cast("bigint").alias("seq"),
        F.timestamp_micros(F.unix_micros("enqueued_at") + F.col("seq") * 1000000).alias("at"),
        "action",
        F.when(F.col("action").isin("fail", "requeue"), F.concat(F.lit("attempt "), F.col("seq"))).alias("error"),
    )
