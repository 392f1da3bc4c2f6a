"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from ragframe.operators import (
    answering, chunking, conversations, embedding, evaluation, ledger, pages, retrieval, telemetry,
)
from ragframe.plans import queries as q
from ragframe.session import local_session
from ragframe.sources import tables


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    work = f"/tmp/spark-bench-{os.getpid()}"

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    docs = q._docs(spark, root)
    seconds: dict[str, float] = {}
    facts: dict[str, float] = {}

    def timed(name: str, action) -> float:
        t0 = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - t0, 3)
        return seconds[name]

    bundles = pages.document_bundles(docs)
    run(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())  # start the executors
    # One pass over the corpus per strategy, as a re-chunk of the library would be.
    for strategy in chunking.STRATEGIES:
        timed(f"chunk_{strategy}", lambda s=strategy: run(chunking.chunk_bundles(bundles, s)))
    # Ingest: raw documents to stored, embedded chunks.
    chunks_path = f"{work}/chunks"
    ingest = embedding.hash_embed(chunking.chunk_bundles(bundles, "paragraph"))
    t = timed("ingest", lambda: ingest.write.parquet(chunks_path))
    chunks = spark.read.parquet(chunks_path)
    n_docs, n_chunks = docs.count(), chunks.count()
    facts["docs_per_min"] = round(60 * n_docs / t, 1)
    facts["chunks_per_s"] = round(n_chunks / t, 1)
    questions = q._questions(spark, root)
    n_q = questions.count()
    t = timed("search_top5", lambda: run(retrieval.search(questions, chunks, 5, None, ("model",))))
    facts["queries_per_s"] = round(n_q / t, 2)
    facts["pairs_per_s"] = round(n_q * n_chunks / t, 0)
    timed("search_tiled", lambda: run(retrieval.search(questions, chunks, 5, None, ("model",), broadcast_queries=0)))

    def ask() -> None:
        hits = retrieval.search(questions, chunks, 5, None, ("model",))
        run(answering.extractive_answers(questions, answering.gather_context(hits, chunks)))

    t = timed("ask", ask)
    facts["answers_per_s"] = round(n_q / t, 2)
    timed("tfidf_top3", lambda: run(retrieval.tfidf_topk(questions, docs, "document_id", "text", 3)))
    study = chunks.withColumn("scope", F.lit(""))
    asked = questions.withColumn("scope", F.lit("")).withColumn("gold", F.col("question"))
    timed("eval_grid", lambda: run(evaluation.roll_up(evaluation.scored_grid(asked, study))))
    timed("resolve_goldens", lambda: run(q._goldens(spark, root)))
    timed("history_window", lambda: run(conversations.history_window(tables.messages(spark, root))))
    timed("expand_followups", lambda: run(conversations.expand_followups(tables.messages(spark, root))))
    requests = tables.requests(spark, root)
    timed("sliding_rate", lambda: run(telemetry.sliding_rate(requests, "method")))
    timed("latency_summary", lambda: run(telemetry.latency_summary(requests, "seconds", "operation")))
    timed("ledger_replay", lambda: run(ledger.replay(tables.spread(tables.ledger_events(spark, root), "document_id"))))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": root.rsplit("sf", 1)[-1], "cpus": cpus, "documents": n_docs, "chunks": n_chunks, "questions": n_q, **facts,
    }))


if __name__ == "__main__":
    main()
