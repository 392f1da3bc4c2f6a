"""The physical plans stay what they were designed to be."""

import os

import pytest

from ragframe.plans.queries import REGISTRY
from ragframe.session import checkpoint_dir

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Lazy queries whose plan shows everything they do.
LAZY = [
    "scan_documents", "admit_files", "upsert_embeddings", "ensure_jobs", "publishable_documents", "cascade_delete",
    "assemble_pages", "section_fill", "chunk_fixed", "chunk_overlap", "chunk_paragraph", "hash_embed_sparse", "tfidf",
    "retrievable_chunks", "scoped_search", "topk_cosine", "topk_sparse", "tfidf_topk", "expand_followups", "history_window", "turn_pairs",
    "document_list", "conversation_list", "ingestion_state", "member_report", "request_counts", "sliding_rate",
    "latency_histogram", "histogram_quantile", "ledger_replay", "rate_limit_breaches",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, name):
    text = plan(REGISTRY[name](spark, ROOT))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(REGISTRY["metadata_filter"](spark, ROOT))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,props:string>" in text
    text = plan(REGISTRY["referential_turns"](spark, ROOT))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text
    text = plan(REGISTRY["request_counts"](spark, ROOT))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(REGISTRY["topk_sparse"](spark, ROOT))


@pytest.mark.parametrize("name", ["coverage_at_k", "hit_mrr", "retrieval_metrics", "eval_report", "eval_misses", "document_status"])
def test_evaluation_reads_its_written_tables(spark, name):
    """Chunks, vectors and goldens are in tables written before; only questions and lists of documents read documents again."""
    assert plan(REGISTRY[name](spark, ROOT)).count("documents.parquet") <= 2


def test_checkpoints_have_a_folder(spark):
    assert checkpoint_dir(spark) and checkpoint_dir(spark) == checkpoint_dir(spark)


def test_searched_chunks_are_cut_and_embedded_once(spark, monkeypatch):
    """Search and texts of the context read one written table."""
    from ragframe.plans import queries

    names, original = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: names.append(name) or original(df, name))
    for name in ("prompt_table", "ask_corpus"):
        queries.REGISTRY[name](spark, "/root/testdata/sf0.001")
    assert names == ["chunks", "chunks"]
