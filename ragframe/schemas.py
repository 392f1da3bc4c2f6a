"""Declared schemas (as DDL). Readers never infer, so a corpus scan starts without a pass over its files."""

from __future__ import annotations

# ---- fixed values: status and type vocabularies -------------------------------------------------
SOURCE_TYPES = ["pdf", "docx", "md", "html", "txt"]
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "html": "text/html",
    "txt": "text/plain",
}
DOCUMENT_STATUSES = ["queued", "processing", "ready", "failed"]
EMBEDDING_STATUSES = ["none", "processing", "ready", "failed"]
JOB_KINDS = ["process", "embed"]
JOB_STATUSES = ["queued", "processing", "succeeded", "failed"]
MESSAGE_ROLES = ["user", "assistant", "system"]
ROLE_RANKS = {"viewer": 1, "member": 2, "admin": 3, "owner": 4}
# -------------------------------------------------------------------------------------------------


# The given tables.
INPUT = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}

# The engine's own tables.
DOCUMENTS = (
    "document_id bigint, organization_id string, uploaded_by string, title string, filename string, "
    "source_type string, size bigint, status string, embedding_status string, created_at timestamp, "
    "text string"
)
PAGES = (
    "document_id bigint, organization_id string, page_number int, content string, token_count int, "
    "section string, source string"
)
CHUNKS = (
    "document_id bigint, organization_id string, chunk_index int, page_number int, content string, "
    "token_count int, strategy string, section string, source string, page_start int, page_end int"
)
JOBS = (
    "document_id bigint, organization_id string, kind string, status string, attempts int, "
    "max_attempts int, error string, enqueued_at timestamp, started_at timestamp, finished_at timestamp"
)
LEDGER_EVENTS = (
    "document_id bigint, kind string, seq bigint, at timestamp, action string, error string"
)
MESSAGES = "conversation_id bigint, position bigint, role string, content string"
