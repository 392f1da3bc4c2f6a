"""Library, membership and access reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe import schemas
from ragframe.operators.retrieval import title_search


def document_list(
    documents: DataFrame,
    *,
    organization_id: str | None = None,
    uploaded_by: str | None = None,
    source_type: str | None = None,
    status: str | None = None,
    embedding_status: str | None = None,
    query: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page of the library, newest first, with ``matching_total`` and ``has_more``.

    Given filters are plain comparisons and reach the scan. The total is an aggregate of its own, a
    scalar beside the page; a page past the end is empty.
    """
    wanted = {
        "organization_id": organization_id, "uploaded_by": uploaded_by, "source_type": source_type,
        "status": status, "embedding_status": embedding_status,
    }
    for column, value in wanted.items():
        if value is not None:
            documents = documents.filter(F.col(column) == value)
    if query:
        documents = title_search(documents, query)
    rows = documents.select(
        "document_id", "organization_id", "title", "filename", "source_type", "size", "status",
        "embedding_status", "created_at",
    )
    page = rows.orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit)
    total = rows.agg(F.count("*")).scalar()
    return page.withColumn("matching_total", total).withColumn("has_more", F.col("matching_total") > offset + limit)


def stage(status: Column, embedding: Column) -> Column:
    """The library's own notion of progress; jobs play no part in it."""
    return (
        F.when((status == "failed") | (embedding == "failed"), "failed")
        .when(embedding == "ready", "ready")
        .when(embedding == "processing", "embedding")
        .when(status == "processing", "processing")
        .otherwise("uploaded")
    )


def document_status(documents: DataFrame, pages: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Child counts and stage of every document: three pre-aggregated counts, joined once each."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    rows = documents.select("document_id", "status", "embedding_status")
    for df, name in ((pages, "pages"), (chunks, "chunks"), (vectors, "embeddings")):
        rows = rows.join(count(df, name), "document_id", "left")
    return rows.select(
        "document_id", "status", "embedding_status",
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("pages", "chunks", "embeddings")],
        stage(F.col("status"), F.col("embedding_status")).alias("stage"),
    )


def source_view(documents: DataFrame, pages: DataFrame) -> DataFrame:
    mime = F.create_map(*[F.lit(x) for kv in schemas.MIME_TYPES.items() for x in kv])
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    return documents.join(counts, "document_id", "left").select(
        "document_id", "title", "filename", "source_type",
        F.element_at(mime, F.col("source_type")).alias("mime_type"), "size", "status", "created_at",
        F.coalesce("page_count", F.lit(0).cast("bigint")).alias("page_count"),
    )


def role_rank(role: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in schemas.ROLE_RANKS.items() for x in kv])
    return F.try_element_at(ranks, role)


def member_report(members: DataFrame, at_least: str = "viewer") -> DataFrame:
    """Members per organization, how many hold at least a role, and the highest rank present."""
    rank = role_rank(F.col("role"))
    return members.groupBy("organization_id").agg(
        F.count("*").alias("members"),
        F.count_if(rank >= schemas.ROLE_RANKS[at_least]).alias("at_least"),
        F.max(rank).alias("top_rank"),
    )


def invitation_status(status: Column, expires_at: Column, as_of: Column) -> Column:
    return F.when(status != "pending", "spent").when(expires_at <= as_of, "expired").otherwise("pending")


def live_token(revoked_at: Column, expires_at: Column, as_of: Column) -> Column:
    return revoked_at.isNull() & (expires_at > as_of)


def duplicate_pending(invitations: DataFrame) -> DataFrame:
    """(organization, e-mail) pairs invited more than once at the same time."""
    return (
        invitations.filter(F.col("status") == "pending")
        .groupBy("organization_id", F.lower("email").alias("email"))
        .agg(F.count("*").alias("pending"))
        .filter(F.col("pending") > 1)
    )


def multi_tenant_emails(members: DataFrame) -> DataFrame:
    """E-mails that are known to several organizations (distinct first, so hot e-mails combine)."""
    return (
        members.select(F.lower("email").alias("email"), "organization_id").distinct()
        .groupBy("email").agg(F.count("*").alias("organizations"))
        .filter(F.col("organizations") > 1)
    )


def tenant_audit(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows checked and leaked: a result may only show documents of its own tenant and owner.

    ``results`` names the asking tenant and owner as query_organization and query_owner.
    """
    owners = documents.select("document_id", "organization_id", "uploaded_by")
    joined = results.join(owners, "document_id", "left")
    alien = ~(
        F.col("organization_id").eqNullSafe(F.col("query_organization"))
        & F.col("uploaded_by").eqNullSafe(F.col("query_owner"))
    )
    return joined.agg(F.count("*").alias("rows_checked"), F.count_if(alien).alias("leaks"))


def child_tenant_audit(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Child rows whose tenant differs from their document's, and children without a document."""
    parents = documents.select("document_id", F.col("organization_id").alias("_org"))
    joined = children.select("document_id", "organization_id").join(parents, "document_id", "left")
    return joined.agg(
        F.count("*").alias("rows_checked"),
        F.count_if(F.col("_org") != F.col("organization_id")).alias("mismatched"),
        F.count_if(F.col("_org").isNull()).alias("orphans"),
    )
