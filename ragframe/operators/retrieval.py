"""Scoped retrieval: gates, filters, exact top-k, distances, TF-IDF search, title search."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ragframe.functions import text as tx
from ragframe.functions import vectors as vx
from ragframe.operators import embedding, tiles

DEFAULT_K = 5
MAX_K = 20


def item_id(document_id: Column, chunk_index: Column) -> Column:
    """(document, chunk) as a pair of whole numbers of any size; its order is the tie-break everywhere."""
    return F.struct(document_id.cast("bigint").alias("document_id"), chunk_index.cast("int").alias("chunk_index"))


def split_item(item: Column) -> list[Column]:
    return [item["document_id"].alias("document_id"), item["chunk_index"].alias("chunk_index")]


def scope(*parts: Column) -> Column:
    """Tenancy as a join key: only equal scopes ever meet."""
    return F.concat_ws("\x1f", *parts)


def retrievable(vectors: DataFrame, documents: DataFrame, source_type: str | None = None) -> DataFrame:
    """Vectors whose document finished both phases, with tenant, owner and source type.

    The status filters are plain column comparisons and reach the document scan; the join is an
    equality on the document, left to Catalyst and AQE.
    """
    ready = documents.filter((F.col("status") == "ready") & (F.col("embedding_status") == "ready"))
    if source_type is not None:
        ready = ready.filter(F.col("source_type") == source_type)
    keys = ready.select("document_id", "organization_id", "uploaded_by", "source_type", "title")
    dropped = [c for c in keys.columns if c != "document_id" and c in vectors.columns]
    return vectors.drop(*dropped).join(keys, "document_id")


def metadata_contains(metadata: Column, wanted: dict[str, str | int | float | bool]) -> Column:
    """Every wanted key holds exactly the wanted value (containment); ``metadata`` is the text of a JSON object.

    Text, numbers and truth values are told apart: 69 is not "69". A key is a name, whatever signs it holds.
    """
    if len(wanted) > 20:
        raise ValueError("at most 20 metadata keys")
    held = F.from_json(metadata, "map<string,variant>")
    checks = F.lit(True)
    for key, value in wanted.items():
        item = F.try_element_at(held, F.lit(key))
        if isinstance(value, bool) or isinstance(value, str):
            same = F.to_json(item) == F.lit(json.dumps(value, ensure_ascii=False))
        else:
            number = ~F.schema_of_variant(item).isin("STRING", "BOOLEAN")
            same = number & (F.try_variant_get(item, "$", "double") == F.lit(float(value)))
        checks = checks & F.coalesce(same, F.lit(False))
    return checks


def _features(df: DataFrame, vector: str, value: str = "q") -> DataFrame:
    entries = F.col(vector)
    return df.withColumn("features", entries.getField("slot")).withColumn("weights", entries.getField(value)).withColumn(
        "norm2", F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, x: a + x[value] * x[value])
    )


def sparse_items(chunks: DataFrame, scope_columns: list[str]) -> DataFrame:
    """Embedded chunks as tile input."""
    df = _features(chunks, "vector")
    return df.select(
        scope(*map(F.col, scope_columns)).alias("scope") if scope_columns else F.lit("").alias("scope"),
        item_id(F.col("document_id"), F.col("chunk_index")).alias("item_id"),
        "features", "weights", "norm2",
    )


def dense_items(df: DataFrame, key: str, vector: str, scope_column: Column | None = None) -> DataFrame:
    """Dense whole-number vectors as tile input: position is the feature."""
    return df.select(
        (F.lit("") if scope_column is None else scope_column).alias("scope"),
        F.col(key).alias("item_id"),
        F.sequence(F.lit(0), F.size(vector) - 1).alias("features"),
        F.col(vector).alias("weights"),
        vx.squared_norm(F.col(vector)).alias("norm2"),
    )


def as_queries(items: DataFrame, floor: float | None = None) -> DataFrame:
    """Item rows in the role of queries, with an optional similarity floor."""
    bar = F.lit(float("-inf") if not floor else float(floor))
    return items.withColumnRenamed("item_id", "query_id").withColumn("floor", bar)


def embed_queries(queries: DataFrame, scope_columns: list[str], floor: float | None = None) -> DataFrame:
    """(query_id, question, scope columns) embedded by the corpus model."""
    df = _features(embedding.hash_embed(queries, "question"), "vector")
    return df.select(
        scope(*map(F.col, scope_columns)).alias("scope") if scope_columns else F.lit("").alias("scope"),
        "query_id", "features", "weights", "norm2",
        F.lit(float("-inf") if not floor else float(floor)).alias("floor"),
    )


def topk(queries: DataFrame, items: DataFrame, k: int = DEFAULT_K, metric: str = "cosine", skip: bool = False, texts: bool = False, **tiling) -> DataFrame:
    """(query_id, item_id, score, rank): exact best k of each query within its scope.

    With ``texts`` the items carry a lower-cased ``text`` in place of features, weights and norm.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    asked = queries.schema["query_id"].dataType
    kernel = tiles.topk_kernel(k, metric, items.schema["item_id"].dataType, asked if isinstance(asked, StructType) else LongType(), skip)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = tiles.run_tiles(
        queries, items, tiles.of_texts(kernel) if texts else kernel, merge=lambda found: ranked(found).drop("rank"), **tiling
    )
    return ranked(best)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_K,
    floor: float | None = None,
    scope_columns: tuple[str, ...] = ("organization_id", "uploaded_by", "model"),
    **tiling,
) -> DataFrame:
    """Questions against embedded chunks: (query_id, rank, document_id, chunk_index, similarity)."""
    cols = list(scope_columns)
    hits = topk(embed_queries(queries, cols, floor), sparse_items(chunks, cols), k, **tiling)
    return hits.select(
        "query_id", "rank", *split_item(F.col("item_id")), F.round("score", 6).alias("similarity")
    )


def filtered_search(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame, *, source_type: str | None = None,
    metadata: dict[str, str | int | float | bool] | None = None, floor: float | None = None, k: int = DEFAULT_K,
    scope_columns: tuple[str, ...] = ("organization_id", "uploaded_by", "model"), **tiling,
) -> DataFrame:
    """``search`` among the ready chunks of one source type whose ``metadata`` (JSON text) holds the wanted values.

    The filters come before the search, so that the best k are the best of what passes.
    """
    ready = retrievable(chunks, documents, source_type)
    if metadata:
        ready = ready.filter(metadata_contains(F.col("metadata"), metadata))
    return search(queries, ready, k, floor, scope_columns, **tiling)


def tfidf_topk(
    queries: DataFrame, documents: DataFrame, key: str, text: str, k: int = 3, metric: str = "cosine", **tiling
) -> DataFrame:
    """TF-IDF search of (query_id, question) over (key, text); scores to four decimals.

    Euclidean scores are distances (smaller is nearer). Texts without any token still take part. Only the weights of
    question tokens reach the kernel, which skips blocks of texts whose largest weights cannot reach the k-th score.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    asked = queries.select(F.explode(tx.tokenize(F.col("question"))).alias("token"))
    terms, vocab = embedding.searchable_terms(documents, key, text, asked)
    own = embedding.tfidf_vectors(embedding.term_weights(queries, "query_id", "question", vocab), "query_id")
    q = queries.select("query_id").join(own, "query_id", "left").select(
        F.lit("").alias("scope"), "query_id",
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        F.coalesce("weights", F.array().cast("array<bigint>")).alias("weights"),
        F.coalesce(F.col("norm2").cast("double"), F.lit(0.0)).alias("norm2"),
        F.lit(float("-inf")).alias("floor"),
    )
    items = terms.withColumnRenamed(key, "item_id").withColumn("scope", F.lit(""))
    if metric == "cosine":  # texts that can score high come first, so that later blocks are left out by their bounds
        items = items.sortWithinPartitions(F.desc("impact"))
    items = items.drop("impact")
    hits = topk(q, items, k, metric, skip=metric == "cosine", **tiling)
    score = F.col("score") if metric == "cosine" else -F.col("score") / embedding.IDF_SCALE
    return hits.select("query_id", "rank", F.col("item_id").alias(key), F.round(score, 4).alias("score"))


def title_search(documents: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of title or file name; %, _ and \\ in the term are literal."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pattern = F.lit(f"%{escaped}%")
    return documents.filter(F.ilike(F.col("title"), pattern) | F.ilike(F.col("filename"), pattern))
