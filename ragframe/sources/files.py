"""Raw-file scan and upload admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe import schemas
from ragframe.functions import text as tx

# ---- fixed values -----------------------------------------------------------------------------
MAX_BYTES = 25 * 1024 * 1024
MAX_NAME = 255
SNIFF = 1024
PDF_MAGIC = bytes([0x25, 0x50, 0x44, 0x46, 0x2D])
ZIP_MAGIC = bytes([0x50, 0x4B, 0x03, 0x04])
# -----------------------------------------------------------------------------------------------


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Stored objects under ``root/{organization}/{object}.{ext}`` with tenant and provenance.

    Spark plans no read for a file of zero bytes, so an empty object shows up in ``missing_objects``;
    the EMPTY_FILE rule is for bytes that arrive as rows.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    tail = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return raw.select(
        tail.alias("storage_key"),
        F.split(tail, "/")[0].alias("organization_id"),
        F.split(tail, "/")[1].alias("filename"),
        F.concat(F.lit("s3://"), tail).alias("source"),
        "length", "modificationTime", "content",
    )


def missing_objects(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose object is not in the store."""
    return manifest.join(files.select("storage_key"), "storage_key", "left_anti")


def admission_error(filename: Column, content: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Code of the first rule an upload breaks, null when it may enter."""
    safe = tx.sanitize_filename(filename)
    kind = F.substring(tx.extension(safe), 2, 10)
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    nul = F.position(F.lit("00"), F.regexp_replace(F.hex(F.substring(content, 1, SNIFF)), "(..)", "$1 ")) > 0
    return (
        F.when((safe == "") | (F.length(safe) > MAX_NAME), "INVALID_FILENAME")
        .when(~kind.isin(*schemas.SOURCE_TYPES), "UNSUPPORTED_FILE_TYPE")
        .when(length == 0, "EMPTY_FILE")
        .when(length > max_bytes, "FILE_TOO_LARGE")
        .when((kind == "pdf") & ~starts(PDF_MAGIC), "FILE_TYPE_MISMATCH")
        .when((kind == "docx") & ~starts(ZIP_MAGIC), "FILE_TYPE_MISMATCH")
        .when(kind.isin("md", "html", "txt") & nul, "FILE_TYPE_MISMATCH")
    )


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every upload with its clean name, type and verdict; split on ``error`` for the two sinks."""
    safe = tx.sanitize_filename(F.col("filename"))
    error = admission_error(F.col("filename"), F.col("content"), F.col("length"), max_bytes)
    mime = F.create_map(*[F.lit(x) for kv in schemas.MIME_TYPES.items() for x in kv])
    kind = F.substring(tx.extension(safe), 2, 10)
    return files.withColumn("error", error).select(
        *[c for c in files.columns if c not in ("filename",)],
        safe.alias("filename"),
        tx.title_from_filename(safe).alias("title"),
        F.when(F.col("error").isNull(), kind).alias("source_type"),
        F.when(F.col("error").isNull(), F.try_element_at(mime, kind)).alias("mime_type"),
        "error",
    )
