"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next.

Every stage works on whole texts of all that its predecessor kept. The first four return the columns they were
given; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm import decontaminate, lines, pieces, quality, shingles
from ragframe.llm.common import BATCH_ROWS, own_session, shared_path, table
from ragframe.session import pin_session

# Near-duplicate stages take shingles of five words and link texts whose sets of them are this similar (Jaccard).
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def prepared(spark: SparkSession) -> SparkSession:
    """Settings of a stage, on the session that its documents belong to; ``run`` has one of its own."""
    pin_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = quality.train(docs, table(prepared(spark), sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are equal or similar to an earlier line; documents with nothing else go.

    ``n_chars``, where there is one, counts what is left.
    """
    prepared(spark)
    kept = lines.drop_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    prepared(spark)
    return shingles.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth a twentieth of their words."""
    return decontaminate.drop_documents(docs, table(prepared(spark), sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_ids, ids, round_trip): ids of every text, and whether they decode to it."""
    prepared(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "lang", "source", F.size("ids").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]
# A learned model and a text search over pieces: no SQL states these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that every stage kept, in the last stage's columns."""
    spark = own_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
