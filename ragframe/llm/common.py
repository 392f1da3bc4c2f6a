"""Helpers that several operators share: reading, tables in the shared folder, words, row batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ragframe.session import checkpoint_dir, pin_session

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Documents are read by Python tasks in batches of this many rows, so that a batch stays a few megabytes.
BATCH_ROWS = 500


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and small Arrow batches, so that ``spark`` keeps its own."""
    own = pin_session(spark).newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can read."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later stages read it and never replay its lineage."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` and its folder, for tables that can be deleted before the result is read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later job reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(column, UPPER, UPPER.lower())


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``rows`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """``(row, doc)``: the rows of ``docs`` as structs, so that no name of theirs can clash, and their numbers.

    The table is written once. Numbers follow the splits of a scan, which change with the executors that are there
    when it runs, so jobs that number the rows anew cannot be joined by them.
    """
    fields = [F.col(f"`{c}`") for c in docs.columns]
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*fields).alias("doc")), "rows")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as no bytes."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
