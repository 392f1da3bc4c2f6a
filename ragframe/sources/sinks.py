"""Keyed sinks: upsert, idempotent insert, all-or-nothing publish, cascade delete, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``.

    max_by combines on the map side, so a key with very many versions never gathers in one task.
    """
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*").select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` put over rows of equal keys.

    Where ``new`` can repeat a key, ``order`` says which of its rows came last.
    """
    new = new if order is None else latest(new, keys, order)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(candidates: DataFrame, existing: DataFrame, keys: list[str], parents: DataFrame, parent_key: str) -> DataFrame:
    """Candidates that have a parent and no row yet, one per key: safe to run again and again."""
    return (
        candidates.join(parents.select(parent_key), parent_key, "left_semi")
        .join(existing.select(*keys), keys, "left_anti")
        .dropDuplicates(keys)
    )


def publishable(rows: DataFrame, owner: str, ok: Column, owners: DataFrame) -> DataFrame:
    """Owners all of whose rows are good: they appear together or not at all. Without a row nothing appears."""
    counted = rows.groupBy(owner).agg(
        F.count("*").alias("rows"), F.count_if(~ok).alias("bad_rows"), F.bool_and(ok).alias("publish")
    )
    none = {"rows": 0, "bad_rows": 0, "publish": False}
    return owners.select(owner).distinct().join(counted, owner, "left").fillna(none)


def cascade_delete(documents: DataFrame, children: dict[str, DataFrame], doomed: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Documents and all dependent rows without the doomed ones."""
    gone = doomed.select(key).distinct()
    kept = {"documents": documents.join(gone, key, "left_anti")}
    for name, df in children.items():
        kept[name] = df.join(gone, key, "left_anti")
    return kept


def orphan_audit(documents: DataFrame, children: dict[str, DataFrame], key: str = "document_id") -> DataFrame:
    """Rows per child table that point at no document."""
    out = None
    for name, df in children.items():
        one = df.select(key).join(documents.select(key), key, "left_anti").agg(F.count("*").alias("orphans"))
        one = one.select(F.lit(name).alias("child"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


# ---- tables on disk -----------------------------------------------------------------------------


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Append one micro-batch as its own partition; the same batch delivered again replaces itself.

    Nothing that is stored already is read or rewritten. ``latest`` over the table gives the current rows.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)
