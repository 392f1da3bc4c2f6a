"""Joins of a result that is small in rows with a corpus that is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.session import cut_lineage

# Keys are at most two numbers wide, so this many rows stay within a few megabytes.
BROADCAST_ROWS = 200_000


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise narrow rows; broadcast them only when counting proves them few."""
    kept = cut_lineage(keys)
    return F.broadcast(kept) if kept.count() <= rows else kept


def reduce_to(corpus: DataFrame, wanted: DataFrame, on: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """The corpus rows whose key occurs in ``wanted``.

    With few keys the corpus is filtered where it lies; with many it is an ordinary semi join, where
    AQE splits skewed keys. What is left is as small as ``wanted``, so later joins are cheap.
    """
    return corpus.join(bounded(wanted.select(*on).distinct(), rows), on, "left_semi")
