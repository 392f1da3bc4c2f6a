"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, root)``, root the least node of the component.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to its least
    neighbour. A hub's neighbours never meet in one task: its minimum is a partial aggregate, and the join
    that spreads it is one that adaptive execution splits. Each round is a table in the shared folder.
    Loops, repeated edges and null ends are ignored; a node without an edge is not returned.
    """
    pairs = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(pairs.distinct(), "edges")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(pairs)
        if after == state:
            break
        state = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    """Count and content sum of the edges: equal before and after a round when nothing moved."""
    h = F.xxhash64("a", "b")
    return tuple(pairs.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first())
