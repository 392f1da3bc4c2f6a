"""Approximate top-k by cells: keep the cell as a partition column of the stored vectors, probe few.

Cells come from trained centroids or from whole-number hyperplanes, which need no training and give every
engine the same cells. The stored table is partitioned by cell and read through a semi join with the cells
that the queries probe, which prunes its partitions at run time. Vectors within the probed cells are ranked
exactly by the same tiles as the exact search.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions import text as tx
from ragframe.functions import vectors as vx
from ragframe.operators import retrieval as rt

TRAIN_ROWS = 50_000
# Cells of the stored table are 2^PLANES; a query reads PROBES of them, the nearest by its distance to the planes.
PLANES = 5
PROBES = 26


def train_cells(vectors: DataFrame, key: str, vector: str, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids from k-means over at most ``TRAIN_ROWS`` vectors.

    Training looks at a bounded hash sample (centroids only steer probing); every vector is assigned
    and searchable afterwards.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    wanted = max(1, -(-n // TRAIN_ROWS))
    sample = vectors.filter(F.pmod(F.xxhash64(key), F.lit(wanted)) == 0)
    ready = sample.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine", initMode="k-means||").fit(ready)
    centers = np.array(model.clusterCenters())
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def nearest_cells(df: DataFrame, vector: str, centers: np.ndarray, probes: int) -> DataFrame:
    """Add ``cells``: the ``probes`` nearest centroids, nearest first. The centroids are few."""

    @F.pandas_udf("array<int>")
    def near(part: pd.Series) -> pd.Series:
        if not len(part):
            return pd.Series([], dtype=object)
        score = np.stack([np.asarray(v, dtype=float) for v in part]) @ centers.T
        return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return df.withColumn("cells", near(F.col(vector)))


def ann_topk(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, centers: np.ndarray, k: int = 5, probes: int = 2, **tiling
) -> DataFrame:
    """(query_id, item_id, score, rank) from the probed cells only."""
    placed = nearest_cells(vectors, vector, centers, 1)
    items = rt.dense_items(placed, key, vector, F.col("cells")[0].cast("string"))
    probing = nearest_cells(queries, vector, centers, probes).withColumn("cell", F.explode("cells"))
    q = rt.as_queries(rt.dense_items(probing, key, vector, F.col("cell").cast("string")))
    return rt.topk(q, items, k, "cosine", **tiling)


# ---- stored cells -------------------------------------------------------------------------------


def plane(number: int, dimensions: int) -> list[int]:
    """Components of a hyperplane's normal, from -1000 to 1000 by rule."""
    at = [number * dimensions + j + 1 for j in range(dimensions)]
    return [(x**3 * 2654435761 + x * 40503) % 2**32 // 65536 % 2001 - 1000 for x in at]


def margins(vector: Column, dimensions: int, planes: int = PLANES) -> Column:
    """Dot products of a whole-number vector with every plane: whole numbers, so cells never depend on rounding."""
    normals = [F.array(*[F.lit(v).cast("bigint") for v in plane(n, dimensions)]) for n in range(planes)]
    return F.array(*[vx.dot(vector, n) for n in normals])


def _bits(margin: Column, planes: int) -> Column:
    return sum((F.when(margin[n] >= 0, 1 << n).otherwise(0) for n in range(planes)), F.lit(0))


def write_cells(vectors: DataFrame, vector: str, path: str, dimensions: int, planes: int = PLANES) -> None:
    """Store ``vectors`` with their ``cell``, which is the table's partition column.

    Rows of a cell are dealt to several files by a hash, so that a hot cell is written by many tasks.
    """
    placed = vectors.select("*", tx.seal(margins(F.col(vector), dimensions, planes)).alias("_m"))
    placed = placed.select(*vectors.columns, _bits(F.col("_m"), planes).cast("int").alias("cell"))
    placed.write.partitionBy("cell").parquet(path)


def probe(queries: DataFrame, vector: str, dimensions: int, planes: int = PLANES, probes: int = PROBES) -> DataFrame:
    """``queries`` once per cell they read: those that the smallest sum of margins separates from their own."""
    asked = queries.select("*", tx.seal(margins(F.col(vector), dimensions, planes)).alias("_m"))
    cost = lambda mask: sum((F.when(mask.bitwiseAND(1 << n) != 0, F.abs(F.col("_m")[n])).otherwise(0) for n in range(planes)), F.lit(0))
    masks = F.transform(F.sequence(F.lit(0), F.lit((1 << planes) - 1)), lambda m: F.struct(cost(m).alias("cost"), m.alias("mask")))
    asked = asked.select(*queries.columns, _bits(F.col("_m"), planes).alias("_own"), tx.seal(F.slice(F.array_sort(masks), 1, probes)).alias("_p"))
    return asked.select(*queries.columns, "_own", F.explode("_p.mask").alias("_mask")).select(
        *queries.columns, F.col("_own").bitwiseXOR(F.col("_mask")).cast("int").alias("cell")
    )


def stored_topk(
    table: DataFrame, queries: DataFrame, key: str, vector: str, dimensions: int, k: int = 5, planes: int = PLANES,
    probes: int = PROBES, **tiling
) -> DataFrame:
    """(query_id, item_id, score, rank) of ``queries`` against a table written by ``write_cells``."""
    probing = probe(queries, vector, dimensions, planes, probes)
    read = table.join(F.broadcast(probing.select("cell").distinct()), "cell", "left_semi")  # at most 2^planes numbers
    items = rt.dense_items(read, key, vector, F.col("cell").cast("string"))
    q = rt.as_queries(rt.dense_items(probing, key, vector, F.col("cell").cast("string")))
    return rt.topk(q, items, k, "cosine", **tiling)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    hit = exact.select("query_id", "item_id").join(
        approximate.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left"
    )
    return hit.agg(
        F.count("*").alias("neighbours"), F.count("hit").alias("found"),
        F.round(F.count("hit") / F.count("*"), 6).alias("recall"),
    )
