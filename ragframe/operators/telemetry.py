"""Request and job telemetry: counters, sliding rates, histograms, exact index percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.functions import text as tx
from ragframe.operators.joins import bounded
from ragframe.session import cut_lineage

# ---- fixed values -----------------------------------------------------------------------------
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
AI_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]
JOB_BUCKETS = [0.01, 0.05, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0]
RATE_LIMIT = 100
AUTH_RATE_LIMIT = 10
RATE_WINDOW = "60 seconds"
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
# -----------------------------------------------------------------------------------------------


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests and errors (status >= 400) by method, route and status."""
    route = tx.normalize_route(F.col("path"))
    return requests.groupBy("method", route.alias("route"), "status").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")
    )


def sliding_rate(requests: DataFrame, label: str, length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Events per second over a sliding window. A streaming input works the same way."""
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    return requests.groupBy(F.window("ts", length, step), label).agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), label, "events",
        (F.col("events") / seconds).alias("per_second"),
    )


def error_pct(requests: DataFrame, label: str) -> DataFrame:
    counts = requests.groupBy(label).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors")
    )
    pct = F.lit(100.0) * F.col("errors") / F.greatest(F.col("requests").cast("double"), F.lit(0.0001))
    return counts.select(label, "requests", "errors", pct.alias("error_pct"))


def latency_histogram(df: DataFrame, value: str, label: str, buckets: list[float] = HTTP_BUCKETS) -> DataFrame:
    """Cumulative bucket counts per label, the +Inf bucket last.

    Every bucket is one conditional count of a single aggregation, so rows are never multiplied by
    the number of buckets; the wide result is unpivoted afterwards.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = df.groupBy(label).agg(*counts, F.count(value).alias("all"))
    bars = [
        F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("cumulative"))]
    return wide.select(label, F.explode(F.array(*bars)).alias("bar")).select(label, "bar.le", "bar.cumulative")


def histogram_quantile(histogram: DataFrame, label: str, q: float) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches q*N."""
    w = Window.partitionBy(label).orderBy("le")
    whole = Window.partitionBy(label)
    rows = histogram.select(
        "*",
        F.lag("le", 1, 0.0).over(w).alias("_lo"),
        F.lag("cumulative", 1, 0).over(w).alias("_below"),
        F.max("cumulative").over(whole).alias("_n"),
        F.max(F.when(F.col("le") != float("inf"), F.col("le"))).over(whole).alias("_top"),
    )
    target = F.col("_n") * F.lit(q)
    hit = rows.filter((F.col("cumulative") >= target) & (F.col("_n") > 0)).groupBy(label).agg(
        F.min_by(F.struct("le", "_lo", "_below", "cumulative", "_n", "_top"), "le").alias("b")
    )
    inside = F.col("b._lo") + (F.col("b.le") - F.col("b._lo")) * (
        (F.col("b._n") * F.lit(q) - F.col("b._below")) / (F.col("b.cumulative") - F.col("b._below"))
    )
    value = F.when(F.col("b.le") == float("inf"), F.col("b._top")).when(
        F.col("b.cumulative") == F.col("b._below"), F.col("b.le")
    ).otherwise(inside)
    return hit.select(label, value.alias("quantile"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Token totals by operation, provider and kind; zero counts leave no row."""
    kinds = ["prompt", "completion", "total"]
    long = calls.select("operation", "provider", *[F.col(f"{k}_tokens").alias(k) for k in kinds]).unpivot(
        ["operation", "provider"], kinds, "kind", "tokens"
    )
    return long.filter(F.col("tokens") > 0).groupBy("operation", "provider", "kind").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("calls")
    )


def latency_summary(df: DataFrame, value: str, label: str, cells: int = 64) -> DataFrame:
    """n, mean, index percentiles sorted[min(n-1, int(p*n))] and max per label, exactly.

    No label is ever sorted as a whole: equal values are counted first, sketched quantiles cut each
    label into ``cells`` ranges of about equal weight, exact counts per range tell where each rank
    falls, and only those ranges are ranked. The sketch decides sizes, never results.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(label, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = F.array(*[F.lit(i / cells) for i in range(1, cells)]) if cells > 1 else F.array(F.lit(0.5))
    stats = cut_lineage(df.groupBy(label).agg(
        F.count(value).alias("n"), F.sum(F.round(F.col(value) * 1000000).cast("bigint")).alias("micro"),
        F.max(value).alias("hi"), F.array_distinct(F.percentile_approx(value, cuts, 10 * cells)).alias("cuts"),
    ))
    cell = F.size(F.filter("cuts", lambda b: b < F.col("v")))
    placed = counts.join(bounded(stats.select(label, "cuts"), 1000), label).select(label, "v", "c", cell.alias("cell"))
    ladder = placed.groupBy(label, "cell").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(label).orderBy("cell")  # at most ``cells`` rows a label
    ladder = ladder.select(label, "cell", F.sum("c").over(w).alias("upto"), (F.sum("c").over(w) - F.col("c")).alias("below"))
    marks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in QUANTILES.items()])
    rank = F.least(F.col("n") - 1, F.floor(F.col("m.p") * F.col("n")))
    wanted = stats.select(label, "n", F.explode(marks).alias("m")).select(label, F.col("m.name").alias("name"), rank.alias("rank"))
    where = wanted.join(ladder, label).filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("upto")))
    in_cell = Window.partitionBy(label, "name").orderBy("v")
    ranked = where.join(placed, [label, "cell"]).select(
        label, "name", "rank", "v", (F.col("below") + F.sum("c").over(in_cell)).alias("reach")
    ).filter(F.col("reach") > F.col("rank"))
    found = ranked.groupBy(label).agg(
        *[F.min(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in QUANTILES]
    )
    return stats.join(found, label).select(
        label, "n", F.round(F.col("micro") / F.col("n") / 1000000, 4).alias("mean"), *QUANTILES, F.col("hi").alias("max")
    )


def throughput(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Rows per minute over the wall span of each label."""
    span = (F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1000000
    return df.groupBy(label).agg(F.count("*").alias("n"), span.alias("seconds")).select(
        label, "n", "seconds", F.when(F.col("seconds") > 0, F.col("n") * 60.0 / F.col("seconds")).alias("per_minute")
    )


def client_of(forwarded_for: Column, remote: Column) -> Column:
    """First address of ``x-forwarded-for``, else the socket's own."""
    first = tx.trim_ws(F.element_at(F.split(forwarded_for, ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), remote)


def rate_limit_breaches(requests: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """Clients over the limit per fixed window: a counted aggregate, so a busy client never
    gathers in one task."""
    counts = requests.groupBy(F.window("ts", window), "client").agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > limit).select(
        F.col("window.start").alias("window_start"), "client", "requests", (F.col("requests") - limit).alias("rejected")
    )
