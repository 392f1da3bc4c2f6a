"""Vectors as scaled whole numbers: sums do not depend on their order, so results are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import let, seal

# ---- fixed values -----------------------------------------------------------------------------
DIMENSIONS = 384
SCALE = 1_000_000
# -----------------------------------------------------------------------------------------------


def _fold(values: Column, step) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), step)


def run_starts(ordered: Column) -> Column:
    """0-based positions at which a new value begins in a sorted array."""
    at = F.sequence(F.lit(0), F.size(ordered) - 1)
    fresh = F.filter(at, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    return F.when(F.size(ordered) > 0, fresh).otherwise(F.array().cast("array<int>"))


def add_hashed_counts(df: DataFrame, tokens: Column, name: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Add signed feature hashing of each row's tokens: array<struct<slot,s>>, slots ascending.

    A token's sha-256 picks its slot (first four bytes) and sign (parity of the fifth). Slot and
    sign become one sortable number 2*slot+odd, so a slot's positive run lies right before its
    negative run and run lengths are the counts: linear in tokens, inside the row, in the JVM.
    """
    head = F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 10), 16, 10).cast("bigint"))
    code = F.transform(head, lambda v: (F.shiftright(v, 8) % dimensions * 2 + v % 2).cast("int"))
    keep = df.columns
    codes = df.select(*keep, seal(F.sort_array(code)).alias("_code"))
    runs = codes.select("*", seal(run_starts(F.col("_code"))).alias("_run"))

    def entry(start: Column, j: Column) -> Column:
        value = F.get("_code", start)
        size = F.coalesce(F.get("_run", j + 1), F.size("_code")) - start
        follows = F.get("_code", F.get("_run", j + 1)) == value + 1
        next_size = F.coalesce(F.get("_run", j + 2), F.size("_code")) - F.get("_run", j + 1)
        paired = F.coalesce(F.get("_code", start - 1) == value - 1, F.lit(False))
        negative = F.when(paired, 0).otherwise(-size)
        positive = size - F.when(follows, next_size).otherwise(0)
        total = F.when(value % 2 == 1, negative).otherwise(positive)
        return F.struct(F.shiftright(value, 1).alias("slot"), total.alias("s"))

    counts = F.filter(F.transform("_run", entry), lambda x: x.s != 0)
    return runs.select(*keep, seal(counts).alias(name))


def quantize_counts(counts: Column) -> Column:
    """L2-normalise signed counts and keep six decimals as whole numbers: array<struct<slot,q>>."""

    def scaled(norm: Column) -> Column:
        return F.filter(
            F.transform(
                counts,
                lambda x: F.struct(
                    x.slot.alias("slot"), F.round(x.s / norm * SCALE).cast("bigint").alias("q")
                ),
            ),
            lambda x: x.q != 0,
        )

    return let(F.sqrt(_fold(counts, lambda a, x: a + x.s * x.s).cast("double")), scaled)


def quantize(dense: Column) -> Column:
    """A dense float vector as six-decimal whole numbers."""
    return F.transform(dense, lambda v: F.round(v.cast("double") * SCALE).cast("bigint"))


def to_dense(sparse: Column, dimensions: int = DIMENSIONS) -> Column:
    """Sparse (slot, q) entries, slots ascending, laid out in full with zeros, as doubles."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    before = lambda j: F.coalesce(F.get(sparse, j - 1).slot, F.lit(-1))
    # Every entry brings the zeros in front of it: the parts are laid end to end once.
    parts = F.transform(sparse, lambda x, j: F.concat(zeros(x.slot - F.when(j == 0, -1).otherwise(before(j)) - 1), F.array(x.q)))
    tail = zeros(F.lit(dimensions) - F.coalesce(F.try_element_at(sparse, F.lit(-1)).slot, F.lit(-1)) - 1)
    filled = F.concat(F.flatten(parts), tail)
    return F.transform(filled, lambda q: q / F.lit(float(SCALE)))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y), lambda acc, x: acc + x)


def squared_norm(a: Column) -> Column:
    return _fold(a, lambda acc, x: acc + x * x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of whole-number vectors; zero when either has no length."""
    length = F.sqrt(squared_norm(a).cast("double")) * F.sqrt(squared_norm(b).cast("double"))
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b).cast("double") / length)


def euclidean(a: Column, b: Column) -> Column:
    squared = _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda acc, x: acc + x)
    return F.sqrt(squared.cast("double")) / F.lit(float(SCALE))


def l2_normalize(dense: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(dense, F.lit(0.0), lambda a, x: a + x * x))

    return let(norm, lambda n: F.when(n == 0, dense).otherwise(F.transform(dense, lambda x: x / n)))
