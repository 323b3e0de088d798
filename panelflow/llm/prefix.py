"""Ordered prefix sums within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def prefix_sums(df: DataFrame, group: list[str], levels: list[str], rest: list[str],
                value: Column, into: str = "before") -> DataFrame:
    """Add ``into``: the sum of ``value`` over the earlier rows of the group.

    Rows are ordered by ``levels`` (ascending, nulls first), then by
    ``rest``.  Each level is summed before the next finer one is scanned, so
    a window never holds more than the rows of one (group, levels) cell;
    end ``levels`` with a hash bucket to bound that.  Rows alike in all
    these columns are summed up first and dealt out again afterwards, so
    repeated rows don't fill a cell either.  ``value`` must depend on these
    columns alone.  Columns beyond them are dropped.
    """
    keys = [*group, *levels]
    df = df.select(*keys, *rest).groupBy(*keys, *rest).agg(F.count("*").alias("_m"))
    df = df.withColumn("_v", value)
    cell = Window.partitionBy(*keys).orderBy(*rest).rowsBetween(*_BEFORE)
    out = df.withColumn("_b", F.coalesce(F.sum(F.col("_v") * F.col("_m")).over(cell), F.lit(0)))
    sums = df.groupBy(*keys).agg(F.sum(F.col("_v") * F.col("_m")).alias("_s"))
    starts = sums
    for i in range(len(levels) - 1, -1, -1):
        outer, here = [*group, *levels[:i]], levels[i]
        level = sums.groupBy(*outer, here).agg(F.sum("_s").alias("_t"))
        w = Window.partitionBy(*outer).orderBy(here).rowsBetween(*_BEFORE)
        level = level.select(*outer, here, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias(f"_o{i}"))
        starts = _null_safe(starts, level, [*outer, here])
    starts = starts.withColumn("_start", sum((F.col(f"_o{i}") for i in range(len(levels))), F.lit(0)))
    out = _null_safe(out, starts.select(*keys, "_start"), keys)
    return (out.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
            .withColumn(into, F.col("_start") + F.col("_b") + F.col("_j") * F.col("_v"))
            .drop("_m", "_v", "_b", "_start", "_j"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet null keys."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])
