"""Ranks over tables of distinct values with their counts.

A column's order statistics need only its distinct values and how often
each occurs.  Counting is a map-side combined aggregate, so a column of two
values is two rows from the first shuffle on, however many rows it has;
what is range partitioned, sorted and numbered afterwards are distinct
values, and no task holds more than its share of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import write_through

_BEFORE = (Window.unboundedPreceding, -1)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the keys are ``left``'s."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, ``x``, ``count``): each present value as double with its number of rows, or its sum of ``weight``."""
    d = df.where(F.col(value).isNotNull())
    return d.groupBy(*by, F.col(value).cast("double").alias("x")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("count"))


def running_counts(counts: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("x",)) -> DataFrame:
    """Adds ``before``, the rows of the group at smaller values, and ``n``, all rows of the group.

    ``counts`` has one row per (by, order) and its ``count``.  It is range
    partitioned and written once; running sums go over one range piece of a
    group, and over one row per (group, piece) across pieces.
    """
    by, order = list(by), list(order)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = write_through(counts.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))
    sums = d.groupBy(*by, "_p").agg(F.sum("count").alias("_c"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    sums = sums.select(*by, "_p", F.sum("_c").over(group).alias("n"),
                       F.coalesce(F.sum("_c").over(group.orderBy("_p").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"))
    piece = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(*_BEFORE)
    d = d.withColumn("_in", F.coalesce(F.sum("count").over(piece), F.lit(0)))
    return null_safe(d, sums, [*by, "_p"]).withColumn("before", F.col("_off") + F.col("_in")).drop("_p", "_off", "_in")


def ranked(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ``x``, ``count``, ``before``, ``n``): each distinct value; its rows have ranks before + 1 .. before + count."""
    return running_counts(value_counts(df, value, by), by)


def holds_rank(rank: Column) -> Column:
    """Whether a row of ``ranked`` has the value at a 1-based rank."""
    return (F.col("before") < rank) & (rank <= F.col("before") + F.col("count"))


def weighted_mean(x: Column) -> Column:
    """Mean aggregate of ``x`` over all rows that the rows of ``ranked`` stand for; null x are left out."""
    return F.try_divide(F.sum(x * F.col("count")), F.sum(F.when(x.isNotNull(), F.col("count"))).cast("double"))


def median_of_ranks() -> Column:
    """Median aggregate over the rows of ``ranked``: the mean of the middle value or two."""
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return F.avg(F.when(holds_rank(low) | holds_rank(high), F.col("x")))


def kept_between(first: Column, last: Column) -> Column:
    """How many of a row's ranks lie in first .. last."""
    return F.greatest(F.lit(0), F.least(F.col("before") + F.col("count"), last) - F.greatest(F.col("before") + 1, first) + 1)


def numbered(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Adds ``out``: 1, 2, ... along ``order`` over all rows, ties in no fixed order.

    Rows are range partitioned and written; a row's number is its place in
    its piece plus the sizes of the pieces before, one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = write_through(d.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = d.groupBy("_p").agg(F.min("_i").alias("_lo"), F.count("*").alias("_c"))
    offsets = sizes.select(F.col("_p").alias("_q"), "_lo", F.coalesce(
        F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"))
    return d.join(offsets, F.col("_p") == F.col("_q")).withColumn(
        out, F.col("_off") + F.col("_i") - F.col("_lo") + 1).drop("_p", "_q", "_i", "_lo", "_off")
