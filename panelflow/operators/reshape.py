"""Reshape and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.columns import number_in_name

ON_DUPLICATE = ("error", "first", "last", "max", "mean")


class DuplicateCellError(ValueError):
    """A (prompt, label) cell holds more than one response."""


def _cell(policy: str, hit: Column, value: str, seq: str) -> Column:
    v = F.when(hit, F.col(value))
    if policy == "first":
        return F.min_by(v, F.when(hit, F.col(seq)))
    if policy == "last":
        return F.max_by(v, F.when(hit, F.col(seq)))
    if policy == "mean":
        return F.avg(v.cast("double"))
    return F.max(v)        # "max", and "error" once the cells are known unique


def duplicate_cells(df: DataFrame, keys: Sequence[str], label: str,
                    labels: Sequence[str] | None = None) -> DataFrame:
    """(prompt, label) cells with more than one response, with their count."""
    d = df if labels is None else df.where(F.col(label).isin(list(labels)))
    return d.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def pivot_prompts(df: DataFrame, keys: Sequence[str], label: str, value: str,
                  labels: Sequence[str] | Mapping[str, str], *, seq: str | None = "seq",
                  on_duplicate: str = "error") -> DataFrame:
    """Long responses -> one row per prompt with a column per label.

    ``labels`` lists the labels to keep (optionally mapped to column
    names); a label nobody answered still gets an all-NULL column.  The
    explicit list prunes the pivot to one aggregate with no distinct-values
    job.  ``seq`` keeps the prompt's first input row number.  Repeated
    cells: ``error`` (default) raises, else first/last (by ``seq``)/max/mean.
    max and mean need a numeric value: the greatest text isn't the greatest
    number.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"on_duplicate must be one of {ON_DUPLICATE}")
    if on_duplicate in ("max", "mean") and isinstance(df.schema[value].dataType, T.StringType):
        raise ValueError(f"on_duplicate={on_duplicate!r} needs a numeric value; cast {value!r} first")
    names = dict(labels) if isinstance(labels, Mapping) else {v: v for v in labels}
    if on_duplicate == "error":
        bad = duplicate_cells(df, keys, label, list(names)).limit(1).collect()
        if bad:
            raise DuplicateCellError(f"repeated cell {bad[0].asDict()}; choose on_duplicate")
    aggs = [_cell(on_duplicate, F.col(label) == F.lit(v), value, seq or value).alias(n)
            for v, n in names.items()]
    if seq:
        aggs.insert(0, F.min(seq).alias(seq))
    return df.groupBy(*keys).agg(*aggs)


def unpivot_items(df: DataFrame, ids: Sequence[str], cols: Sequence[str], *,
                  name: str = "item", value: str = "value",
                  pattern: str | None = None, numeric_name: bool = False) -> DataFrame:
    """Wide -> long (R2-R4).  ``pattern`` keeps only the first capture group
    of the column name; ``numeric_name`` turns it into a number.  NULL
    values are kept, as in a plain melt."""
    # not ``unpivot``: code generated for its Expand node fails to compile where later
    # expressions share a part that reads the name, and Spark falls back to interpreting
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]
    d = df.select(*ids, F.inline(F.array(*cells)))
    if pattern and numeric_name:
        return d.withColumn(name, number_in_name(name, pattern))
    if pattern:
        d = d.withColumn(name, F.regexp_extract(F.col(name), pattern, 1))
    if numeric_name:
        d = d.withColumn(name, F.nullif(F.col(name), F.lit("")).try_cast("double"))
    return d


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-bind by column name; a missing column becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or first row per ``subset``."""
    return df.distinct() if not subset else df.dropDuplicates(list(subset))
