"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.columns import all_present, any_present
from panelflow.operators.aggregates import pooled_stats
from panelflow.operators.joins import attach
from panelflow.operators.observed import observed
from panelflow.operators.ordered import PERSON, part_keys
from panelflow.session import write_through


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (K1)."""
    return df.where(all_present(cols)) if cols else df


def exclude_ids(df: DataFrame, key: str, ids: Iterable) -> DataFrame:
    """Drop listed ids; a NULL id is kept (K2).  One anti join for a list of any length."""
    ids = list(ids)
    if not ids:
        return df
    drop = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([df.schema[key]]))
    return df.join(drop, on=key, how="left_anti")


def keep_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows with at least one of ``cols`` present (K3)."""
    return df.where(any_present(cols))


def complete_cases(df: DataFrame, cols: Sequence[str], counts: Observation | None = None) -> DataFrame:
    """Keep rows with all of ``cols`` present.

    ``counts`` gets ``n_rows``, ``n_dropped`` and ``missing_<column>``, the
    rows that lack each column.
    """
    if counts is not None:
        df = observed(df, counts, {"n_dropped": ~all_present(cols), **{f"missing_{c}": F.col(c).isNull() for c in cols}})
    return df.dropna(how="any", subset=list(cols))


def pooled_variance_flags(df: DataFrame, key: str, scales: Mapping[str, Sequence[str]],
                          threshold: float | None = None) -> DataFrame:
    """Per-row ``flag_any``: some scale of the person has an undefined pooled
    variance (fewer than two values), or one at/below ``threshold``.

    The pooled variance of a scale is the sample variance of all its item
    values of all the person's rows.  One aggregate per person (map-side
    combined) gives one flag row per person, which is joined back; rows
    without an id are one person.
    """
    if PERSON in df.columns:
        df = write_through(df)   # read for the moments, for the chunks and for the rows
    stats = pooled_stats(df, [key], scales, ("var",))
    flag = F.lit(False)
    for s in scales:
        bad = F.col(f"var_{s}").isNull()
        if threshold is not None:
            bad = bad | (F.col(f"var_{s}") <= F.lit(threshold))
        flag = flag | bad
    flags = stats.withColumn("flag_any", flag)
    keys = [key]
    if PERSON in df.columns:   # split persons: the flags travel by chunk
        chunks = df.select(key, *part_keys()).distinct()
        flags, keys = attach(chunks, flags, key, null_safe=True).drop(key), part_keys()
        return df.join(write_through(flags), on=keys, how="inner")
    return attach(df, flags, key, null_safe=True)


def variance_filter(df: DataFrame, key: str, scales: Mapping[str, Sequence[str]],
                    threshold: float | None = None) -> DataFrame:
    """Drop persons whose pooled scale variance is undefined (K8)."""
    d = pooled_variance_flags(df, key, scales, threshold)
    return d.where(~F.col("flag_any")).drop("flag_any", *[f"var_{s}" for s in scales])


def require_lags(df: DataFrame, cols: Sequence[str], dt: str = "dt") -> DataFrame:
    """Rows usable in a lagged design: all ``cols`` present and ``dt > 0``."""
    return df.dropna(how="any", subset=list(cols) + [dt]).where(F.col(dt) > 0)


def where_in(df: DataFrame, c: str, values: Iterable) -> DataFrame:
    """Membership filter."""
    return df.where(F.col(c).isin(list(values)))

