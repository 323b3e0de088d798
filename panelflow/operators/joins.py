"""Equi-joins of panels with person tables (J1-J4) and first rows (O3).

No join here forces a broadcast: person and covariate tables grow with the
number of persons.  With AQE on, Spark switches a join to a broadcast at
run time only when the measured size of a side is under
``spark.sql.autoBroadcastJoinThreshold``, and splits a skewed sort-merge
join partition; that is the size check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every shared column name (J1); error when none is shared.

    Rows whose key is null meet nothing, as in SQL; ``attach`` has a null-safe form.
    """
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("natural_join: no shared columns")
    return a.join(b, on=shared, how=how)


def attach(a: DataFrame, b: DataFrame, on: str | Sequence[str], how: str = "inner",
           null_safe: bool = False) -> DataFrame:
    """Equi-join by key (J2).  ``null_safe`` matches NULL with NULL."""
    keys = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return a.join(b, on=keys, how=how)
    rb = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return a.join(rb, on=cond, how=how).drop(*[f"_r_{k}" for k in keys])


def attach_person(df: DataFrame, persons: DataFrame, on: str | Sequence[str],
                  cols: Sequence[str] | None = None,
                  fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left-join person attributes and fill the unmatched."""
    keys = [on] if isinstance(on, str) else list(on)
    p = persons if cols is None else persons.select(*keys, *cols)
    out = df.join(p, on=keys, how="left")
    return out.fillna(dict(fill)) if fill else out


def keep_members(df: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Semi join: keep rows whose key is in ``members``."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(members.select(*keys), on=keys, how="left_semi")


def first_row(df: DataFrame, key: str, time: str, seq: str, cols: Sequence[str]) -> DataFrame:
    """The first row of each person in (time NULLS LAST, seq) order (O3).

    ``min_by`` over a sort struct is a partial aggregate (no window, no
    gathering of the person); a NULL time sorts after every time.
    """
    order = F.struct(F.col(time).isNull().alias("_tn"), F.col(time).alias("_t"),
                     F.col(seq).alias("_s"))
    rec = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(key).agg(F.min_by(rec, order).alias("_f")).select(key, "_f.*")



def unmatched(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a partner in ``other`` (anti join), for counts."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys), on=keys, how="left_anti")
