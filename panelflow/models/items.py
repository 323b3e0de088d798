"""Item x group x observation-count model with a person intercept (M8)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.models.mixed import fit_mixed_var
from panelflow.models.moments import ONE


def factor_columns(group: str, size: str, item: str, items: Sequence[str]) -> dict[str, dict]:
    """Columns of each main effect: the group flag, the count, and one column per item but the first."""
    return {group: {group: F.col(group).cast("double")}, size: {size: F.col(size).cast("double")},
            item: {f"{item}{i + 2}": (F.col(item) == v).cast("double") for i, v in enumerate(items[1:])}}


def design(long: DataFrame, group: str, size: str, item: str, items: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Treatment-coded columns of all effects up to the three-way product, and the columns of each term."""
    main = factor_columns(group, size, item, items)
    terms: dict[str, dict] = dict(main)
    for r in (2, 3):
        for names in combinations(main, r):
            cols = {"": F.lit(1.0)}
            for n in names:
                cols = {f"{a}_x_{b}" if a else b: x * y for a, x in cols.items() for b, y in main[n].items()}
            terms[":".join(names)] = cols
    # names differ from the source columns, which the expressions read
    out = long.withColumns({f"d_{c}": e for cols in terms.values() for c, e in cols.items()})
    return out, {t: [f"d_{c}" for c in cols] for t, cols in terms.items()}


def fit_items(moments: DataFrame, terms: dict[str, list[str]], outcome: str, **options) -> dict:
    """Random-intercept fit on the moments of ``design``."""
    x = [c for cols in terms.values() for c in cols]
    return fit_mixed_var(moments, [ONE, *x], [outcome], {outcome: [ONE, *x]}, {outcome: [ONE]}, **options)


def wald_terms(spark, fit: dict, terms: dict[str, list[str]], outcome: str) -> DataFrame:
    """(term, chisq, df): Wald test that all of a term's columns are 0, given the others."""
    names = fit["shape"].fixed[outcome]
    beta = np.array([fit["beta"][outcome][n] for n in names])
    rows = []
    for t, cols in terms.items():
        at = [names.index(c) for c in cols]
        rows.append((t, float(beta[at] @ np.linalg.solve(fit["cov"][np.ix_(at, at)], beta[at])), len(at)))
    return spark.createDataFrame(rows, "term string, chisq double, df int")


def prediction_grid(spark, fit: dict, terms: dict[str, list[str]], outcome: str, group: str, size: str, item: str,
                    items: Sequence[str], at_size: float, z: float = 1.96) -> DataFrame:
    """(group, item, estimate, se, lo, hi): marginal means of each group and item at one count."""
    grid = spark.createDataFrame([(g, float(at_size), v) for g in (0, 1) for v in items],
                                 f"`{group}` int, `{size}` double, `{item}` string")
    rows, _ = design(grid, group, size, item, items)
    x = [c for cols in terms.values() for c in cols]
    names, out = fit["shape"].fixed[outcome], []
    beta = np.array([fit["beta"][outcome][n] for n in names])
    for r in rows.collect():   # two rows per item
        v = np.array([1.0, *[r[c] for c in x]])
        mean, se = float(v @ beta), float(np.sqrt(max(v @ fit["cov"] @ v, 0.0)))
        out.append((r[group], r[item], mean, se, mean - z * se, mean + z * se))
    return spark.createDataFrame(out, f"`{group}` int, `{item}` string, estimate double, se double, lo double, hi double")
