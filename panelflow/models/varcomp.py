"""Crossed random-intercept variance components and reliability (M7).

Method of moments (Henderson's method I) for ``y ~ 1 + (1|f1) + ... +
(1|fk)`` with crossed factors.  Everything needed are sums and counts by
``groupBy`` (partial aggregates): ``T0 = sum y^2``, ``Tmu = (sum y)^2 / N``,
``T_f = sum_level (sum y)^2 / n_level`` and the count forms below.  The
k+1 equations are then solved on the driver (a (k+1) x (k+1) system).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import write_through


def quadratic_forms(long: DataFrame, y: str, factors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (one per ``by``): N, T0, Tmu and per factor T_f, S_f = sum n_l^2, L_f levels, and per
    ordered pair C_f_g = sum_{levels of f} (sum_{levels of g} n_fg^2) / n_f.

    The rows are summed up once per cell of all factors and written; every
    form follows from these cells.
    """
    v, by = F.col("_y"), list(by)
    d = long.where(F.col(y).isNotNull()).select(*by, *factors, F.col(y).cast("double").alias("_y"))
    cells = write_through(d.groupBy(*by, *factors).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q")))
    beside = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))
    out = cells.groupBy(*by).agg(F.sum("_n").alias("N"), F.sum("_q").alias("T0"), (F.sum("_s") ** 2 / F.sum("_n")).alias("Tmu"))
    for f in factors:
        lv = cells.groupBy(*by, f).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        out = beside(out, lv.groupBy(*by).agg(
            F.sum(F.col("_s") ** 2 / F.col("_n")).alias(f"T_{f}"),
            F.sum(F.col("_n").cast("double") ** 2).alias(f"S_{f}"), F.count("*").alias(f"L_{f}")))
    for i, f in enumerate(factors):
        for g in factors[i + 1:]:
            cell = cells.groupBy(*by, f, g).agg(F.sum("_n").cast("double").alias("_m"))
            for a, b in ((f, g), (g, f)):
                per = cell.groupBy(*by, a).agg((F.sum(F.col("_m") ** 2) / F.sum("_m")).alias("_c"))
                out = beside(out, per.groupBy(*by).agg(F.sum("_c").alias(f"C_{a}_{b}")))
    return out


def variance_components(forms: dict, factors: Sequence[str]) -> dict:
    """Solve E[T_f - Tmu] and E[T0 - Tmu] for the component variances.

    Coefficients: own factor ``N - S_f/N``; other factor g in T_f:
    ``C_f_g - S_g/N``; error ``L_f - 1`` (L_f levels).  Row T0 - Tmu:
    ``N - S_g/N`` for each g and ``N - 1`` for the error.  Negative
    estimates are returned as they are.
    """
    k = len(factors)
    n = forms["N"]
    a = np.zeros((k + 1, k + 1))
    rhs = np.zeros(k + 1)
    for i, f in enumerate(factors):
        for j, g in enumerate(factors):
            a[i, j] = (n - forms[f"S_{g}"] / n) if f == g else (forms[f"C_{f}_{g}"] - forms[f"S_{g}"] / n)
        a[i, k] = forms[f"L_{f}"] - 1
        rhs[i] = forms[f"T_{f}"] - forms["Tmu"]
    for j, g in enumerate(factors):
        a[k, j] = n - forms[f"S_{g}"] / n
    a[k, k] = n - 1
    rhs[k] = forms["T0"] - forms["Tmu"]
    sol = np.linalg.solve(a, rhs)
    return {**{f: float(sol[i]) for i, f in enumerate(factors)}, "residual": float(sol[k])}


def fit_variance_components(long: DataFrame, y: str, factors: Sequence[str]) -> dict:
    """Quadratic forms on Spark, then the small solve (M7)."""
    return variance_components(quadratic_forms(long, y, factors).first().asDict(), factors)


def reliability_table(long: DataFrame, y: str, factors: Sequence[str], occasion: str, item: str,
                      sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(items, part, value): components and occasion reliability for each set of items.

    Each row is given the sets that its item belongs to, so all sets come
    from one pass; one row of forms per set reaches the driver.
    """
    of = F.array_compact(F.array(*[F.when(F.col(item).isin(list(m)), F.lit(name)) for name, m in sets.items()]))
    forms = quadratic_forms(long.withColumn("_set", F.explode(of)), y, factors, ["_set"])
    rows = []
    for r in forms.collect():
        vc = variance_components(r.asDict(), factors)
        rows += [(r["_set"], part, float(v)) for part, v in vc.items()]
        rows.append((r["_set"], "reliability", reliability(vc, occasion, item, len(sets[r["_set"]]))))
    return long.sparkSession.createDataFrame(rows, "items string, part string, value double")


def reliability(vc: dict, occasion: str, item: str, n_items: int) -> float:
    """Between-occasion reliability v_occ / (v_occ + v_item / k); negative
    components are clipped to 0 here only."""
    vo = max(vc[occasion], 0.0)
    vi = max(vc[item], 0.0)
    den = vo + vi / n_items
    return float(vo / den) if den > 0 else float("nan")
