"""Smooth response curves (M6): logistic regression on spline columns.

The basis is built with column expressions (cubic truncated-power spline
of ``x`` at quantile knots, each column also times the 0/1 group), then
fitted by Fisher scoring on summed scores.  Knots are exact quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.ranks import holds_rank, ranked
from panelflow.session import write_through


def spline_columns(x: str, knots: Sequence[float], prefix: str = "s") -> dict:
    """x, x^2, x^3 and (x - k)^3_+ for each knot."""
    c = F.col(x).cast("double")
    cols = {f"{prefix}1": c, f"{prefix}2": c * c, f"{prefix}3": c * c * c}
    for i, k in enumerate(knots):
        d = F.greatest(c - F.lit(float(k)), F.lit(0.0))
        cols[f"{prefix}k{i + 1}"] = d * d * d
    return cols


def exact_knots(df: DataFrame, x: str, n_knots: int) -> list[float]:
    """Values at the ranks of the inner quantiles: the same for any partitioning."""
    if n_knots < 1:
        return []
    r = ranked(df, x)
    place = [F.greatest(F.lit(1), F.ceil(F.col("n") * ((i + 1) / (n_knots + 1)))) for i in range(n_knots)]
    row = r.agg(*[F.max(F.when(holds_rank(p), F.col("x"))) for p in place]).first()
    return sorted({v for v in row if v is not None})


def fit_response_curve(df: DataFrame, x: str, y: str, group: str | None = None, *,
                       extra: Sequence[str] = (), n_knots: int = 3, cluster: str | None = None,
                       max_iter: int = 50, tol: float = 1e-8) -> DataFrame:
    """Logistic fit of ``y ~ extra + s(x) + s(x):group`` (group 0/1): (term, estimate, std_error).

    Scoring steps on sums: each pass is one grouped aggregate of the score
    and the information over all rows.  ``std_error`` is clustered by
    ``cluster`` if given.  A last row ``converged`` tells (1 or 0) whether
    the largest step fell below ``tol`` within ``max_iter`` passes.
    """
    d = df.dropna(subset=[x, y, *extra] + ([group] if group else []))
    knots = exact_knots(d, x, n_knots)
    # scale x to [0, 1]-ish so the cubic columns stay well conditioned
    lo, hi = d.agg(F.min(x), F.max(x)).first()
    span = (hi - lo) if hi is not None and hi > lo else 1.0
    d = d.withColumn("_xs", (F.col(x) - F.lit(lo)) / F.lit(span))
    basis = spline_columns("_xs", [(k - lo) / span for k in knots])
    d = d.withColumns(basis)
    terms = list(extra) + list(basis)
    if group:
        inter = {f"{b}_x_{group}": F.col(b) * F.col(group).cast("double") for b in basis}
        d = d.withColumns(inter)
        terms += [group] + list(inter)
    key = [cluster] if cluster else []
    d = write_through(d.select(*key, F.col(y).cast("double").alias("_y"), *[F.col(t).cast("double").alias(t) for t in terms]))
    p, names = len(terms) + 1, ["(Intercept)", *terms]
    columns = [F.lit(1.0), *[F.col(t) for t in terms]]
    beta, converged = np.zeros(p), False

    def scored(b):
        eta = sum((F.lit(float(v)) * c for v, c in zip(b, columns, strict=True)), F.lit(0.0))
        return d.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))

    def information(b):
        w = F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = scored(b).agg(*[F.sum((F.col("_y") - F.col("_p")) * c) for c in columns],
                            *[F.sum(w * columns[i] * columns[j]) for i, j in pairs]).first()
        info = np.zeros((p, p))
        for (i, j), v in zip(pairs, row[p:], strict=True):
            info[i, j] = info[j, i] = v
        return np.array(row[:p]), info

    for _ in range(max_iter):
        score, info = information(beta)
        step = np.linalg.lstsq(info, score, rcond=1e-12)[0]
        beta = beta + step
        if np.abs(step).max() <= tol * (1 + np.abs(beta).max()):
            converged = True
            break
    bread = np.linalg.pinv(information(beta)[1], rcond=1e-12)
    cov = bread
    if cluster:
        per = scored(beta).groupBy(cluster).agg(*[F.sum((F.col("_y") - F.col("_p")) * c).alias(f"s{i}") for i, c in enumerate(columns)])
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = per.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
        meat = np.zeros((p, p))
        for (i, j), v in zip(pairs, row, strict=True):
            meat[i, j] = meat[j, i] = v
        cov = bread @ meat @ bread
    rows = [(n, float(e), float(s)) for n, e, s in zip(names, beta, np.sqrt(np.maximum(np.diag(cov), 0)), strict=True)]
    rows.append(("converged", float(converged), None))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double")
