"""Per-person moment sums (M1) and least-squares VAR fits on them (M2).

Rows go through Spark once: ``panel_moments`` and ``gram_moments`` are
grouped sums (a hot person is summed piecewise on the map side).  The
fits then work on one small row per person: pooled sums come back as one
row (p x p numbers), person-level fits run batched in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators.filters import complete_cases
from panelflow.operators.gram import gram_by_key
from panelflow.session import discard, write_through

ONE = "one"
SQL_SUMS = 100          # sums of one aggregate up to which Spark compiles it as one piece
MOMENTS = "panelflow.moments"
HELD = 1_000_000        # numbers of one stacked matrix that a task holds at a time


def _terms(x: Sequence[str], intercept: bool) -> list[str]:
    return ([ONE] if intercept else []) + list(x)


def _xcol(name: str):
    return F.lit(1.0) if name == ONE else F.col(name).cast("double")


def mname(a: str, b: str) -> str:
    return f"s__{a}__{b}"


def moment_names(terms: Sequence[str], y: Sequence[str]) -> list[str]:
    """Names of the sums of products of ``terms`` and ``y``, the upper triangle row by row."""
    names = [*terms, *y]
    return [mname(a, b) for i, a in enumerate(names) for b in names[i:]]


def panel_moments(df: DataFrame, key: str, x: Sequence[str], y: Sequence[str],
                  intercept: bool = True) -> DataFrame:
    """n, X'X (upper triangle), X'Y and Y'Y per person, complete rows only (M1).

    One column for each sum.  Up to ``SQL_SUMS`` they are SQL aggregates;
    more are taken from the sums of ``gram_moments``.
    """
    terms, names = _terms(x, intercept), [*_terms(x, intercept), *y]
    order = [mname(a, b) for i, a in enumerate(terms) for b in terms[i:]] + [mname(a, v) for a in terms for v in y] + \
        [mname(u, v) for i, u in enumerate(y) for v in y[i:]]
    if len(order) > SQL_SUMS:
        at = {n: i for i, n in enumerate(moment_names(terms, y))}
        wide = gram_moments(df, key, x, y, intercept)
        return wide.select(key, "n", *[F.get("g", F.lit(at[n])).alias(n) for n in order])
    d = df.dropna(how="any", subset=[*x, *y])
    product = {mname(a, b): _xcol(a) * _xcol(b) for i, a in enumerate(names) for b in names[i:]}
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(product[n]).alias(n) for n in order])


def gram_moments(df: DataFrame, key: str, x: Sequence[str], y: Sequence[str], intercept: bool = True,
                 counts: Observation | None = None) -> DataFrame:
    """(key, n, g): the sums of ``panel_moments`` as one array per person, for any number of columns (M1).

    The order of ``g`` is that of ``moment_names``; its metadata names them.
    ``counts`` gets the rows dropped as incomplete (K12).
    """
    d = complete_cases(df, [*x, *y], counts)
    out = gram_by_key(d, key, [*x, *y], one=intercept)
    return out.withMetadata("g", {MOMENTS: moment_names(_terms(x, intercept), y)})


def as_arrays(moments: DataFrame) -> tuple[DataFrame, list[str]]:
    """Moments as one array column ``g`` beside the others, and the names of its entries."""
    if "g" in moments.columns and MOMENTS in moments.schema["g"].metadata:
        return moments, list(moments.schema["g"].metadata[MOMENTS])
    names = [c for c in moments.columns if c.startswith("s__")]
    rest = [c for c in moments.columns if c not in names]
    return moments.select(*rest, F.array(*[F.col(f"`{c}`") for c in names]).alias("g")), names


def stacked(pdf: pd.DataFrame, names: Sequence[str], terms: Sequence[str], ys: Sequence[str]):
    """(W'W, W'Y, Y'Y) of all persons of a batch of ``as_arrays``, as arrays (persons, ...)."""
    at = {n: i for i, n in enumerate(names)}
    g = np.stack(pdf["g"].to_list()) if len(pdf) else np.zeros((0, len(names)))
    place = lambda a, b: at[mname(a, b)] if mname(a, b) in at else at[mname(b, a)]
    pick = lambda us, vs: g[:, np.array([[place(u, v) for v in vs] for u in us], int).reshape(len(us), len(vs))]
    return pick(terms, terms), pick(terms, ys), pick(ys, ys)


def pieces(batches: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The batches' rows, so few at a time that matrices of ``width`` numbers a person stay within HELD numbers."""
    step = max(1, HELD // max(1, width))
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            yield pdf.iloc[lo:lo + step]


def task_sums(parts: Iterable[np.ndarray]) -> Iterator[pd.DataFrame]:
    """(i, x): the sum of a task's vectors, one row for each place; a task without any gives no rows."""
    total = None
    for flat in parts:
        total = flat if total is None else total + flat
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "x": total})


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The vector whose entries are the sums of ``x`` by place ``i``; ``size`` numbers reach the driver."""
    out = np.zeros(size)
    for r in rows.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def total_moments(moments: DataFrame) -> dict[str, float]:
    """Each sum over all persons by name, with ``n`` (rows) and ``persons``."""
    arrays, names = as_arrays(moments)

    def run(batches):
        yield from task_sums(np.concatenate((np.stack(pdf["g"].to_list()).sum(axis=0), [pdf["n"].sum(), len(pdf)]))
                             for pdf in pieces(batches, len(names)))

    flat = _summed(arrays.select("n", "g").mapInPandas(run, "i int, x double"), len(names) + 2)
    return dict(zip([*names, "n", "persons"], map(float, flat), strict=True))


def pooled_ols(moments: DataFrame, x: Sequence[str], y: Sequence[str],
               intercept: bool = True, key: str | None = None, with_se: bool = True) -> dict:
    """Pooled least squares of every outcome on the same terms (M2).

    Returns coefficients ``B`` (p x q), residual covariance, n and persons,
    and with ``with_se`` the person-clustered covariance of each outcome's
    coefficients, which takes a second pass over the persons' sums (write
    them through before, if they are costly).  Only summed matrices reach
    the driver.
    """
    terms, y = _terms(x, intercept), list(y)
    total = total_moments(moments)
    one = pd.DataFrame({"g": [[v for k, v in total.items() if k not in ("n", "persons")]]})
    names = [k for k in total if k not in ("n", "persons")]
    xx, xy, yy = (a[0] for a in stacked(one, names, terms, y))
    b = np.linalg.solve(xx, xy)
    n, p, q = int(total["n"]), len(terms), len(y)
    out = {"terms": terms, "outcomes": y, "B": b, "resid_cov": (yy - xy.T @ b) / max(n - p, 1), "n": n, "persons": int(total["persons"])}
    if not with_se:
        return out
    arrays, names = as_arrays(moments)

    def meat(batches):
        # person-clustered sandwich: s_j = X_j'Y_j - X_j'X_j B, per outcome
        def sums():
            for pdf in pieces(batches, (p + q) ** 2):
                wxx, wxy, _ = stacked(pdf, names, terms, y)
                s = wxy - wxx @ b
                yield np.einsum("nik,njk->kij", s, s).ravel()

        yield from task_sums(sums())

    inv = np.linalg.inv(xx)
    meats = _summed(arrays.select("g").mapInPandas(meat, "i int, x double"), q * p * p).reshape(q, p, p)
    return {**out, "cluster_cov": [inv @ m @ inv for m in meats]}


def pooled_ols_table(moments: DataFrame, x: Sequence[str], y: Sequence[str],
                     intercept: bool = True, with_se: bool = False) -> DataFrame:
    """Coefficient table of :func:`pooled_ols` as a small DataFrame.

    ``with_se``: person-clustered standard errors, and a row per pair of
    outcomes with their residual covariance (term ``cov:<outcome>``).
    """
    if with_se:
        moments = write_through(moments)    # two passes: totals, then the clustered sums that need them
    fit = pooled_ols(moments, x, y, intercept, with_se=with_se)
    if with_se:
        discard(moments)
    rows = []
    for qi, v in enumerate(fit["outcomes"]):
        for i, t in enumerate(fit["terms"]):
            r = {"outcome": v, "term": t, "estimate": float(fit["B"][i, qi]), "n": fit["n"]}
            if with_se:
                r["se_cluster"] = float(np.sqrt(max(fit["cluster_cov"][qi][i, i], 0.0)))
            rows.append(r)
    if with_se:
        rows += [{"outcome": u, "term": f"cov:{v}", "estimate": float(fit["resid_cov"][i, j]), "n": fit["n"], "se_cluster": None}
                 for i, u in enumerate(fit["outcomes"]) for j, v in enumerate(fit["outcomes"]) if j >= i]
    schema = "outcome string, term string, estimate double, n bigint" + \
        (", se_cluster double" if with_se else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return moments.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def fit_by_person(moments: DataFrame, key: str, x: Sequence[str], y: Sequence[str],
                  intercept: bool = True, ridge: float = 0.0) -> DataFrame:
    """Least squares per person from its own moments (M2, person level).

    Runs batched in ``mapInPandas`` over the moments table (one row per
    person); a singular X'X gives NULL coefficients.
    """
    terms = _terms(x, intercept)
    y = list(y)
    fields = [T.StructField(key, moments.schema[key].dataType), T.StructField("n", T.LongType())]
    fields += [T.StructField(f"b_{v}_{t}", T.DoubleType()) for v in y for t in terms]
    schema = T.StructType(fields)

    arrays, names = as_arrays(moments)

    def solve(batches):
        p = len(terms)
        for pdf in pieces(batches, (p + len(y)) ** 2):
            xx, xy, _ = stacked(pdf, names, terms, y)
            xx = xx + ridge * np.eye(p)
            b = np.full(xy.shape, np.nan)
            fine = np.linalg.matrix_rank(xx, hermitian=True) == p
            if fine.any():
                b[fine] = np.linalg.solve(xx[fine], xy[fine])
            out = {key: pdf[key], "n": pdf["n"]}
            out.update({f"b_{v}_{t}": b[:, i, j] for j, v in enumerate(y) for i, t in enumerate(terms)})
            frame = pd.DataFrame(out)
            yield frame.astype(object).where(frame.notna(), None)

    return arrays.mapInPandas(solve, schema)
