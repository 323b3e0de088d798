"""Local quadratic regression with a band on a grid (M9).

At a grid point ``g`` the nearest ``span`` of a group's rows, at distance
``h`` at most, get tricube weights ``(1 - |d|^3)^3``, ``d = (x - g) / h``,
and a weighted parabola in ``d`` is fitted.  Rows never meet all grid
points:

* rows are summed up per distinct x, ranked by running counts (see
  ``operators.ranks``) and cut into cells of equal rank width;
* a cell keeps the moments of x and y about its own middle.  On either side
  of ``g`` the tricube is a polynomial, so a cell that lies on one side and
  within ``h`` gives its share of all weighted sums from its moments alone;
* the bandwidth is an order statistic of distances: cell borders bracket it,
  and only the rows of the cells in the bracket are looked at;
* only the cells that hold ``g`` or an end of its window are read row by row,
  through an equi-join on the cell.

Work is rows x constant + grid x cells; the cells' number is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.operators.aggregates import Z95
from panelflow.operators.ranks import null_safe, running_counts
from panelflow.session import discard, write_through

GRID, SPAN, CELLS = 80, 0.75, 1024
DEGREE = 2
# Powers of d in the tricube and in its square, right of g; left of it odd powers change sign.
_W = {0: 1.0, 3: -3.0, 6: 3.0, 9: -1.0}
_W2 = {3 * k: float(comb(6, k) * (-1) ** k) for k in range(7)}
_TOP_X, _TOP_Y = max(_W2) + 2 * DEGREE, max(_W) + DEGREE
# Weighted sums of a grid point: w d^0..4, w^2 d^0..4, w y d^0..2.
_N_X, _N_Y = 2 * DEGREE + 1, DEGREE + 1
_SUMS = 2 * _N_X + _N_Y


def _power(columns: dict[int, str], j: int) -> Column:
    """Product of the columns of u^1, u^2, u^4, ... that make u^j."""
    out = F.lit(1.0)
    for bit, name in columns.items():
        if j & bit:
            out = out * F.col(name)
    return out


def _points(df: DataFrame, x: str, y: str, by: Sequence[str], cells: int) -> DataFrame:
    """(_g, x, count, mean, ss, cell, n): distinct x of each group, its rows, their mean and squared deviations of y."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.to_json(F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))).alias("_g"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = d.groupBy("_g", "x").agg(F.count("*").alias("count"), F.avg("y").alias("mean"),
                                 (F.var_pop("y") * F.count("*")).alias("ss"))
    d = running_counts(d, ["_g"])
    return write_through(d.withColumn("cell", F.floor(F.col("before") * F.lit(cells) / F.col("n")).cast("long")).drop("before"))


def _cells(points: DataFrame) -> DataFrame:
    """(_g, cell, lo, hi, rows, mx, my): each cell's borders and its moments in u = (x - middle) / half width."""
    ends = points.groupBy("_g", "cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    half = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 2).otherwise(F.lit(1.0))
    d = points.join(ends, ["_g", "cell"]).withColumn("_u1", (F.col("x") - (F.col("lo") + F.col("hi")) / 2) / half)
    names = {1: "_u1"}
    while 2 * max(names) <= _TOP_X:
        j = max(names)
        d = d.withColumn(f"_u{2 * j}", F.col(names[j]) * F.col(names[j]))
        names[2 * j] = f"_u{2 * j}"
    mx = [F.sum(F.col("count") * _power(names, j)) for j in range(_TOP_X + 1)]
    my = [F.sum(F.col("count") * F.col("mean") * _power(names, j)) for j in range(_TOP_Y + 1)]
    return write_through(d.groupBy("_g", "cell").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("count").alias("rows"),
        F.array(*mx).alias("mx"), F.array(*my).alias("my")))


def _distances(lo: np.ndarray, hi: np.ndarray, g: np.ndarray):
    """Nearest and farthest distance of each cell (column) from each grid point (row)."""
    near = np.maximum(np.maximum(lo[None, :] - g[:, None], g[:, None] - hi[None, :]), 0.0)
    far = np.maximum(np.abs(lo[None, :] - g[:, None]), np.abs(hi[None, :] - g[:, None]))
    return near, far


def _bracket(grid: int, span: float):
    """Per group: for each grid point the cells among whose rows the bandwidth is, and the rank still to go there."""
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("lo")
        lo, hi, rows, name = (cells[c].to_numpy() for c in ("lo", "hi", "rows", "cell"))
        g = np.unique(np.linspace(lo[0], hi[-1], grid))
        need = int(min(rows.sum(), max(1, np.floor(rows.sum() * span + 1e-5))))
        near, far = _distances(lo, hi, g)
        out = []
        for i, at in enumerate(g):
            by_near, by_far = np.argsort(near[i], kind="stable"), np.argsort(far[i], kind="stable")
            least = near[i][by_near][np.searchsorted(np.cumsum(rows[by_near]), need)]
            most = far[i][by_far][np.searchsorted(np.cumsum(rows[by_far]), need)]
            inside = far[i] < least
            open_ = (near[i] <= most) & ~inside
            out.append((i, at, need - int(rows[inside].sum()), name[open_].tolist()))
        return pd.DataFrame({"_g": key[0], "i": [o[0] for o in out], "g": [o[1] for o in out],
                             "need": [o[2] for o in out], "cells": [o[3] for o in out]})
    return run


def _shifted(moments: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Moments of alpha + beta u from those of u: (cells, degrees), by cell."""
    top = moments.shape[1] - 1
    pa, pb = (np.ones((len(v), top + 1)) for v in (alpha, beta))
    for j in range(1, top + 1):
        pa[:, j], pb[:, j] = pa[:, j - 1] * alpha, pb[:, j - 1] * beta
    scaled = moments * pb
    out = np.zeros_like(moments)
    for m in range(top + 1):
        for j in range(m + 1):
            out[:, m] += comb(m, j) * pa[:, m - j] * scaled[:, j]
    return out


def _whole_cells(key: tuple, cells: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
    """Per group: each grid point's sums over the cells that lie on one side of it within its bandwidth, and its border cells."""
    cells = cells.sort_values("lo")
    lo, hi, name = (cells[c].to_numpy() for c in ("lo", "hi", "cell"))
    mx, my = (np.stack(cells[c].to_list()) for c in ("mx", "my"))
    middle, half = (lo + hi) / 2, np.where(hi > lo, (hi - lo) / 2, 1.0)
    out = []
    for i, g, h in zip(at["i"], at["g"], at["h"], strict=True):
        near, far = (v[0] for v in _distances(lo, hi, np.array([g])))
        touched = near < h if h > 0 else near <= 0
        whole = touched & (far <= h) & ((lo >= g) | (hi <= g)) & (h > 0)
        sums = np.zeros(_SUMS)
        if whole.any():
            alpha, beta = (middle[whole] - g) / h, half[whole] / h
            sx, sy = _shifted(mx[whole], alpha, beta), _shifted(my[whole], alpha, beta)
            for right in (True, False):
                side = (lo[whole] >= g) if right else (lo[whole] < g)
                px, py = sx[side].sum(axis=0), sy[side].sum(axis=0)
                sign = 1.0 if right else -1.0
                for a in range(_N_X):
                    sums[a] += sum(c * sign ** k * px[k + a] for k, c in _W.items())
                    sums[_N_X + a] += sum(c * sign ** k * px[k + a] for k, c in _W2.items())
                for a in range(_N_Y):
                    sums[2 * _N_X + a] += sum(c * sign ** k * py[k + a] for k, c in _W.items())
        out.append((i, g, h, sums.tolist(), name[touched & ~whole].tolist()))
    return pd.DataFrame({"_g": key[0], "i": [o[0] for o in out], "g": [o[1] for o in out], "h": [o[2] for o in out],
                         "sums": [o[3] for o in out], "cells": [o[4] for o in out]})


def _solved(batches):
    """Fit, slope, and the two traces' shares at each grid point from its weighted sums."""
    for pdf in batches:
        s = np.stack(pdf["sums"].to_list()) if len(pdf) else np.zeros((0, _SUMS))
        index = np.add.outer(np.arange(_N_Y), np.arange(_N_Y))
        a, b, t = s[:, index], s[:, _N_X + index], s[:, 2 * _N_X:]
        inv = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
        beta = np.einsum("nij,nj->ni", inv, t)
        h = pdf["h"].to_numpy()
        yield pdf[["_g", "i", "g", "h"]].assign(
            fit=beta[:, 0], slope=np.divide(beta[:, 1], h, out=np.zeros(len(h)), where=h > 0),
            lever=inv[:, 0, 0], spread=np.einsum("ni,nij,nj->n", inv[:, 0], b, inv[:, 0]))


def _grid_fits(points: DataFrame, cells: DataFrame, grid: int, span: float) -> DataFrame:
    """(_g, i, g, h, fit, slope, lever, spread) at each grid point."""
    asked = cells.select("_g", "cell", "lo", "hi", "rows").groupBy("_g").applyInPandas(
        _bracket(grid, span), "_g string, i int, g double, need long, cells array<long>")
    near = asked.select("_g", "i", "g", "need", F.explode("cells").alias("cell")).join(points, ["_g", "cell"])
    near = near.groupBy("_g", "i", "g", "need", F.abs(F.col("x") - F.col("g")).alias("d")).agg(F.sum("count").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g", "i").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    width = near.withColumn("upto", upto).where("upto >= need").groupBy("_g", "i", "g").agg(
        (F.min("d") * F.lit(max(1.0, span))).alias("h"))
    whole = write_through(cells.groupBy("_g").cogroup(width.groupBy("_g")).applyInPandas(
        _whole_cells, "_g string, i int, g double, h double, sums array<double>, cells array<long>"))
    rows = whole.select("_g", "i", "g", "h", F.explode("cells").alias("cell")).join(points, ["_g", "cell"])
    d = F.when(F.col("h") > 0, (F.col("x") - F.col("g")) / F.col("h")).otherwise(F.lit(0.0))
    rows = rows.where((F.abs(F.col("x") - F.col("g")) < F.col("h")) | (F.col("x") == F.col("g"))).withColumn("d", d)
    cube = F.abs(F.col("d") * F.col("d") * F.col("d"))
    rows = rows.withColumn("w", F.col("count") * (1 - cube) * (1 - cube) * (1 - cube))
    rows = rows.withColumn("w2", F.when(F.col("count") > 0, F.col("w") * F.col("w") / F.col("count")))
    power = lambda j: F.lit(1.0) if j == 0 else F.pow(F.col("d"), F.lit(float(j)))
    parts = [F.sum(F.col("w") * power(j)) for j in range(_N_X)] + [F.sum(F.col("w2") * power(j)) for j in range(_N_X)] + \
        [F.sum(F.col("w") * F.col("mean") * power(j)) for j in range(_N_Y)]
    border = rows.groupBy("_g", "i").agg(F.array(*parts).alias("more"))
    both = whole.join(border, ["_g", "i"], "left").withColumn("sums", F.zip_with(
        "sums", F.coalesce("more", F.array_repeat(F.lit(0.0), _SUMS)), lambda u, v: u + v))
    out = write_through(both.select("_g", "i", "g", "h", "sums").mapInPandas(
        _solved, "_g string, i int, g double, h double, fit double, slope double, lever double, spread double"))
    discard(whole)
    return out


def _variances(points: DataFrame, fits: DataFrame) -> DataFrame:
    """(_g, variance, n): residual variance of each group.

    The fit at a row lies between those of its grid neighbours, as a cubic
    with their values and slopes; the rows' leverages between theirs in a
    straight line.  The residual sum is divided by n - 2 tr L + tr LL'.
    """
    table = fits.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "g", "fit", "slope", "lever", "spread"))).alias("t"))
    last = F.size("t") - 1
    d = points.join(table, "_g")
    step = F.when(last > 0, (F.get("t", last)["g"] - F.get("t", F.lit(0))["g"]) / last).otherwise(F.lit(1.0))
    i = F.greatest(F.lit(0), F.least(F.floor((F.col("x") - F.get("t", F.lit(0))["g"]) / step), last - 1)).cast("int")
    d = d.select("_g", "x", "count", "mean", "ss", "n", F.get("t", i).alias("a"), F.get("t", F.least(i + 1, last)).alias("b"))
    wide = F.col("b.g") - F.col("a.g")
    u = F.when(wide > 0, (F.col("x") - F.col("a.g")) / wide).otherwise(F.lit(0.0))
    d = d.withColumns({"u": u, "wide": wide})
    u, v = F.col("u"), 1 - F.col("u")
    fit = (v * v * (1 + 2 * u) * F.col("a.fit") + u * u * (3 - 2 * u) * F.col("b.fit")
           + u * v * v * F.col("wide") * F.col("a.slope") - u * u * v * F.col("wide") * F.col("b.slope"))
    lost = v * (2 * F.col("a.lever") - F.col("a.spread")) + u * (2 * F.col("b.lever") - F.col("b.spread"))
    away = F.col("mean") - fit
    sums = d.groupBy("_g").agg(F.sum(F.col("ss") + F.col("count") * away * away).alias("rss"),
                               F.sum(F.col("count") * lost).alias("lost"), F.first("n").alias("n"))
    left = F.col("n") - F.col("lost")
    return sums.select("_g", F.when(left > 0, F.col("rss") / left).alias("variance"), "n")


def local_regression(df: DataFrame, x: str, y: str, by: Sequence[str] = (), *, grid: int = GRID, span: float = SPAN,
                     cells: int = CELLS, z: float = Z95) -> DataFrame:
    """(by, ``x``, ``estimate``, ``se``, ``lo``, ``hi``, ``bandwidth``, ``n``): the local fit at ``grid`` points of each group's range.

    Rows lacking x or y don't count; null group values are a group.  A group
    whose rows all have one x has one grid point, their mean.  Where fewer
    than three x lie within the bandwidth the parabola of least norm is
    taken.  ``se`` is null where no degrees of freedom are left.
    """
    by = list(by)
    points = _points(df, x, y, by, cells)
    table = _cells(points)
    fits = _grid_fits(points, table, grid, span)
    names = df.select(*by, F.to_json(F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))).alias("_g")).distinct()
    variances = write_through(_variances(points, fits))
    discard(points, table)
    out = null_safe(fits.join(variances, "_g"), names, ["_g"])
    se = F.sqrt(F.col("variance") * F.greatest(F.lit(0.0), F.col("spread")))
    return out.select(*by, F.col("g").alias("x"), F.col("fit").alias("estimate"), se.alias("se"),
                      (F.col("fit") - F.lit(z) * se).alias("lo"), (F.col("fit") + F.lit(z) * se).alias("hi"),
                      F.col("h").alias("bandwidth"), "n")
