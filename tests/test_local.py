"""Local regression: against direct weighted least squares over all rows."""
import numpy as np
import pandas as pd
import pytest

from panelflow.models import local as L


def direct(x, y, grid, span):
    """Fit, standard error and bandwidth at each grid point from all rows; traces by interpolation as documented."""
    n = len(x)
    g = np.linspace(x.min(), x.max(), grid)
    q = max(1, int(np.floor(n * span + 1e-5)))
    fit, slope, lever, spread, width = (np.zeros(grid) for _ in range(5))
    for i, at in enumerate(g):
        d = np.abs(x - at)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
        m = np.stack([np.ones(n), (x - at) / h, ((x - at) / h) ** 2], 1)
        inv = np.linalg.inv(m.T @ (w[:, None] * m))
        beta = inv @ (m.T @ (w * y))
        fit[i], slope[i], lever[i], width[i] = beta[0], beta[1] / h, inv[0, 0], h
        spread[i] = (inv @ (m.T @ ((w * w)[:, None] * m)) @ inv)[0, 0]
    k = np.clip(np.floor((x - g[0]) / (g[1] - g[0])).astype(int), 0, grid - 2)
    u, s = (x - g[k]) / (g[k + 1] - g[k]), g[k + 1] - g[k]
    at = ((1 - u) ** 2 * (1 + 2 * u) * fit[k] + u ** 2 * (3 - 2 * u) * fit[k + 1]
          + u * (1 - u) ** 2 * s * slope[k] - u ** 2 * (1 - u) * s * slope[k + 1])
    lost = ((1 - u) * (2 * lever[k] - spread[k]) + u * (2 * lever[k + 1] - spread[k + 1])).sum()
    return g, fit, np.sqrt(((y - at) ** 2).sum() / (n - lost) * spread), width


@pytest.mark.parametrize(("cells", "span"), [(4, 0.75), (37, 0.3), (4096, 0.75)])
def test_against_all_rows(spark, cells, span):
    rng = np.random.default_rng(cells)
    frames = []
    for name, n in (("a", 400), (None, 150)):
        x = np.where(rng.random(n) < 0.15, 5.0, rng.gamma(2, 3, n))         # many rows share one x
        frames.append(pd.DataFrame({"p": name, "x": x, "y": np.sin(x / 3) + rng.normal(0, 0.3, n) + 100}))
    frames[0].loc[:200, "x"] = np.round(frames[0].loc[:200, "x"])
    df = spark.createDataFrame(pd.concat(frames), "p string, x double, y double").repartition(3)
    got = L.local_regression(df, "x", "y", ["p"], grid=30, span=span, cells=cells).collect()
    for f in frames:
        name = f["p"].iloc[0]
        own = sorted((r for r in got if r.p == name), key=lambda r: r.x)
        g, fit, se, width = direct(f["x"].to_numpy(), f["y"].to_numpy(), 30, span)
        assert np.allclose([r.x for r in own], g) and np.allclose([r.bandwidth for r in own], width)
        assert np.allclose([r.estimate for r in own], fit, atol=1e-7) and np.allclose([r.se for r in own], se, rtol=1e-6)
        assert np.allclose([r.hi - r.lo for r in own], 2 * 1.96 * se) and {r.n for r in own} == {len(f)}


def test_parabola_is_reproduced(spark):
    x = np.linspace(-3, 9, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 - x + 0.5 * x * x}))
    for r in L.local_regression(df, "x", "y", cells=64).collect():
        assert r.estimate == pytest.approx(2 - r.x + 0.5 * r.x * r.x, abs=1e-8) and r.se < 1e-6


def test_small_groups(spark):
    rows = [("one", 2.0, 5.0), ("one", 2.0, 7.0), ("pair", 0.0, 1.0), ("pair", 1.0, 3.0), ("none", None, 1.0), ("none", 1.0, None)]
    got = L.local_regression(spark.createDataFrame(rows, "p string, x double, y double"), "x", "y", ["p"], grid=5).collect()
    one = [r for r in got if r.p == "one"]
    assert [(r.x, r.estimate, r.n) for r in one] == [(2.0, 6.0, 2)]
    assert {r.p for r in got} == {"one", "pair"} and len(got) == 6
    assert L.local_regression(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == []


def test_plan_has_no_product_of_rows_and_grid(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(300.0), "y": np.ones(300)}))
    seen = []
    points = L._points(df, "x", "y", [], 16)
    fits = L._grid_fits(points, L._cells(points), 80, 0.75)
    for d in (points, fits, L._variances(points, fits), L.local_regression(df, "x", "y")):
        seen.append(d._jdf.queryExecution().executedPlan().toString())
    assert not any(bad in plan for plan in seen for bad in ("NestedLoop", "CartesianProduct"))
