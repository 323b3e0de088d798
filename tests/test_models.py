"""Model steps: moments add up, pooled VAR recovers a simulated process,
variance components recover simulated components, logistic curve runs."""
import numpy as np
import pandas as pd

from panelflow.models import moments as M
from panelflow.models import varcomp as V
from panelflow.models.curves import fit_response_curve


def _sim_var(n_persons=200, n_obs=40, seed=42):
    rng = np.random.default_rng(seed)
    a = np.array([[0.4, 0.1], [-0.2, 0.3]])
    rows = []
    for p in range(n_persons):
        y = np.zeros(2)
        for t in range(n_obs):
            nxt = a @ y + rng.normal(0, 1, 2)
            rows.append((p, t, y[0], y[1], nxt[0], nxt[1]))
            y = nxt
    return pd.DataFrame(rows, columns=["ID", "t", "Y1_lag", "Y2_lag", "Y1", "Y2"]), a


def test_moments_of_halves_add_up(spark):
    pdf, _ = _sim_var(20, 10)
    df = spark.createDataFrame(pdf)
    whole = M.panel_moments(df, "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"]).orderBy("ID").toPandas()
    h1 = M.panel_moments(df.where("t < 5"), "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"]).orderBy("ID").toPandas()
    h2 = M.panel_moments(df.where("t >= 5"), "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"]).orderBy("ID").toPandas()
    cols = [c for c in whole.columns if c.startswith("s__") or c == "n"]
    assert np.allclose(whole[cols].to_numpy(), h1[cols].to_numpy() + h2[cols].to_numpy())


def test_pooled_var_recovers_coefficients(spark):
    pdf, a = _sim_var()
    mom = M.panel_moments(spark.createDataFrame(pdf), "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"])
    fit = M.pooled_ols(mom, ["Y1_lag", "Y2_lag"], ["Y1", "Y2"])
    b = fit["B"]          # rows: one, Y1_lag, Y2_lag; columns: Y1, Y2
    for qi in range(2):
        se = np.sqrt(np.diag(fit["cluster_cov"][qi]))
        assert np.all(np.abs(b[1:, qi] - a[qi, :]) < 4 * se[1:])
    per = M.fit_by_person(mom, "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"]).toPandas()
    assert len(per) == 200 and abs(per["b_Y1_Y1_lag"].mean() - 0.4) < 0.1


def test_variance_components_recovered(spark):
    rng = np.random.default_rng(42)
    ids, occ, items = 60, 30, 8
    u = rng.normal(0, 1.0, ids)
    v = rng.normal(0, 0.7, occ)
    w = rng.normal(0, 0.5, items)
    rows = [(i, o, k, 3 + u[i] + v[o] + w[k] + rng.normal(0, 1.2))
            for i in range(ids) for o in range(occ) for k in range(items) if rng.random() < 0.9]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ID", "occasion", "item", "value"]))
    vc = V.fit_variance_components(df, "value", ["ID", "occasion", "item"])
    assert abs(vc["residual"] - 1.44) < 0.15
    assert abs(vc["ID"] - np.var(u, ddof=1)) < 0.2
    rel = V.reliability(vc, "occasion", "item", 8)
    assert 0 < rel <= 1


def test_response_curve_runs(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 100, 2000)
    g = rng.integers(0, 2, 2000)
    p = 1 / (1 + np.exp(-(1 - 0.02 * x + 0.5 * g)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g, "y": (rng.random(2000) < p).astype(int)}))
    tab = fit_response_curve(df, "x", "y", "g").toPandas()
    est = tab.set_index("term")["estimate"]
    assert est["converged"] == 1 and tab["estimate"].notna().all()
    # the fitted curve is near the true one
    from panelflow.models.curves import exact_knots, spline_columns
    knots = exact_knots(df, "x", 3)
    lo, hi = x.min(), x.max()
    z = (np.array([20.0, 50.0, 80.0]) - lo) / (hi - lo)
    basis = {"s1": z, "s2": z ** 2, "s3": z ** 3, **{f"sk{i + 1}": np.maximum(z - (k - lo) / (hi - lo), 0) ** 3 for i, k in enumerate(knots)}}
    assert set(spline_columns("x", knots)) == set(basis)
    for grp in (0, 1):
        eta = est["(Intercept)"] + sum(est[b] * v for b, v in basis.items()) + grp * (
            est["g"] + sum(est[f"{b}_x_g"] * v for b, v in basis.items()))
        assert np.allclose(eta, 1 - 0.02 * np.array([20.0, 50.0, 80.0]) + 0.5 * grp, atol=0.5)


def test_mixed_var_em_recovers_simulation(spark):
    from panelflow.models.mixed import fit_mixed_var
    rng = np.random.default_rng(42)
    rows = []
    psi_sd = np.array([0.5, 0.2, 0.4, 0.2])      # random intercept/slope per outcome
    for p in range(150):
        u = rng.normal(0, psi_sd)
        y = np.zeros(2)
        for t in range(30):
            e = rng.multivariate_normal([0, 0], [[1.0, 0.3], [0.3, 1.0]])
            n1 = 0.2 + u[0] + (0.3 + u[1]) * y[0] + 0.1 * y[1] + e[0]
            n2 = -0.1 + u[2] + 0.05 * y[0] + (0.25 + u[3]) * y[1] + e[1]
            rows.append((p, y[0], y[1], n1, n2))
            y = np.array([n1, n2])
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ID", "Y1_lag", "Y2_lag", "Y1", "Y2"]))
    mom = M.panel_moments(df, "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"])
    fit = fit_mixed_var(mom, ["one", "Y1_lag", "Y2_lag"], ["Y1", "Y2"],
                        fixed={"Y1": ["one", "Y1_lag", "Y2_lag"], "Y2": ["one", "Y1_lag", "Y2_lag"]},
                        random={"Y1": ["one", "Y1_lag"], "Y2": ["one", "Y2_lag"]})
    path = fit["path"]
    assert fit["converged"] and path[-1] == fit["loglik"]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(path, path[1:]))
    se = dict(zip(["a1", "Y1_lag", "x", "a2", "y", "Y2_lag"], np.sqrt(np.diag(fit["cov"]))))
    assert abs(fit["beta"]["Y1"]["Y1_lag"] - 0.3) < 3 * se["Y1_lag"]
    assert abs(fit["beta"]["Y2"]["Y2_lag"] - 0.25) < 3 * se["Y2_lag"]
    assert abs(fit["sigma"][0, 1] - 0.3) < 0.08
    assert abs(fit["psi"][0, 0] - 0.25) < 0.1


def test_item_model_recovers_effects(spark):
    from panelflow.models import items as I
    rng = np.random.default_rng(3)
    levels = ["a", "b", "c"]
    rows = []
    for p in range(400):
        g, n, u = p % 2, float(rng.integers(10, 40)), rng.normal(0, 0.5)
        for i, v in enumerate(levels):
            rows.append((p, g, n, v, 1 + 0.5 * g + 0.02 * n + 0.3 * i + (0.8 if g and v == "c" else 0) + u + rng.normal(0, 0.4)))
    df = spark.createDataFrame(rows, "ID long, adhd int, n_obs double, item string, value double")
    d, terms = I.design(df, "adhd", "n_obs", "item", levels)
    assert {t: len(c) for t, c in terms.items()} == {"adhd": 1, "n_obs": 1, "item": 2, "adhd:n_obs": 1, "adhd:item": 2,
                                                     "n_obs:item": 2, "adhd:n_obs:item": 2}
    mom = M.panel_moments(d, "ID", [c for cols in terms.values() for c in cols], ["value"])
    fit = I.fit_items(mom, terms, "value")
    assert fit["converged"] and abs(fit["sigma"][0, 0] - 0.16) < 0.03 and abs(fit["psi"][0, 0] - 0.25) < 0.06
    grid = {(r.adhd, r.item): r for r in I.prediction_grid(spark, fit, terms, "value", "adhd", "n_obs", "item", levels, 25.0).collect()}
    for (g, v), r in grid.items():
        truth = 1 + 0.5 * g + 0.5 + 0.3 * levels.index(v) + (0.8 if g and v == "c" else 0)
        assert abs(r.estimate - truth) < 3.5 * r.se
    wald = {r.term: r for r in I.wald_terms(spark, fit, terms, "value").collect()}
    assert wald["adhd:n_obs:item"].chisq < 15 and wald["adhd:n_obs:item"].df == 2


def test_pooled_table_and_reliability(spark):
    pdf, _ = _sim_var(30, 12)
    mom = M.panel_moments(spark.createDataFrame(pdf), "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"])
    tab = {(r.outcome, r.term): r for r in M.pooled_ols_table(mom, ["Y1_lag", "Y2_lag"], ["Y1", "Y2"], with_se=True).collect()}
    x = np.column_stack([np.ones(len(pdf)), pdf["Y1_lag"], pdf["Y2_lag"]])
    y = pdf[["Y1", "Y2"]].to_numpy()
    b = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ b
    cov = e.T @ e / (len(pdf) - 3)
    inv = np.linalg.inv(x.T @ x)
    for j, out in enumerate(["Y1", "Y2"]):
        meat = sum(np.outer(s, s) for s in (x[pdf["ID"] == p].T @ e[pdf["ID"] == p, j] for p in range(30)))
        se = np.sqrt(np.diag(inv @ meat @ inv))
        for i, t in enumerate(["one", "Y1_lag", "Y2_lag"]):
            assert abs(tab[out, t].estimate - b[i, j]) < 1e-8 and abs(tab[out, t].se_cluster - se[i]) < 1e-8
    assert abs(tab["Y1", "cov:Y2"].estimate - cov[0, 1]) < 1e-8


def test_response_curve_clustered_errors(spark):
    """The sandwich over persons, computed from all rows at the fitted coefficients."""
    from panelflow.models.curves import exact_knots, spline_columns
    rng = np.random.default_rng(4)
    n, persons = 1500, 50
    who = rng.integers(0, persons, n)
    x = rng.uniform(0, 10, n)
    eta = 0.3 - 0.2 * x + rng.normal(0, 0.8, persons)[who]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": who, "x": x, "y": y}))
    tab = fit_response_curve(df, "x", "y", n_knots=2, cluster="p").toPandas().set_index("term")
    knots = exact_knots(df, "x", 2)
    z, k = (x - x.min()) / (x.max() - x.min()), [(v - x.min()) / (x.max() - x.min()) for v in knots]
    m = np.column_stack([np.ones(n), z, z ** 2, z ** 3, *[np.maximum(z - v, 0) ** 3 for v in k]])
    assert len(spline_columns("x", knots)) == m.shape[1] - 1
    beta = tab["estimate"].to_numpy()[:-1]
    p = 1 / (1 + np.exp(-m @ beta))
    assert np.abs(m.T @ (y - p)).max() < 1e-4           # at the maximum
    bread = np.linalg.pinv((m * (p * (1 - p))[:, None]).T @ m, rcond=1e-12)
    scores = np.array([m[who == i].T @ (y - p)[who == i] for i in range(persons)])
    se = np.sqrt(np.diag(bread @ scores.T @ scores @ bread))
    assert np.allclose(tab["std_error"].to_numpy()[:-1].astype(float), se, rtol=1e-4)
