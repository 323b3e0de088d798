"""Priors, and leaving out rows and persons: against refits and marginal likelihoods."""
import numpy as np
import pandas as pd
import pytest

from panelflow.models import mixed as X
from panelflow.models import moments as M
from panelflow.session import write_through


def simulated(seed, persons=40, rows=12):
    rng = np.random.default_rng(seed)
    out = []
    for p in range(persons):
        u = rng.normal(0, [0.5, 0.2, 0.4])
        for t in range(rows + p % 5):
            x, z = rng.normal(size=2)
            e = rng.multivariate_normal([0, 0], [[1.0, 0.4], [0.4, 0.8]])
            out.append((p if p else None, t + 1000 * p, x, z, 0.3 + u[0] + (0.5 + u[1]) * x + 0.2 * z + e[0], -0.2 + u[2] + 0.1 * x + e[1]))
    return pd.DataFrame(out, columns=["ID", "seq", "x", "z", "Y1", "Y2"]).astype({"ID": "Int64"})


@pytest.fixture(scope="module")
def data(spark):
    pdf = simulated(1)
    rows = [(None if r[0] is pd.NA else int(r[0]), int(r[1]), *map(float, r[2:])) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "ID long, seq long, x double, z double, Y1 double, Y2 double")
    s = X.shape(["one", "x", "z"], ["Y1", "Y2"], {"Y1": ["one", "x", "z"], "Y2": ["one", "x"]}, {"Y1": ["one", "x"], "Y2": ["one"]})
    return pdf, df, s, write_through(M.gram_moments(df, "ID", ["x", "z"], ["Y1", "Y2"]).coalesce(1))


def loglik(s, pdf, params):
    """Marginal log-likelihood of one person's rows."""
    w = np.stack([np.ones(len(pdf)), pdf["x"], pdf["z"]], 1)
    y = pdf[["Y1", "Y2"]].to_numpy(float)
    return X.e_step(s, (w.T @ w)[None], (w.T @ y)[None], (y.T @ y)[None], np.array([float(len(pdf))]), *params)[0, -3]


def test_row_densities_are_what_a_row_adds(data):
    """log p(row | others) = log p(all rows) - log p(all but the row), for every row of some persons."""
    pdf, df, s, mom = data
    params = (np.array([0.2, 0.4, 0.1, -0.1, 0.2]), np.array([[1.1, 0.3], [0.3, 0.9]]),
              np.array([[0.3, 0.05, 0.1], [0.05, 0.1, 0.0], [0.1, 0.0, 0.2]]))
    got = {r.seq: r.m for r in X.leave_row_out(df, mom, "ID", "seq", {"m": {"shape": s, "params": params}}).collect()}
    assert len(got) == len(pdf)
    for p in (pd.NA, 1, 7):
        own = pdf[pdf["ID"].isna()] if p is pd.NA else pdf[pdf["ID"] == p]
        whole = loglik(s, own, params)
        for i in range(len(own)):
            assert got[own["seq"].iloc[i]] == pytest.approx(whole - loglik(s, own.drop(own.index[i]), params), abs=1e-8)


def test_compare_rows(spark, data):
    pdf, df, s, mom = data
    small = X.shape(["one", "x", "z"], ["Y1", "Y2"], {"Y1": ["one", "z"], "Y2": ["one"]}, {"Y1": ["one"], "Y2": ["one"]})
    got = {r.model: r for r in X.compare_rows(df, mom, "ID", "seq", {"full": s, "small": small}, tol=1e-4).collect()}
    assert list(got) == ["full", "small"] and got["full"].converged and got["small"].converged
    fits = {m: X.fit_many(mom, sh, tol=1e-4)[0] for m, sh in (("full", s), ("small", small))}
    ll = X.leave_row_out(df, mom, "ID", "seq", fits).toPandas()
    d = ll["small"] - ll["full"]
    assert got["full"].elpd == pytest.approx(ll["full"].sum()) and got["small"].elpd_diff == pytest.approx(d.sum()) and d.sum() < 0
    assert got["small"].se_diff == pytest.approx(d.std(ddof=1) * np.sqrt(len(d))) and got["full"].se_diff == 0 and got["full"].rows == len(pdf)


def test_compare_models_against_refits(spark, data):
    """Each left-out person's log-likelihood comes from a fit that really lacks the persons of its fold."""
    from pyspark.sql import functions as F
    pdf, df, s, mom = data
    got = X.compare_models(mom, "ID", {"m": s}, folds=2, tol=1e-5).first()
    fold = {r.ID: r.f for r in df.select("ID", F.pmod(F.xxhash64("ID"), F.lit(2)).cast("int").alias("f")).distinct().collect()}
    total = 0.0
    for j in range(2):
        inside = [i for i, f in fold.items() if f == j]
        keep = F.col("ID").isNull() if inside == [None] else (F.col("ID").isin([i for i in inside if i is not None])
                                                              | (F.col("ID").isNull() if None in inside else F.lit(False)))
        fit = X.fit_many(mom.where(~F.coalesce(keep, F.lit(False))), s, tol=1e-5)[0]
        for i in inside:
            own = pdf[pdf["ID"].isna()] if i is None else pdf[pdf["ID"] == i]
            total += loglik(s, own, fit["params"])
    assert got.converged and got.elpd == pytest.approx(total, abs=0.2) and got.persons == 40


def test_pieces_of_one_fold(spark, data):
    """A piece all of whose persons a fit leaves out adds nothing to that fit's sums; the others' sums stay."""
    from pyspark.sql import functions as F
    _, _, s, mom = data
    params = (np.array([0.2, 0.4, 0.1, -0.1, 0.2]), np.array([[1.1, 0.3], [0.3, 0.9]]), np.eye(3) * 0.2)
    folded = mom.withColumn("_fold", F.pmod(F.xxhash64("ID"), F.lit(2)).cast("int"))
    want = X.person_sums(s, folded, [params] * 2, "_fold")
    apart = folded.repartitionByRange(2, "_fold")         # each task has one fold
    for got, w in zip(X.person_sums(s, apart, [params] * 2, "_fold"), want, strict=True):
        assert np.allclose(got, w)
    for got, w, left in zip(X.person_sums(s, apart, [params] * 2, "_fold", inside=True), want, want[::-1], strict=True):
        assert np.allclose(got, left) and not np.allclose(got, w)


def test_prior_climbs_the_posterior(data):
    _, _, s, mom = data
    known = X.prior(s, slope_sd=0.05, psi_sd=0.2, df=30, mean={"x": 0.0})
    fit = X.fit_mixed_var(mom, s.terms, s.ys, s.fixed, s.random, prior=known, tol=1e-7)
    flat = X.fit_mixed_var(mom, s.terms, s.ys, s.fixed, s.random, tol=1e-4)
    assert fit["converged"] and all(b >= a - 1e-9 * abs(a) for a, b in zip(fit["path"], fit["path"][1:]))
    assert fit["path"][-1] == fit["logpost"] == pytest.approx(fit["loglik"] + known.log(fit["params"][0], fit["psi"]))
    assert abs(fit["beta"]["Y1"]["x"]) < abs(flat["beta"]["Y1"]["x"]) and fit["loglik"] < flat["loglik"]
    assert np.sqrt(fit["cov"][1, 1]) < np.sqrt(flat["cov"][1, 1])

    def posterior(params):
        total = X.person_sums(s, mom, [params])[0]
        return s.split(total)[4][0] + known.log(params[0], params[2])
    top = posterior(fit["params"])
    for i in range(s.p):            # no neighbour is higher
        for step in (-0.01, 0.01):
            moved = fit["params"][0].copy()
            moved[i] += step
            assert posterior((moved, *fit["params"][1:])) < top
    for scale in (0.9, 1.1):
        assert posterior((*fit["params"][:2], fit["psi"] * scale)) < top


def test_flat_prior_changes_little(data):
    _, _, s, mom = data
    weak = X.Prior(np.zeros(s.p), np.zeros(s.p), -s.q - 1.0, np.zeros((s.q, s.q)))
    a = X.fit_many(mom, s, tol=1e-5, prior=weak)[0]
    b = X.fit_many(mom, s, tol=1e-5)[0]
    assert np.allclose(a["params"][0], b["params"][0], atol=1e-5) and a["logpost"] == pytest.approx(b["loglik"])


@pytest.mark.parametrize("batches", [1, 3])
def test_passes_hold_few_persons_at_a_time(spark, monkeypatch, batches):
    """Sums in pieces are those of whole batches, and no stacked matrix outgrows the bound."""
    s = X.shape(["one", "x", "z"], ["Y1", "Y2"], {y: ["one", "x", "z"] for y in ("Y1", "Y2")}, {y: ["one", "x"] for y in ("Y1", "Y2")})
    names = M.moment_names(s.terms, s.ys)
    rng = np.random.default_rng(3)
    w = rng.normal(size=(90, 7, 5))
    g = (np.swapaxes(w, 1, 2) @ w)[:, *np.triu_indices(5)]
    frames = [pd.DataFrame({"n": 7, "g": list(part)}) for part in np.split(g, batches)]
    seen = []
    monkeypatch.setattr(X, "e_step", lambda *a, real=X.e_step: seen.append(a[1].size) or real(*a))
    params = (np.full(s.p, 0.1), np.eye(2), np.eye(s.q))

    class Table:
        columns, schema = ["n", "g"], {"g": type("Field", (), {"metadata": {M.MOMENTS: names}})}

        def mapInPandas(self, run, schema):
            self.rows = list(run(iter(frames)))
            return spark.createDataFrame(pd.concat(self.rows), schema)

    whole, pieces = Table(), Table()
    want = X.person_sums(s, whole, [params])[0]
    monkeypatch.setattr(M, "HELD", 10 * s.held)
    seen.clear()
    got = X.person_sums(s, pieces, [params])[0]
    assert len(seen) == 9 and max(seen) <= M.HELD
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9) and len(pieces.rows) == 1
    assert list(M.pieces(iter([frames[0].iloc[:0]]), 5)) == [] and list(M.task_sums(iter([]))) == []


def test_neighbouring_sums_in_pieces(spark, monkeypatch):
    """Rows of a key are added up across pieces."""
    import pyarrow as pa

    from panelflow.operators import gram as G
    kind = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("g", pa.list_(pa.float64()))])
    keys = [None, 1, 1, 1, 1, 2, 3, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([1] * 8), pa.array([[float(i), 1.0] for i in range(8)])], schema=kind)
    monkeypatch.setattr(G, "PIECE", 4)
    assert max(b.num_rows for b in G._pieces(iter([batch]))) == 2
    got = [r for b in G._runs(iter([batch]), kind) for r in b.to_pylist()]
    assert got == [{"k": None, "n": 1, "g": [0.0, 1.0]}, {"k": 1, "n": 4, "g": [10.0, 4.0]}, {"k": 2, "n": 1, "g": [5.0, 1.0]},
                   {"k": 3, "n": 2, "g": [13.0, 2.0]}]
