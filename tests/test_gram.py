"""Sums of products in batches: against numpy for wide designs, many keys, nulls and hot keys."""
import numpy as np
import pandas as pd

from panelflow.models import moments as M
from panelflow.operators import aggregates as A
from panelflow.operators import gram as G


def frame(rng, n, p, keys):
    x = rng.normal(size=(n, p)) + 3
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(p)])
    return pdf.assign(ID=rng.choice(keys, n))


def test_two_hundred_columns(spark):
    rng = np.random.default_rng(0)
    pdf = frame(rng, 700, 200, [1, 2, 3, 4])
    pdf.loc[pdf.index % 2 == 0, "ID"] = 2        # a hot person
    cols = [f"x{i}" for i in range(199)]
    mom = M.gram_moments(spark.createDataFrame(pdf).repartition(6), "ID", cols, ["x199"])
    names = M.as_arrays(mom)[1]
    got = {r.ID: r for r in mom.collect()}
    assert len(names) == 201 * 202 // 2 and set(got) == {1, 2, 3, 4}
    for k, own in pdf.groupby("ID"):
        w = np.concatenate((np.ones((len(own), 1)), own[[*cols, "x199"]].to_numpy()), axis=1)
        assert got[k].n == len(own) and np.allclose(got[k].g, (w.T @ w)[np.triu_indices(201)])
    fit = M.pooled_ols(mom, cols[:20], ["x199"], with_se=False)
    design = np.concatenate((np.ones((700, 1)), pdf[cols[:20]].to_numpy()), axis=1)
    assert np.allclose(fit["B"][:, 0], np.linalg.lstsq(design, pdf["x199"].to_numpy(), rcond=None)[0])


def test_keys_of_all_kinds_and_full_tables(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(G, "HELD", 30)
    for kind, keys in (("string", ["a", "b", None, ""]), ("long", [1, None, 7]), ("double", [0.5, 2.0])):
        rows = [(keys[rng.integers(len(keys))], float(rng.normal()), float(rng.normal())) for _ in range(300)]
        df = spark.createDataFrame(rows, f"ID {kind}, u double, v double").repartition(4)
        got = {r.ID: (r.n, r.g) for r in G.gram_by_key(df, "ID", ["u", "v"]).collect()}
        assert set(got) == set(keys)
        for k in keys:
            w = np.array([r[1:] for r in rows if r[0] == k])
            assert got[k][0] == len(w) and np.allclose(got[k][1], (w.T @ w)[np.triu_indices(2)])
    empty = spark.createDataFrame([], "ID long, u double")
    assert G.gram_by_key(empty, "ID", ["u"]).collect() == []


def test_wide_and_narrow_moments_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(frame(rng, 200, 5, [1, 2, 3]))
    narrow = M.panel_moments(df, "ID", ["x0", "x1", "x2"], ["x3", "x4"]).orderBy("ID").toPandas()
    monkeypatch.setattr(M, "SQL_SUMS", 1)
    wide = M.panel_moments(df, "ID", ["x0", "x1", "x2"], ["x3", "x4"]).orderBy("ID").toPandas()
    assert list(wide.columns) == list(narrow.columns) and np.allclose(wide, narrow)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 200)) + 1e6           # a large mean loses nothing
    x[:, 5] = x[:, 4] * 2
    x[:, 6] = 1.0
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(200)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(5)
    got = A.correlation_matrix(df, list(pdf)).collect()
    assert len(got) == 200 * 199 // 2
    want, present = pdf.corr().to_numpy(), pdf.notna().to_numpy().astype(int)
    both = present.T @ present
    for r in got:
        i, j = int(r.var1[1:]), int(r.var2[1:])
        assert r.n == both[i, j]
        assert (r.r is None) if 6 in (i, j) else abs(r.r - want[i, j]) < 1e-6
