"""Ranks over value counts: against pandas, with hot values, null groups and few values."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.operators import aggregates as A
from panelflow.operators import ranks as R


def test_ranked_against_sorting(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, 0.0, 0.0, 1.0, 2.5, None, rnd.random()])) for _ in range(500)]
    got = R.ranked(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()
    for g in ("a", "b", None):
        xs = sorted(v for k, v in rows if k == g and v is not None)
        own = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [(r.x, r["count"], r.before, r.n) for r in own] == [
            (x, xs.count(x), sum(v < x for v in xs), len(xs)) for x in sorted(set(xs))]


def test_two_values_leave_every_task_with_little(spark):
    """200,000 rows of 0 and 1: two rows are sorted, not two tasks of 100,000."""
    df = spark.range(200_000).select((F.col("id") % 2).cast("double").alias("v"))
    assert R.value_counts(df, "v").count() == 2
    r = A.gap_summary(df, "v", 0.5).first()
    assert (r.mean_gap, r.median_gap, r.max_gap, r.n_large) == (0.5, 0.5, 1.0, 100_000)


@pytest.mark.parametrize("n", [1, 2, 3, 11, 200])
def test_describe_numeric_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    data = {"u": rng.normal(size=n), "v": rng.integers(0, 2, n).astype(float)}
    got = {r.vars: r for r in A.describe_numeric(spark.createDataFrame(pd.DataFrame(data)).repartition(3), ["u", "v"]).collect()}
    for c, x in data.items():
        r, k = got[c], int(n * A.TRIM)
        assert r.n == n and r["mean"] == pytest.approx(x.mean()) and r.median == pytest.approx(np.median(x))
        assert r.trimmed == pytest.approx(np.sort(x)[k:n - k].mean())
        assert r.mad == pytest.approx(A.MAD_CONSTANT * np.median(np.abs(x - np.median(x))))
        assert (r.min, r.max) == (x.min(), x.max())
        if n > 1:
            assert r.sd == pytest.approx(x.std(ddof=1))
        else:
            assert r.sd is None


def test_empty_columns(spark):
    df = spark.createDataFrame([(None,)], "v double")
    r = A.gap_summary(df, "v").first()
    assert (r.mean_gap, r.median_gap, r.n_large) == (None, None, 0)
    assert A.describe_numeric(df, ["v"]).collect() == []


def test_numbered(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(1000),) for _ in range(300)]
    got = R.numbered(spark.createDataFrame(rows, "v int").repartition(4), [F.desc("v")], "place").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == sorted((v for v, in rows), reverse=True)
    assert sorted(r.place for r in got) == list(range(1, 301))


def test_histogram_keeps_a_null_panel(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 1.0), (None, 2.0), (None, 3.0), ("b", None)]
    got = A.histogram(spark.createDataFrame(rows, "p string, v double"), "v", 3, ["p"]).collect()
    assert sorted(((r.p or "", r.bin, r["count"]) for r in got)) == [
        ("", 1, 1), ("", 2, 1), ("", 3, 1), ("a", 1, 1), ("a", 2, 0), ("a", 3, 1)]
