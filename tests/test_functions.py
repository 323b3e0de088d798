"""Planted cases for scalar functions, reshape, filters and aggregates."""
import pytest
from pyspark.sql import functions as F

from panelflow.functions import columns as C
from panelflow.operators import aggregates as A
from panelflow.operators import filters as K
from panelflow.operators import ordered as O
from panelflow.operators import reshape as R
from panelflow.plans import compose as D
from panelflow.sources import tables as S


def test_sentinel_and_numbers(spark):
    df = spark.createDataFrame([("#skipped#",), ("3",), ("abc",), (None,)], "r string")
    out = df.select(C.to_number(C.null_if("r")).alias("x"), C.cast_failed(C.null_if("r")).alias("bad"))
    assert [tuple(r) for r in out.collect()] == [(None, 0), (3.0, 0), (None, 1), (None, 0)]


def test_parse_time_weekend_null_safe(spark):
    df = spark.createDataFrame([("2024-01-06 10:00:00",), ("2024/01/08 10:00:00",), ("nonsense",)], "s string")
    out = df.select(C.epoch_seconds_text("s").alias("t")).select(
        "t", C.weekend_flag_epoch("t").alias("we"), C.weekday_label_epoch("t").alias("d"))
    got = [tuple(r) for r in out.collect()]
    assert got[0][1:] == (1, "Sat") and got[1][1:] == (0, "Mon") and got[2] == (None, 0, None)


def test_row_mean_all_null_is_null(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(C.row_mean(["a", "b"])).collect()] == [None, 1.0, 2.5]


def test_group_flag_and_binarize(spark):
    df = spark.createDataFrame([(None, None), ("Y", 0.0), ("N", 2.0)], "g string, c double")
    out = df.select(C.group_flag("g").alias("f"), C.binarize("c").alias("b")).collect()
    assert [tuple(r) for r in out] == [(0, 0), (1, 0), (0, 1)]


def test_half_even_percent(spark):
    df = spark.createDataFrame([(12.25,), (0.35,)], "x double")
    assert df.select(C.round_half_even("x", 1)).first()[0] == 12.2


def test_series_key_collision(spark):
    df = spark.createDataFrame([(1, 999), (1, 1000)], "p long, s int")
    out = df.select(C.series_key("p", "s").alias("k"), C.series_key_collides("s").alias("c")).collect()
    assert [tuple(r) for r in out] == [(1999, False), (2000, True)]


def test_make_names():
    assert S.make_name("adhdig_ema_9_I am alone") == "adhdig_ema_9_I.am.alone"
    assert S.make_name("9lives") == "X9lives"
    assert S.make_name("In-person") == "In.person"


def test_pivot_duplicates_and_absent_label(spark):
    long = spark.createDataFrame([(1, 0.0, 1, "a", 1.0), (1, 0.0, 2, "a", 5.0), (1, 0.0, 3, "b", 2.0)],
                                 "ID long, t double, seq long, label string, value double")
    with pytest.raises(R.DuplicateCellError):
        R.pivot_prompts(long, ["ID", "t"], "label", "value", ["a", "b", "c"])
    out = R.pivot_prompts(long, ["ID", "t"], "label", "value", ["a", "b", "c"], on_duplicate="max").first()
    assert (out["a"], out["b"], out["c"], out["seq"]) == (5.0, 2.0, None, 1)
    first = R.pivot_prompts(long, ["ID", "t"], "label", "value", ["a"], on_duplicate="first").first()
    assert first["a"] == 1.0


def test_variance_filter_drops_single_value_person(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 5.0), (2, 1.0, None), (2, None, 4.0)],
                               "ID long, a double, b double")
    d = O.single_chunk(df)
    kept = K.variance_filter(d, "ID", {"s1": ["a"], "s2": ["b"]})
    assert sorted({r["ID"] for r in kept.collect()}) == [1]


def test_constant_score_zscore_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "m double")
    out = D.standardize(df, {"m": "z"})
    assert [r["z"] for r in out.collect()] == [None, None]


def test_freq_table_and_describe(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (1,)] * 2 + [(1,)], "c int")
    ft = {r["c"]: (r["n"], r["pct"]) for r in A.freq_table(df, ["c"]).collect()}
    assert ft == {0: (4, 44.4), 1: (5, 55.6)}
    desc = A.describe_numeric(spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double"), ["x"]).first()
    assert desc["n"] == 10 and desc["median"] == 5.5 and desc["trimmed"] == 5.5
    assert abs(desc["mad"] - 1.4826 * 2.5) < 1e-9 and abs(desc["skew"]) < 1e-12


def test_histogram_empty_bins_and_centres(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (4.0,)], "v double")
    h = A.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 2, 0, 0, 1]
    assert [r["x"] for r in h] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_mean_ci_counts_all_rows(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", None)], "k string, v double")
    r = A.mean_ci(df, ["k"], "v").first()
    assert r["mean_val"] == 2.0 and abs(r["se_val"] - (2 ** 0.5) / (3 ** 0.5)) < 1e-12
