"""Planted cases of the raw response flow, and set-up helpers."""
import pytest
from pyspark.sql import functions as F

from panelflow.functions import columns as C
from panelflow.operators import filters as K
from panelflow.operators import reshape as R
from panelflow.plans import compose as D
from panelflow.sources import tables as S

CFG = D.PanelConfig(scales={"anti": ["i1", "i2"], "pro": ["i3", "i4"]}, context_cols=["Alone"])
LABELS = ["i1", "i2", "i3", "i4", "Alone"]


def raw(spark, rows):
    return spark.createDataFrame(rows, S.RESPONSE_SCHEMA)


@pytest.fixture(scope="module")
def planted(spark):
    t = "2024-05-0{} 10:00:00"
    rows = [
        (1, t.format(1), 1, "Y", "i1", "3", 1), (1, t.format(1), 1, "Y", "i2", "#skipped#", 2), (1, t.format(1), 1, "Y", "i3", "often", 3),
        (1, t.format(2), 1, "Y", "i1", "#skipped#", 4), (1, t.format(2), 1, "Y", "i2", "#skipped#", 5),
        (1, "no time", 1, "Y", "i1", "2", 6), (1, "late", 1, "Y", "i1", "4", 7), (1, t.format(3), None, "Y", "i1", "1", 8),
        (2, t.format(1), 1, None, "i4", "10", 9), (2, t.format(4), 1, None, "i4", "9", 10), (3, t.format(1), 1, "N", "other", "1", 11)]
    return raw(spark, rows)


def test_raw_flow(spark, planted):
    report = D.parse_report(D.read_raw(planted, CFG)).first().asDict()
    assert report == {"n_rows": 11, "n_skipped": 3, "n_bad_time": 2, "n_bad_value": 1, "n_no_session": 1}
    wide = {r.seq: r for r in D.prepare_raw_panel(planted, CFG, LABELS).collect()}
    assert set(wide) == {1, 4, 6, 7, 9, 10, 11}   # 8 has no session number
    assert (wide[1].i1, wide[1].i2, wide[1].i3, wide[1].Alone) == ("3", None, "often", None)
    assert wide[6].t is None and wide[6].weekend == 0 and [wide[s].obs for s in (1, 4, 6, 7)] == [1, 2, 3, 4]
    shown = D.response_pattern(D.prepare_raw_panel(planted, CFG, LABELS), CFG, CFG.items, pattern=r"i(\d+)_present")
    got = {(r.seq, r.item): r.responded for r in shown.collect()}
    assert got[1, 1.0] == 1 and got[1, 2.0] == 0 and got[1, 3.0] == 1
    assert not any(s in (4, 11) for s, _ in got)   # nothing answered there
    ema = {r.seq: r for r in D.sessionize_panel(D.prepare_raw_panel(planted, CFG, LABELS), CFG).collect()}
    assert ema[1].i3 is None and ema[10].i4 == 9.0
    assert ema[6].session != ema[7].session   # unparsable times: each its own session


def test_no_session_numbers_at_all(spark):
    rows = [(1, "2024-01-01 00:00:00", None, "Y", "i1", "3", 1)]
    assert D.prepare_raw_panel(raw(spark, rows), CFG, LABELS).count() == 0


def test_greatest_text_is_refused(spark):
    df = spark.createDataFrame([(1, "a", "9", 1), (1, "a", "10", 2)], "ID long, label string, value string, seq long")
    with pytest.raises(ValueError, match="numeric"):
        R.pivot_prompts(df, ["ID"], "label", "value", ["a"], on_duplicate="max")
    assert R.pivot_prompts(df, ["ID"], "label", "value", ["a"], on_duplicate="last").first().a == "10"


def test_positive_person_without_covariates_stays(spark):
    p = spark.createDataFrame([(1, "Y", 1), (2, "N", 0)], "ID long, ADHD string, ADHD_numeric int")
    cov = spark.createDataFrame([(2, 40.0)], "ID long, Age double")
    got = {r.ID: (r.ADHD_numeric, r.Age) for r in D.with_covariates(p, cov, "ID").collect()}
    assert got == {1: (1, None), 2: (0, 40.0)}


def test_rules_and_exclusions(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 9)], "ID long, x int")
    assert [r.f for r in df.select(C.flag_rules({"f": F.col("x") > 6})["f"].alias("f")).collect()] == [False, False, True]
    assert {r.ID for r in K.exclude_ids(df, "ID", [1, *range(100, 2000)]).collect()} == {2, None}


def test_read_and_write_round_trip(spark, tmp_path, planted):
    for fmt in ("csv", "parquet"):
        path = f"{tmp_path}/{fmt}"
        if fmt == "csv":
            planted.write.option("header", "true").csv(path)
        else:
            S.write_table(planted, path, fmt, partition_by=["adhd"])
        back = S.read_responses(spark, path, fmt)
        assert back.select(planted.columns).exceptAll(planted).isEmpty() and back.count() == planted.count()
