"""Planted cases for sessions, lags, duplicates and the hot-person chunking."""
from pyspark.sql import functions as F

from panelflow.operators import ordered as O
from panelflow.operators import timeseries as W
from panelflow.sources.tables import events_long

H = 3600.0


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("seq").collect()]


def test_gap_exactly_limit_stays(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 30 * H, 2), (1, 60 * H + 1, 3)], "ID long, t double, seq long")
    out = W.sessionize(O.single_chunk(df), "ID", "t", "seq", 30.0)
    assert rows(out, "session") == [(1,), (1,), (2,)]


def test_null_times_last_each_own_session(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5.0, 2), (1, None, 3), (1, 10.0, 4)],
                               "ID long, t double, seq long")
    out = W.sessionize(O.single_chunk(df), "ID", "t", "seq", 30.0, obs="obs")
    got = {r["seq"]: (r["obs"], r["session"]) for r in out.collect()}
    assert got[2] == (1, 1) and got[4] == (2, 1)
    assert got[1] == (3, 2) and got[3] == (4, 3)


def test_tied_times_ordered_by_seq(spark):
    df = spark.createDataFrame([(1, 5.0, 9), (1, 5.0, 3), (1, 1.0, 7)], "ID long, t double, seq long")
    out = W.obs_counter(O.single_chunk(df), "ID", "t", "seq")
    assert {r["seq"]: r["obs"] for r in out.collect()} == {7: 1, 3: 2, 9: 3}


def test_zero_dt_duplicates(spark):
    data = [(1, 0.0, 1, 1.0, 2.0), (1, 0.0, 2, 1.0, 2.0), (1, 0.0, 3, 1.0, 2.0),  # A,A,A
            (1, 5.0, 4, 1.0, 2.0), (1, 5.0, 5, 3.0, 2.0),                          # A,B
            (1, 9.0, 6, None, None), (1, 9.0, 7, None, None)]                      # null,null
    df = spark.createDataFrame(data, "ID long, t double, seq long, Y1 double, Y2 double")
    d = W.sessionize(O.single_chunk(df), "ID", "t", "seq", 30.0)
    out = W.drop_zero_dt_duplicates(d, "ID", "t", "seq", "session", ["Y1", "Y2"])
    assert sorted(r["seq"] for r in out.collect()) == [1, 4, 5, 6]


def test_series_lags_do_not_cross_sessions(spark):
    df = spark.createDataFrame([(1, 0.0, 1, 1.0), (1, H, 2, 2.0), (1, 100 * H, 3, 3.0), (1, 101 * H, 4, 4.0)],
                               "ID long, t double, seq long, y double")
    d = W.sessionize(O.single_chunk(df), "ID", "t", "seq", 30.0)
    out = W.series_lags(d, "ID", "t", "seq", "session", {"y_lag": ("y", 1), "y_lag2": ("y", 2)})
    assert rows(out, "y_lag", "y_lag2") == [(None, None), (1.0, None), (None, None), (3.0, None)]


def test_run_sizes_and_min_run(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, H, 2), (1, 100 * H, 3), (1, 101 * H, 4), (1, 102 * H, 5)],
                               "ID long, t double, seq long")
    d = W.sessionize(O.single_chunk(df), "ID", "t", "seq", 30.0)
    kept = W.min_run_size(d, "ID", "t", "seq", "session", 3)
    assert sorted(r["seq"] for r in kept.collect()) == [3, 4, 5]


def _dense_forced(spark):
    ev = events_long(spark, "/root/testdata/sf0.001").select("ID", "t", "seq", "Y1", "Y2")
    forced = O.assign_chunks(ev, "ID", "t", "seq", rows_per_chunk=4)
    return ev, forced


def test_chunked_scans_equal_plain_windows(spark):
    ev, forced = _dense_forced(spark)
    assert not O.hot_free(forced)
    assert forced.agg(F.max(O.CHUNK)).first()[0] > 1

    def chain(d):
        d = W.sessionize(d, "ID", "t", "seq", 30.0, obs="obs")
        d = W.series_lags(d, "ID", "t", "seq", "session", {"l1": ("Y1", 1), "l2": ("Y2", 2)})
        d = W.run_sizes(d, "ID", "t", "seq", "session", "sn")
        d = W.center_within(d, "ID", ["Y1"])
        cols = ["seq", "obs", "session", "gap_hours", "RawHours", "TimeHours", "time_interval",
                "l1", "l2", "sn", "Y1_pm"]
        return d.select(*[F.round(c, 9).alias(c) if c not in ("seq", "obs", "session", "sn") else c
                          for c in cols])

    a = chain(O.single_chunk(ev))
    b = chain(forced)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sequential_id_dense(spark):
    df = spark.createDataFrame([(k,) for k in [50, 7, 7, 1000, 3, 50]], "ID long")
    out = W.sequential_id(df, "ID")
    assert {r["ID"]: r["person_id"] for r in out.collect()} == {3: 1, 7: 2, 50: 3, 1000: 4}
