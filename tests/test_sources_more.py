"""Person tables that spare the shuffle, and counts taken in passing."""
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelflow.functions import columns as C
from panelflow.operators import aggregates as A
from panelflow.operators import filters as K
from panelflow.operators import timeseries as W
from panelflow.operators.observed import taken
from panelflow.plans import queries as Q
from panelflow.session import write_through
from panelflow.sources import tables as S
from tests.conftest import SF


def test_sessions_of_a_person_table_need_no_exchange(spark):
    name = f"pf_{uuid.uuid4().hex}"
    table = S.write_person_table(Q.dense(spark, SF), name, "ID", ["t", "seq"], buckets=4)
    try:
        d = W.sessionize(table, "ID", "t", "seq", 30.0, obs="obs")
        lagged = W.series_lags(d, "ID", "t", "seq", "session", {"Y1_lag": ("Y1", 1)})
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        for frame in (d, lagged, W.run_sizes(d, "ID", "t", "seq", "session"), A.count_by(table, ["ID"])):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for frame in (d, lagged):
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
        want = W.sessionize(Q.dense(spark, SF), "ID", "t", "seq", 30.0, obs="obs")
        assert d.exceptAll(want).isEmpty() and want.exceptAll(d).isEmpty()
    finally:
        S.drop_person_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_counts_are_taken_without_a_job_of_their_own(spark):
    rows = [(1, "3", None), (2, "x", "0"), (3, None, "1"), (4, "y", "2.5")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    bad, filled, dropped = Observation(), Observation(), Observation()
    d = C.to_numeric(df, ["a", "b"], counts=bad)
    d = C.binarize_columns(d, ["b"], counts=filled)
    d = K.complete_cases(d, ["a"], counts=dropped)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one action")
    assert sorted((r.id, r.a, r.b) for r in d.collect()) == [(1, 3.0, 0)]
    jobs = len(tracker.getJobIdsForGroup("counted"))
    assert taken(bad) == {"n_rows": 4, "bad_a": 2, "bad_b": 0}
    assert taken(filled) == {"n_rows": 4, "filled_b": 1}
    assert taken(dropped) == {"n_rows": 4, "n_dropped": 3, "missing_a": 3}
    assert len(tracker.getJobIdsForGroup("counted")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_repeats_are_counted(spark):
    rows = [(1, 0.0, 1, 5.0), (1, 0.0, 2, 5.0), (1, 0.0, 3, 5.0), (1, 9.0, 4, 5.0), (2, 0.0, 5, None), (2, 0.0, 6, None)]
    d = W.sessionize(spark.createDataFrame(rows, "ID long, t double, seq long, y double"), "ID", "t", "seq", 30.0)
    seen = Observation()
    out = write_through(W.drop_zero_dt_duplicates(d, "ID", "t", "seq", "session", ["y"], counts=seen))
    assert sorted(r.seq for r in out.collect()) == [1, 4, 5] and taken(seen) == {"n_rows": 6, "n_repeats": 3}


def test_partitioned_table_is_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.write_table(S.raw_responses(spark, SF), path, partition_by=["prompt_label"])
    one = spark.read.parquet(path).where(F.col("prompt_label") == "click_0")
    assert "PartitionFilters: [isnotnull(prompt_label" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == S.raw_responses(spark, SF).where("prompt_label = 'click_0'").count()


def test_entry_without_optional_packages():
    """Where a package that the optional operators import is missing, the core queries stay."""
    import subprocess
    import sys
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
            "assert 'w4_sessionize' in e.queries() and not any(k.startswith('op') for k in e.queries()); print('fine')")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).stdout.strip() == "fine"
