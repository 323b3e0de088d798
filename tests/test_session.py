"""Intermediate tables and their end."""
import os

from panelflow.operators import aggregates as A
from panelflow.plans import queries as Q
from panelflow.session import discard, ensure_checkpoint_dir, scratch, write_through
from tests.conftest import SF


def tables(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("table-")}


def test_scratch_leaves_nothing(spark):
    kept = write_through(spark.range(3))
    before = tables(spark)
    with scratch(spark):
        rows = Q.q_d7_build_series(spark, SF).collect()
        assert tables(spark) > before
    assert rows and tables(spark) == before and kept.count() == 3


def test_discard_deletes_only_written_tables(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    t = write_through(events.limit(5))
    before = tables(spark)
    discard(t, events)
    assert len(before - tables(spark)) == 1 and events.count() > 5
    with scratch(spark):
        discard(write_through(spark.range(1)))      # already gone at the end
    assert A.count_by(events, ["user_id"]).count() > 0
