"""The flow from raw responses to lagged designs, with split persons and without: the same rows."""
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from panelflow.operators import ordered as O
from panelflow.operators import timeseries as W
from panelflow.plans import compose as D

H = 3600.0
CFG = D.PanelConfig(scales={"anti": ["a", "b"], "pro": ["c", "d"]}, context_cols=["e"], min_obs=2)
LABELS = ["a", "b", "c", "d", "e"]


def responses():
    """A hot person, one without id, a bursty one, one with a single time, missing times, and ordinary ones."""
    rnd = random.Random(11)
    out, seq = [], 0
    for person, n, clock in [(1, 400, "even"), (None, 150, "even"), (2, 300, "burst"), (3, 120, "tied"),
                             (4, 130, "missing"), (5, 12, "even"), (6, 9, "burst"), (7, 3, "even")]:
        t = 0.0
        for i in range(n):
            if clock == "even":
                t += rnd.choice([1, 2, 5, 31]) * H
            elif clock == "burst" and i:
                t = 9_000_000.0 + i * H / 4
            time = None if clock == "missing" and rnd.random() < 0.7 else t
            for label in LABELS:
                seq += 1
                if rnd.random() < 0.8:
                    # a prompt is (person, time, no): rows without a time stay apart by their number
                    out.append((person, time, seq, "Y" if person in (1, 3) else "N", label, float(rnd.randint(0, 4)), i))
    return out


def flow(spark, rows_per_chunk):
    cfg = replace(CFG, rows_per_chunk=rows_per_chunk)
    raw = spark.createDataFrame(responses(), "ID long, t double, seq long, ADHD string, label string, value double, no int")
    wide = D.prepare_panel(raw, cfg, "label", "value", LABELS, on_duplicate="max", extra_keys=["no"])
    ema = D.sessionize_panel(wide, cfg)
    ema = D.score_scales(D.quality_filters(ema, cfg), cfg)
    series = D.build_series(D.context_features(ema, cfg), cfg)
    return {"wide": wide, "ema": ema, "series": series,
            "runs": W.run_sizes(ema, "ID", "t", "seq", "session", "n"),
            "var1": D.var_design(series, cfg, order=1, center=True),
            "var2": D.var_design(series, cfg, order=2, center=False)}


def plain(df):
    df = W.drop_helpers(df)
    return df.select(*[F.round(c, 7).alias(c) if t == "double" else c for c, t in sorted(df.dtypes)])


@pytest.fixture(scope="module")
def both(spark):
    return flow(spark, 1_000_000), flow(spark, 100)


@pytest.mark.parametrize("stage", ["wide", "ema", "series", "runs", "var1", "var2"])
def test_split_persons_change_nothing(both, stage):
    a, b = plain(both[0][stage]), plain(both[1][stage])
    assert a.columns == b.columns and a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not a.where("ID IS NULL").isEmpty()


def test_every_hot_record_is_split(both):
    wide = both[1]["wide"]
    assert not O.hot_free(wide) and O.hot_free(both[0]["wide"])
    sizes = wide.groupBy("ID", O.NCHUNKS, O.CHUNK).count().collect()
    assert {r.ID for r in sizes if r[O.NCHUNKS] > 0} == {1, None, 2, 3, 4}
    assert max(r["count"] for r in sizes) <= 200  # twice the target


def test_plan_grows_linearly(both):
    lines = {k: len(v._jdf.queryExecution().optimizedPlan().toString().splitlines()) for k, v in both[1].items()}
    assert max(lines.values()) < 60, lines
