"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is built and
executed fully with a ``noop`` write (no rows are collected), and timed
from DataFrame construction to the end of the write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelflow.plans.queries import QUERIES  # noqa: E402
from panelflow.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "w4_sessionize",        # gap sessions on the dense panel
    "a3_gap_summary",
    "r1_pivot_prompts",     # long -> wide pivot
    "d2_sessionize_panel",
    "d5_score_scales",      # variance filter + scores
    "d7_build_series",      # ids, series filter, duplicate removal
    "d8_var_design",        # centred VAR(1) design (flagship)
    "d9_var_design_ar2",
    "m2_var_pooled",        # moments + pooled VAR fit
    "d12_distribution_hist",
    "a7_item_variability",  # lineitem item statistics
    "a15_correlations",
    "m3_em_step",           # one EM pass with its moments
    "m5_response_mixed",    # a whole fit
    "m7_components",
    "m9_trajectory_smooth",  # local regression with band
    "m4_row_densities",     # each row against its person's others
    "a14_describe_persons",  # order statistics of few and of many values
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                          app="panelflow-bench")
    # warm-up: JVM class loading and the first parquet footer reads
    QUERIES["a3_gap_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
