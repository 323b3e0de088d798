"""Time-series window operators over a person's record.

All of them are built on :mod:`panelflow.operators.ordered`, so every
window of a split person is keyed on ``(_k, _m, _c)``.
``time`` is an epoch-second double column, ``seq`` a unique row number
used as the last sort key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelflow.functions.columns import SECONDS_PER_HOUR
from panelflow.operators.observed import observed
from panelflow.session import write_through
from panelflow.operators.ordered import (CHUNK, NCHUNKS, PERSON, add_key_totals, add_lags, add_running,
                                         ensure_chunks, hot_free, part_keys, single_chunk)


def obs_counter(df: DataFrame, key: str, time: str, seq: str, out: str = "obs") -> DataFrame:
    """1-based position of the row in the person's record."""
    return add_lags(df, key, time, seq, {}, row_number=out)


def elapsed_and_step(df: DataFrame, key: str, time: str, seq: str, *,
                     elapsed: str = "TimeHours", step: str = "time_interval",
                     step_default: float | None = 0.0) -> DataFrame:
    """Hours since the person's first row (W2) and the step to the previous
    row of that clock (W3); the first row's step uses ``step_default``
    (``None`` -> NULL).  The first row by order defines the origin: when its
    time is missing, all elapsed values are NULL.
    """
    d = add_lags(df, key, time, seq, {"_tp": (time, 1)}, row_number="_rn")
    d = add_running(d, key, time, seq, lasts={"_t0": F.when(F.col("_rn") == 1, F.col(time))})
    el = (F.col(time) - F.col("_t0")) / F.lit(SECONDS_PER_HOUR)
    prev = (F.col("_tp") - F.col("_t0")) / F.lit(SECONDS_PER_HOUR)
    first = F.col("_rn") == 1
    st = F.when(first, el - F.lit(step_default)) if step_default is not None else F.when(first, F.lit(None))
    st = st.otherwise(el - prev)
    return d.withColumns({elapsed: el, step: st.cast("double")}).drop("_tp", "_t0", "_rn")


def sessionize(df: DataFrame, key: str, time: str, seq: str, gap_hours: float = 30.0, *,
               session: str = "session", gap: str = "gap_hours",
               new_session: str = "new_session", elapsed: str = "RawHours",
               within: str = "TimeHours", step: str = "time_interval",
               obs: str | None = None, carry_first: Sequence[str] = ()) -> DataFrame:
    """Gap sessionisation (W4) with the clocks used downstream.

    A row opens a new session when it is the person's first row, has no
    time, or follows the previous row by *more than* ``gap_hours``
    (a gap of exactly ``gap_hours`` stays in the session).  Adds:

    * ``gap``: hours since the previous row (NULL for the first / no time),
    * ``new_session`` (bool) and ``session`` (1, 2, ... per person),
    * ``elapsed``: hours since the person's first row,
    * ``within``: hours since the session's first row,
    * ``step``: ``within`` minus its previous value in the session, 0 at the
      session start (lag with default 0),
    * ``{c}_first`` for each ``carry_first`` column: its value on the
      person's first row (O3 without a join back).
    """
    rn = obs or "_rn"
    d = add_lags(df, key, time, seq, {"_tp": (time, 1)}, row_number=rn)
    g = (F.col(time) - F.col("_tp")) / F.lit(SECONDS_PER_HOUR)
    d = d.withColumn(gap, g).withColumn(
        new_session, F.col(gap).isNull() | (F.col(gap) > F.lit(float(gap_hours))))
    d = add_running(d, key, time, seq,
                    sums={session: F.col(new_session).cast("int")},
                    lasts={"_t0": F.when(F.col(rn) == 1, F.col(time)),
                           "_ts": F.when(F.col(new_session), F.col(time)),
                           **{f"_f_{c}": F.when(F.col(rn) == 1, F.struct(F.col(c).alias("v")))
                              for c in carry_first}})
    d = d.withColumns({f"{c}_first": F.col(f"_f_{c}.v") for c in carry_first}) \
        .drop(*[f"_f_{c}" for c in carry_first])
    hrs = F.lit(SECONDS_PER_HOUR)
    d = d.withColumns({
        session: F.col(session).cast("int"),
        elapsed: (F.col(time) - F.col("_t0")) / hrs,
        within: (F.col(time) - F.col("_ts")) / hrs,
    })
    d = d.withColumn(step, F.when(F.col(new_session), F.col(within))
                     .otherwise(F.col(within) - (F.col("_tp") - F.col("_ts")) / hrs))
    drop = ["_tp", "_t0", "_ts"] + ([] if obs else ["_rn"])
    return d.drop(*drop)


def series_lags(df: DataFrame, key: str, time: str, seq: str, session: str,
                lags: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``out = lag(col, k)`` inside the series (person, session).

    Computed along the person's record and masked where the lagged row
    belongs to another session, so a series never needs its own shuffle.
    """
    spec = dict(lags)
    ks = sorted({k for _, k in spec.values()})
    spec.update({f"_sl{k}": (session, k) for k in ks})
    d = add_lags(df, key, time, seq, spec)
    same = {k: F.col(f"_sl{k}").eqNullSafe(F.col(session)) for k in ks}
    d = d.withColumns({o: F.when(same[k], F.col(o)) for o, (_, k) in lags.items()})
    return d.drop(*[f"_sl{k}" for k in ks])


def run_sizes(df: DataFrame, key: str, time: str, seq: str, run: str,
              out: str = "run_n") -> DataFrame:
    """Number of rows of the row's run (e.g. session) inside the person.

    Runs are contiguous in (time, seq) order.  Size = position from the run
    start + position from the run end - 1, both from ordered scans, so a
    huge session is never gathered into one task.  Without a hot person it
    is a plain count over (person, run).
    """
    if hot_free(df):
        return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(key, run)).cast("long"))
    d = add_lags(df, key, time, seq, {"_pr": (run, 1)}, row_number="_fr")
    d = add_lags(d, key, time, seq, {"_nx": (run, 1)}, reverse=True, row_number="_br")
    d = d.withColumns({
        "_st": F.when(~F.col("_pr").eqNullSafe(F.col(run)), F.col("_fr")),
        "_en": F.when(~F.col("_nx").eqNullSafe(F.col(run)), F.col("_br")),
    })
    d = add_running(d, key, time, seq, lasts={"_fs": F.col("_st")})
    d = add_running(d, key, time, seq, lasts={"_be": F.col("_en")}, reverse=True)
    size = (F.col("_fr") - F.col("_fs") + 1) + (F.col("_br") - F.col("_be") + 1) - 1
    return d.withColumn(out, size.cast("long")).drop("_pr", "_nx", "_fr", "_br", "_st", "_en", "_fs", "_be")


def min_group_size(df: DataFrame, key: str, n: int, out: str | None = None) -> DataFrame:
    """Keep persons with at least ``n`` rows (K6), by chunk partial counts."""
    o = out or "_kn"
    d = add_key_totals(df, key, counts={o: F.lit(1)})
    d = d.where(F.col(o) >= F.lit(n))
    return d if out else d.drop(o)


def min_run_size(df: DataFrame, key: str, time: str, seq: str, run: str, n: int,
                 out: str | None = None) -> DataFrame:
    """Keep runs (series) with at least ``n`` rows (K7)."""
    o = out or "_rz"
    d = run_sizes(df, key, time, seq, run, o).where(F.col(o) >= F.lit(n))
    return d if out else d.drop(o)


def drop_zero_dt_duplicates(df: DataFrame, key: str, time: str, seq: str, session: str,
                            cols: Sequence[str], flag: str | None = None,
                            counts: Observation | None = None) -> DataFrame:
    """Drop a row that repeats the previous row of its series at zero interval.

    A row is an exact repeat when its time equals the previous row's time
    in the same series and every column in ``cols`` equals the previous
    value, NULL matching NULL.  All rows are compared with their previous
    row *before* anything is removed, so in A,A,A both later rows go.
    ``counts`` gets ``n_rows`` and ``n_repeats``, the rows removed.
    """
    lags = {f"_dl_{c}": (c, 1) for c in cols}
    lags["_dl_t"] = (time, 1)
    d = series_lags(df, key, time, seq, session, lags)
    zero = F.col("_dl_t").isNotNull() & (F.col(time) == F.col("_dl_t"))
    dup = zero
    for c in cols:
        dup = dup & F.col(c).eqNullSafe(F.col(f"_dl_{c}"))
    d = d.withColumn(flag or "_dup", dup)
    if counts is not None:
        d = observed(d, counts, {"n_repeats": F.col(flag or "_dup")})
    d = d.where(~F.col(flag or "_dup")).drop(*lags.keys())
    return d if flag else d.drop("_dup")


def center_within(df: DataFrame, key: str, cols: Sequence[str], *,
                  mean_suffix: str = "_pm", dev_suffix: str = "_wc") -> DataFrame:
    """Person means and within-person deviations (W7); NULLs skipped."""
    d = add_key_totals(df, key, moments={f"_cw_{c}": F.col(c) for c in cols})
    d = d.withColumns({f"{c}{mean_suffix}": F.col(f"_cw_{c}_mean") for c in cols})
    d = d.withColumns({f"{c}{dev_suffix}": F.col(c) - F.col(f"{c}{mean_suffix}") for c in cols})
    return d.drop(*[f"_cw_{c}_{s}" for c in cols for s in ("n", "mean", "var")])


def step_max_by_run(df: DataFrame, key: str, time: str, seq: str, run: str,
                    step: str = "dt") -> DataFrame:
    """Hours between consecutive rows of a run, NULL at the run start (A13 input)."""
    d = series_lags(df, key, time, seq, run, {"_sp": (time, 1)})
    return d.withColumn(step, (F.col(time) - F.col("_sp")) / F.lit(SECONDS_PER_HOUR)).drop("_sp")


def sequential_id(df: DataFrame, key: str, out: str = "person_id") -> DataFrame:
    """Dense 1-based number of each distinct key in ascending order.

    Distinct keys are range-partitioned and sorted; each key's number is
    its position inside its range partition plus the sizes of the earlier
    partitions (a table of one row per partition, broadcast).  No single
    task sees all keys and no rows pass through the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = (df.select(key).where(F.col(key).isNotNull()).distinct()
           .repartitionByRange(parts, key).sortWithinPartitions(key)
           .withColumn("_p", F.spark_partition_id())
           .withColumn("_i", F.monotonically_increasing_id()))
    # monotonically_increasing_id = (partition << 33) + position in partition.
    # The numbered keys are written once (shared folder) so both uses below
    # see one fixed range split, also after a lost executor.
    ids = write_through(ids.select(
        key, "_p", (F.col("_i") - F.shiftleft(F.col("_p").cast("bigint"), 33)).alias("_pos")))
    sizes = ids.groupBy("_p").agg(F.max("_pos").alias("_last"))
    offsets = sizes.select("_p", F.coalesce(F.sum(F.col("_last") + 1).over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    mapping = ids.join(F.broadcast(offsets), "_p").select(
        key, (F.col("_off") + F.col("_pos") + 1).cast("long").alias(out))
    if CHUNK not in df.columns or hot_free(df):
        return df.join(mapping, on=key, how="left")
    # split persons: the number travels by chunk, so no join gathers a person
    chunks = df.select(key, *part_keys()).distinct().join(mapping, key, "left").drop(key)
    return df.join(chunks, on=part_keys(), how="left")


def drop_helpers(df: DataFrame) -> DataFrame:
    """Remove the chunk bookkeeping columns before writing a result."""
    return df.drop(CHUNK, NCHUNKS, PERSON)


__all__ = [
    "obs_counter", "elapsed_and_step", "sessionize", "series_lags", "run_sizes",
    "min_group_size", "min_run_size", "drop_zero_dt_duplicates", "center_within",
    "step_max_by_run", "sequential_id", "drop_helpers", "single_chunk", "ensure_chunks",
]
