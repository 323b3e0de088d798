"""Ordered scans over each person's record that survive a hot person.

A window ``partitionBy(id).orderBy(time)`` puts a person's whole record in
one task.  If one person holds a third of all rows that task never ends.
Here every ordered operation (row numbers, lags, gaps, running sums) runs
over ``partitionBy(_k, _m, _c)`` where ``_c`` is an order-preserving chunk
of the person's record and ``_k`` the id in a struct, so that rows without
an id form one person, as they do in a plain window:

* ordinary persons (at most ``rows_per_chunk`` rows, a fixed target that
  doesn't depend on the session) keep one chunk ``_c = 0``;
* a *hot* person's rows carry the number of the piece into which range
  partitioning on (time, seq) puts them, so tied times and missing times are
  cut too; what a chunk needs from the chunks before it (the last rows for a
  lag, the sum so far for a running count) is a prefix scan over small
  per-chunk tables, joined back on ``(_k, _m, _c)``.

With a hot person, each operation writes its windows' result once to the
shared folder before it derives the per-chunk tables from it, so plans stay
short however many operations follow each other.  Without one the plan is
made of plain windows.

Order is ``time ASC NULLS LAST, seq ASC``: rows without a time come last,
and ``seq`` (a unique input row number) breaks ties, so results never
depend on the physical order of the input.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import discard, write_through

CHUNK = "_c"        # chunk number inside a person (0 for ordinary persons)
NCHUNKS = "_m"      # number of pieces of all hot persons on their rows, 0 on others
PERSON = "_k"       # the id in a struct: equal to itself even where it is NULL
ROWS_PER_CHUNK = 1_000_000   # a person with more rows is split


def part_keys() -> list[str]:
    """The partitioning of every ordered operator on split persons."""
    return [PERSON, NCHUNKS, CHUNK]


def order_cols(time: str, seq: str, reverse: bool = False) -> list[Column]:
    if reverse:
        return [F.col(time).desc_nulls_first(), F.col(seq).desc()]
    return [F.col(time).asc_nulls_last(), F.col(seq).asc()]


def assign_chunks(df: DataFrame, key: str, time: str, seq: str, *,
                  rows_per_chunk: int = ROWS_PER_CHUNK,
                  stats_from: DataFrame | None = None) -> DataFrame:
    """Add ``_k``/``_m``/``_c``: split persons of more than ``rows_per_chunk`` rows.

    ``time`` must be numeric (epoch seconds).  ``stats_from`` may be any
    frame with the same key, time and seq (e.g. the raw long table before a
    pivot).  Row counts are a partial (map-side combined) aggregate.  The
    rows of hot persons, and of no others, are range partitioned on
    (person, time, seq) into pieces of half the target, as the range
    partitioner works on a sample; the piece a row falls into is its chunk.
    No borders are gathered or compared with: a hot row costs one shuffle.
    The pieces are written, so every later use sees the same ones.
    """
    if CHUNK in df.columns:
        return df
    src = stats_from if stats_from is not None else df
    person = F.struct(F.col(key).alias("id"))
    hot = write_through(src.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                        .where(F.col("_n") > rows_per_chunk).select(person.alias(PERSON), "_n"))
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        discard(hot)
        return single_chunk(df)
    pieces = -(-2 * rows // rows_per_chunk)
    both = write_through(df.withColumn(PERSON, person))     # read for the hot persons and for the others
    place = [F.col(PERSON), *order_cols(time, seq)]
    own = both.join(hot, PERSON, "left_semi").repartitionByRange(int(pieces), *place)
    own = write_through(own.withColumns({NCHUNKS: F.lit(int(pieces)), CHUNK: F.spark_partition_id()}))
    rest = both.join(hot, PERSON, "left_anti").withColumns({NCHUNKS: F.lit(0), CHUNK: F.lit(0)})
    return own.unionByName(rest)


def ensure_chunks(df: DataFrame, key: str, time: str, seq: str, **kw) -> DataFrame:
    return df if CHUNK in df.columns else assign_chunks(df, key, time, seq, **kw)


HOT_FREE = "panelflow.no_hot_person"


def single_chunk(df: DataFrame) -> DataFrame:
    """Mark every person as ordinary: no person exceeds its share of rows.

    The mark travels as column metadata, so later operators build plain
    windows over the person (no carry branches at all).
    """
    if CHUNK in df.columns:
        return df
    d = df.withColumns({NCHUNKS: F.lit(0), CHUNK: F.lit(0)})
    return d.withMetadata(NCHUNKS, {HOT_FREE: True})


def hot_free(df: DataFrame) -> bool:
    """True when the frame is known to hold no hot person."""
    if NCHUNKS not in df.columns:
        return False
    return bool(df.schema[NCHUNKS].metadata.get(HOT_FREE, False))


def _w(keys: list[str], time: str, seq: str, reverse: bool) -> Window:
    return Window.partitionBy(*keys).orderBy(*order_cols(time, seq, reverse))


def add_lags(df: DataFrame, key: str, time: str, seq: str,
             lags: Mapping[str, tuple[str, int]], *, reverse: bool = False,
             row_number: str | None = None) -> DataFrame:
    """``out = lag(col, k)`` in (time, seq) order within ``key``, exact across chunks.

    ``reverse=True`` gives leads.  ``row_number`` also names the global
    1-based position of the row inside the person (W1).
    """
    d = ensure_chunks(df, key, time, seq)
    if hot_free(d):
        w = _w([key], time, seq, reverse)
        new = {o: F.lag(c, k).over(w) for o, (c, k) in lags.items()}
        if row_number:
            new[row_number] = F.row_number().over(w)
        return d.withColumns(new)
    w = _w(part_keys(), time, seq, reverse)
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kmax = max([k for _, k in lags.values()] + [1])
    d = d.withColumns({"_r": F.row_number().over(w), "_nr": F.count(F.lit(1)).over(wall)})
    d = write_through(d.withColumns({f"_l_{o}": F.lag(c, k).over(w) for o, (c, k) in lags.items()}))

    hot = F.col(NCHUNKS) > 0
    # Head and tail rows of every chunk of a hot person.  Ordered by time
    # within the person, the k rows before a head row are all in this set.
    edge = d.where(hot & ((F.col("_r") <= kmax) | (F.col("_r") > F.col("_nr") - kmax)))
    we = Window.partitionBy(PERSON).orderBy(*order_cols(time, seq, reverse))
    edge = edge.select(*part_keys(), "_r", "_nr",
                       *[F.lag(c, k).over(we).alias(f"_e_{o}") for o, (c, k) in lags.items()])
    heads = edge.where(F.col("_r") <= kmax)
    cols = [F.max(F.when(F.col("_r") == r, F.col(f"_e_{o}"))).alias(f"_h{r}_{o}")
            for o, (_, k) in lags.items() for r in range(1, k + 1)]
    cols.append(F.max("_nr").alias("_cn"))
    carry = heads.groupBy(*part_keys()).agg(*cols)
    wc = Window.partitionBy(PERSON).orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_off", F.coalesce(F.sum("_cn").over(wc), F.lit(0))).drop("_cn")

    d = d.join(carry, on=part_keys(), how="left")
    new = {}
    for o, (_, k) in lags.items():
        fix = None
        for r in range(1, k + 1):
            cond = F.col("_r") == r
            fix = F.when(cond, F.col(f"_h{r}_{o}")) if fix is None else fix.when(cond, F.col(f"_h{r}_{o}"))
        new[o] = F.when(F.col("_r") > k, F.col(f"_l_{o}")).otherwise(fix)
    if row_number:
        new[row_number] = (F.col("_r") + F.coalesce(F.col("_off"), F.lit(0))).cast("int")
    d = d.withColumns(new)
    drop = ["_r", "_nr", "_off"] + [f"_l_{o}" for o in lags] + \
        [f"_h{r}_{o}" for o, (_, k) in lags.items() for r in range(1, k + 1)]
    return d.drop(*drop)


def add_running(df: DataFrame, key: str, time: str, seq: str, *,
                sums: Mapping[str, Column] | None = None,
                lasts: Mapping[str, Column] | None = None,
                reverse: bool = False) -> DataFrame:
    """Running values in (time, seq) order within ``key``, exact across chunks.

    ``sums[out]``: running sum (current row included) of an integer column.
    ``lasts[out]``: last non-NULL value so far (current row included).
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if not sums and not lasts:
        return df
    d = ensure_chunks(df, key, time, seq)
    if hot_free(d):
        wrun = _w([key], time, seq, reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return d.withColumns({**{o: F.sum(e).over(wrun) for o, e in sums.items()},
                              **{o: F.last(e, ignorenulls=True).over(wrun) for o, e in lasts.items()}})
    d = d.withColumns({**{f"_se_{o}": e for o, e in sums.items()},
                       **{f"_ve_{o}": e for o, e in lasts.items()}})
    w = _w(part_keys(), time, seq, reverse)
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_r": F.row_number().over(w),
                       **{f"_s_{o}": F.sum(f"_se_{o}").over(wrun) for o in sums},
                       **{f"_v_{o}": F.last(f"_ve_{o}", ignorenulls=True).over(wrun) for o in lasts}})
    d = write_through(d)
    hot = F.col(NCHUNKS) > 0
    agg = [F.sum(f"_se_{o}").alias(f"_ts_{o}") for o in sums] + \
          [F.max_by(f"_ve_{o}", F.when(F.col(f"_ve_{o}").isNotNull(), F.col("_r"))).alias(f"_tv_{o}")
           for o in lasts]
    tot = d.where(hot).groupBy(*part_keys()).agg(*agg)
    wc = Window.partitionBy(PERSON).orderBy(F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*part_keys(),
                       *[F.sum(f"_ts_{o}").over(wc).alias(f"_cs_{o}") for o in sums],
                       *[F.last(f"_tv_{o}", ignorenulls=True).over(wc).alias(f"_cv_{o}") for o in lasts])
    d = d.join(carry, on=part_keys(), how="left")
    d = d.withColumns({
        **{o: F.col(f"_s_{o}") + F.coalesce(F.col(f"_cs_{o}"), F.lit(0)) for o in sums},
        **{o: F.coalesce(F.col(f"_v_{o}"), F.col(f"_cv_{o}")) for o in lasts}})
    drop = ["_r"] + [p + o for o in sums for p in ("_se_", "_s_", "_cs_")] + \
        [p + o for o in lasts for p in ("_ve_", "_v_", "_cv_")]
    return d.drop(*drop)


def add_key_totals(df: DataFrame, key: str, *, counts: Mapping[str, Column] | None = None,
                   sums: Mapping[str, Column] | None = None,
                   moments: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-person totals attached to every row, without a window over the person.

    ``counts[out]``: number of non-NULL values; ``sums[out]``: sum;
    ``moments[out]``: adds ``out_n``, ``out_mean``, ``out_var`` (sample
    variance, NULL below two values) merged exactly from chunk moments.
    Works on (id, _c): partials per chunk (no shuffle of the big side),
    one small window per hot person, joined back on (id, _c).
    """
    counts, sums, moments = dict(counts or {}), dict(sums or {}), dict(moments or {})
    d = df if CHUNK in df.columns else single_chunk(df)
    if hot_free(d):
        wk = Window.partitionBy(key)
        new = {o: F.count(e).over(wk) for o, e in counts.items()}
        new.update({o: F.sum(e).over(wk) for o, e in sums.items()})
        for o, e in moments.items():
            x = e.cast("double")
            new.update({f"{o}_n": F.count(x).over(wk), f"{o}_mean": F.avg(x).over(wk),
                        f"{o}_var": F.var_samp(x).over(wk)})
        return d.withColumns(new)
    agg = [F.count(e).alias(f"_kc_{o}") for o, e in counts.items()] + \
          [F.sum(e).alias(f"_ks_{o}") for o, e in sums.items()]
    for o, e in moments.items():
        x = e.cast("double")
        agg += [F.count(x).alias(f"_kn_{o}"), F.avg(x).alias(f"_ka_{o}"),
                (F.var_pop(x) * F.count(x)).alias(f"_km_{o}")]
    d = write_through(d)
    part = d.groupBy(*part_keys()).agg(*agg)
    wk = Window.partitionBy(PERSON)
    sel = [F.col(c) for c in part_keys()]
    sel += [F.sum(f"_kc_{o}").over(wk).alias(o) for o in counts]
    sel += [F.sum(f"_ks_{o}").over(wk).alias(o) for o in sums]
    for o in moments:
        n = F.sum(f"_kn_{o}").over(wk)
        mean = F.try_divide(F.sum(F.col(f"_kn_{o}") * F.col(f"_ka_{o}")).over(wk), n.cast("double"))
        sel += [n.alias(f"{o}_n"), mean.alias(f"{o}_mean")]
    tot = part.select(*sel, *[c for o in moments for c in (f"_kn_{o}", f"_ka_{o}", f"_km_{o}")])
    for o in moments:
        dev = F.coalesce(F.col(f"_km_{o}"), F.lit(0.0)) + F.coalesce(
            F.col(f"_kn_{o}") * (F.col(f"_ka_{o}") - F.col(f"{o}_mean")) ** 2, F.lit(0.0))
        m2 = F.sum(dev).over(wk)
        tot = tot.withColumn(f"{o}_var", F.when(F.col(f"{o}_n") >= 2,
                                                m2 / (F.col(f"{o}_n") - F.lit(1)).cast("double")))
    tot = tot.drop(*[c for o in moments for c in (f"_kn_{o}", f"_ka_{o}", f"_km_{o}")])
    return d.join(tot, on=part_keys(), how="left")
