"""User-level compositions (D1-D13): raw long responses -> model designs.

Each step is a plain ``DataFrame -> DataFrame`` function parameterised by
:class:`PanelConfig`; the study's column names are only defaults.  No step
collects rows; the only actions are the bounded hot-person lookup of the
ordered scans and the duplicate-cell check of the pivot (policy "error").
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions import columns as C
from panelflow.operators import aggregates as A
from panelflow.operators import filters as K
from panelflow.operators import joins as J
from panelflow.operators import reshape as R
from panelflow.operators import timeseries as W
from panelflow.operators.ordered import ROWS_PER_CHUNK, assign_chunks
from panelflow.session import write_through


@dataclass
class PanelConfig:
    id: str = "ID"
    time: str = "t"                 # epoch seconds (double)
    seq: str = "seq"                # unique input row number, last sort key
    group: str = "ADHD"
    positive: str = "Y"
    group_flag: str = "ADHD_numeric"
    scales: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "anti": ["item1", "item2", "item3", "item4"],
        "pro": ["item5", "item6", "item7", "item8"]})
    scores: Mapping[str, str] = field(default_factory=lambda: {"anti": "Y1", "pro": "Y2"})
    context_cols: Sequence[str] = ("Alone", "SocialMedia", "InPerson")
    gap_hours: float = 30.0
    min_obs: int = 0
    min_series_obs: int = 3
    row_rule: str = "any"           # keep a prompt with any / all scale items
    exclude_ids: Sequence = ()
    center_stage: str = "before"    # person means from the rows before / after the series filter
    group_labels: tuple[str, str] = ("ADHD", "Control")   # of the positive group, of the others
    scale_labels: Mapping[str, str] = field(default_factory=lambda: {"anti": "Hostile", "pro": "Prosocial"})
    series_base: int = 1000
    materialize: bool = True        # write stage results to the shared folder
    rows_per_chunk: int = ROWS_PER_CHUNK   # persons with more rows are split

    @property
    def items(self) -> list[str]:
        return [c for cs in self.scales.values() for c in cs]

    def score_means(self) -> dict[str, str]:
        return {s: f"{s}_mean" for s in self.scales}


def materialize(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Keep a stage result that several branches read (filters, global
    statistics, joins back) so the upstream runs once: it is written to the
    shared folder and read back, which cuts lineage and leaves nothing
    persisted.
    """
    return write_through(df) if cfg.materialize else df


# --- D1 -----------------------------------------------------------------------
def read_raw(raw: DataFrame, cfg: PanelConfig, *, id: str = "participant_id",
             time: str = "notification_time", session_no: str = "session_instance_no",
             group: str = "adhd", label: str = "prompt_label", value: str = "response",
             seq: str = "seq", sentinel: str = C.SKIPPED_SENTINEL) -> DataFrame:
    """Raw response rows (text values and times) -> what ``prepare_panel`` takes.

    The sentinel of a skipped answer becomes NULL; the value stays text, as
    an answer that is no number still is an answer (it becomes NULL when
    items are made numeric).  The time is parsed to epoch seconds; its text
    stays as ``time_text``, so prompts whose times can't be parsed stay
    apart.  ``bad_time`` and ``bad_value`` mark what couldn't be parsed.
    """
    answer = C.null_if(F.col(value), sentinel)
    return raw.select(
        F.col(id).alias(cfg.id), F.col(time).alias("time_text"), C.epoch_seconds_text(time).alias(cfg.time),
        F.col(session_no).alias("SessionNumb"), F.col(group).alias(cfg.group), F.col(label).alias("label"),
        answer.alias("value"), F.col(seq).alias(cfg.seq),
        (F.col(time).isNotNull() & C.epoch_seconds_text(time).isNull()).alias("bad_time"),
        (answer.isNotNull() & C.to_number(answer).isNull()).alias("bad_value"),
        F.coalesce(F.col(value) == sentinel, F.lit(False)).alias("skipped"))


def parse_report(responses: DataFrame) -> DataFrame:
    """One row: rows, skipped answers, and times and values that couldn't be parsed."""
    return A.quality_report(responses, C.flag_rules({
        "n_skipped": F.col("skipped"), "n_bad_time": F.col("bad_time"), "n_bad_value": F.col("bad_value"),
        "n_no_session": F.col("SessionNumb").isNull()}))


def prepare_raw_panel(raw: DataFrame, cfg: PanelConfig, labels: Sequence[str] | Mapping[str, str], *,
                      on_duplicate: str = "error", **columns) -> DataFrame:
    """Raw response rows -> wide panel: sentinel, times, prompts, weekday and obs in one flow."""
    return prepare_panel(read_raw(raw, cfg, **columns), cfg, "label", "value", labels,
                         on_duplicate=on_duplicate, session_no="SessionNumb", extra_keys=["time_text"])


def prepare_panel(long: DataFrame, cfg: PanelConfig, label: str, value: str,
                  labels: Sequence[str] | Mapping[str, str], *, on_duplicate: str = "error",
                  session_no: str | None = None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Raw long responses -> wide panel with weekday, weekend and obs.

    ``long`` has ``cfg.id``, ``cfg.time`` (epoch s, NULL when unparsable),
    ``cfg.seq``, ``cfg.group``, ``label`` and ``value``.
    """
    d = long
    if session_no:
        d = K.require(d, [session_no])
    d = K.exclude_ids(d, cfg.id, cfg.exclude_ids)
    keys = [cfg.id, cfg.time, cfg.group, *([session_no] if session_no else []), *extra_keys]
    wide = R.pivot_prompts(d, keys, label, value, labels, seq=cfg.seq, on_duplicate=on_duplicate)
    wide = wide.withColumns({"day_of_week": C.weekday_label_epoch(cfg.time),
                             "weekend": C.weekend_flag_epoch(cfg.time)})
    wide = assign_chunks(wide, cfg.id, cfg.time, cfg.seq, rows_per_chunk=cfg.rows_per_chunk, stats_from=d)
    return W.obs_counter(wide, cfg.id, cfg.time, cfg.seq, "obs")


# --- D2 -----------------------------------------------------------------------
def sessionize_panel(wide: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Row rule, numeric items, 30 h gap sessions and clocks."""
    d = C.to_numeric(wide, [c for c in cfg.items + list(cfg.context_cols) if c in wide.columns])
    d = K.keep_any(d, cfg.items) if cfg.row_rule == "any" else K.complete_cases(d, cfg.items)
    d = W.sessionize(d, cfg.id, cfg.time, cfg.seq, cfg.gap_hours, carry_first=[cfg.group])
    return materialize(d, cfg)


# --- D3 -----------------------------------------------------------------------
def person_table(ema: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row per person: first row's group value and the 0/1 flag."""
    first = J.first_row(ema, cfg.id, cfg.time, cfg.seq, [cfg.group])
    return first.withColumn(cfg.group_flag, C.group_flag(cfg.group, cfg.positive))


def with_covariates(persons: DataFrame, covariates: DataFrame, on: str) -> DataFrame:
    """Left-join covariates so a person without them keeps their group (Q10)."""
    return J.attach_person(persons, covariates, on)


# --- D4 -----------------------------------------------------------------------
def quality_filters(ema: DataFrame, cfg: PanelConfig, var_threshold: float | None = None) -> DataFrame:
    """Minimum rows per person, then the pooled-variance check (D4: K6, K8)."""
    d = W.min_group_size(ema, cfg.id, cfg.min_obs) if cfg.min_obs > 0 else ema
    return K.variance_filter(d, cfg.id, cfg.scales, var_threshold)


# --- D5 -----------------------------------------------------------------------
def score_scales(ema: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Row means of each scale, then z-scores by the grand mean and SD."""
    d = ema.withColumns({f"{s}_mean": C.row_mean(cs) for s, cs in cfg.scales.items()})
    return standardize(d, {f"{s}_mean": cfg.scores[s] for s in cfg.scales})


def standardize(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """``out = (x - mean) / sd`` with the global mean and sample SD (P20).

    The one-row statistics are cross-joined as a broadcast; a zero or
    undefined SD gives NULL, never an error.
    """
    stats = df.agg(*[F.avg(c).alias(f"_gm_{c}") for c in cols],
                   *[F.stddev_samp(c).alias(f"_gs_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(stats))
    d = d.withColumns({o: F.try_divide(F.col(c) - F.col(f"_gm_{c}"), F.col(f"_gs_{c}"))
                       for c, o in cols.items()})
    return d.drop(*[f"_gm_{c}" for c in cols], *[f"_gs_{c}" for c in cols])


# --- D6 -----------------------------------------------------------------------
def context_features(ema: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Contexts NULL->0 and binarised, group flag, group x context/weekend."""
    ctx = [c for c in cfg.context_cols if c in ema.columns]
    d = C.binarize_columns(ema, ctx)
    if cfg.group_flag not in d.columns:
        d = d.withColumn(cfg.group_flag, C.group_flag(f"{cfg.group}_first", cfg.positive))
    d = d.withColumns(C.interactions(cfg.group_flag, ctx, prefix=f"{cfg.group}_x_"))
    return d.withColumns(C.interactions(cfg.group_flag, ["weekend"], prefix=f"{cfg.group}_x_"))


# --- D7 -----------------------------------------------------------------------
def build_series(ema: DataFrame, cfg: PanelConfig, dedupe: bool = True) -> DataFrame:
    """Person numbers, series key and clock, series filter, zero-interval
    duplicate removal (D7: W6, P23, K7, K9)."""
    d = W.sequential_id(ema, cfg.id, "person_id")
    d = d.withColumns({"ctsem_id": C.series_key("person_id", "session", cfg.series_base),
                       "ctsem_time": F.col("TimeHours"),
                       "series_key_collision": C.series_key_collides("session", cfg.series_base)})
    d = W.min_run_size(d, cfg.id, cfg.time, cfg.seq, "session", cfg.min_series_obs)
    if dedupe:
        d = W.drop_zero_dt_duplicates(d, cfg.id, cfg.time, cfg.seq, "session",
                                      list(cfg.scores.values()))
    return materialize(d, cfg)


# --- D8 / D9 -------------------------------------------------------------------
def var_design(series: DataFrame, cfg: PanelConfig, order: int = 1, center: bool = True,
               interact: Sequence[str] = ()) -> DataFrame:
    """Lagged design inside each series (D8 order 1 centred, D9 order 2 raw).

    ``center``: person means (``_pm``), within deviations (``_wc``), their
    lags and lagged means; rows need both lagged deviations and ``dt > 0``.
    Otherwise: raw lags 1..``order``; rows need all lags, both scores and
    ``dt > 0``.  Adds ``dt`` (hours), ``log_dt`` and group products.
    """
    y = list(cfg.scores.values())
    key, t, s = cfg.id, cfg.time, cfg.seq
    d = series
    if center:
        d = W.center_within(d, key, y)
        lags = {f"{c}_lag_wc": (f"{c}_wc", 1) for c in y}
        lags.update({f"{c}_pm_lag": (f"{c}_pm", 1) for c in y})
    else:
        lags = {}
        for k in range(1, order + 1):
            lags.update({f"{c}_lag" + ("" if k == 1 else str(k)): (c, k) for c in y})
    lags["_tprev"] = (t, 1)
    d = W.series_lags(d, key, t, s, "session", lags)
    d = d.withColumn("dt", (F.col(t) - F.col("_tprev")) / F.lit(C.SECONDS_PER_HOUR)).drop("_tprev")
    need = [o for o in lags if o != "_tprev" and ("_pm_lag" not in o)]
    if not center:
        need += y
    d = K.require_lags(d, need, "dt")
    d = d.withColumn("log_dt", F.ln("dt"))
    if center and cfg.group_flag in d.columns:
        g = cfg.group_flag
        prods = {f"{cfg.group}_x_{c}_lag": F.col(g) * F.col(f"{c}_lag_wc") for c in y}
        prods[f"{cfg.group}_x_log_dt"] = F.col(g) * F.col("log_dt")
        prods.update({f"{cfg.group}_x_{c}": F.col(g) * F.col(c) for c in interact})
        d = d.withColumns(prods)
    return d


# --- D10 ------------------------------------------------------------------------
def response_pattern(wide: DataFrame, cfg: PanelConfig, items: Sequence[str] | None = None,
                     pattern: str = r"(\d+)_present$", numeric_item: bool = True) -> DataFrame:
    """Long table of item presence with the raw session clock.

    One row per prompt x item: ``responded`` 0/1, ``item`` number,
    ``RawHours`` and ``session`` from the any-item sessions.
    """
    items = list(items or cfg.items)
    d = wide.withColumns(C.presence_flags(items))
    d = K.keep_any(d, items)
    d = W.sessionize(d, cfg.id, cfg.time, cfg.seq, cfg.gap_hours)
    ids = [cfg.id, cfg.seq, cfg.group, "RawHours", "session"]
    return R.unpivot_items(d, ids, [f"{c}_present" for c in items], name="item",
                           value="responded", pattern=pattern, numeric_name=numeric_item)


# --- D11 ------------------------------------------------------------------------
def item_point_table(ema: DataFrame, cfg: PanelConfig, stat: str = "var") -> DataFrame:
    """One row per person and item: its statistic, ``var`` or ``mean``, with the labels of group, item and scale."""
    items = cfg.items
    per = A.item_stats(ema, [cfg.id, cfg.group], items, (stat,))
    long = R.unpivot_items(per, [cfg.id, cfg.group], [f"{stat}_{c}" for c in items],
                           name="variable", value="value")
    names = [f"{stat}_{c}" for c in items]
    scale_of = {f"{stat}_{c}": cfg.scale_labels.get(s, s) for s, cs in cfg.scales.items() for c in cs}
    return long.withColumns({
        "group_label": F.when(F.col(cfg.group) == F.lit(cfg.positive), F.lit(cfg.group_labels[0]))
        .otherwise(F.lit(cfg.group_labels[1])),
        "item_order": C.level_order("variable", names),
        "item_label": C.recode("variable", {n: f"Item {i + 1}" for i, n in enumerate(names)}),
        "subscale": C.recode("variable", scale_of)})


def item_group_tables(ema: DataFrame, cfg: PanelConfig, stat: str = "var") -> DataFrame:
    """Group bands of a per-person item statistic, ``var`` or ``mean``."""
    return A.mean_ci(item_point_table(ema, cfg, stat), ["group_label", "variable", "item_order", "subscale"], "value")


# --- D12 ------------------------------------------------------------------------
GRAND, WITHIN = "Grand-mean centred", "Within-person centred"


def centred_series(features: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Series with within-person deviations ``_wpc`` of the scores.

    ``center_stage="before"``: the person means are those of all scored
    rows, taken before short series go; ``"after"``: of the rows that stay.
    """
    y = list(cfg.scores.values())
    if cfg.center_stage == "before":
        return build_series(W.center_within(features, cfg.id, y, dev_suffix="_wpc"), cfg, dedupe=False)
    return W.center_within(build_series(features, cfg, dedupe=False), cfg.id, y, dev_suffix="_wpc")


def centred_long(series: DataFrame, cfg: PanelConfig, ids: Sequence[str] = ()) -> DataFrame:
    """(ids, Centering, Variable, Value): scores under both centrings (D12), one scan."""
    centring, scale = {}, {}
    for s, y in cfg.scores.items():
        centring[y], centring[f"{y}_wpc"] = GRAND, WITHIN
        scale[y] = scale[f"{y}_wpc"] = cfg.scale_labels.get(s, s)
    long = R.unpivot_items(series, list(ids), list(centring), name="_c", value="Value")
    return long.select(*ids, C.recode("_c", centring).alias("Centering"), C.recode("_c", scale).alias("Variable"), "Value")


def trajectories(series: DataFrame, cfg: PanelConfig) -> DataFrame:
    """The table behind person trajectories: one row per prompt, score and centring."""
    label = F.when(F.col(cfg.group_flag) == 1, F.lit(cfg.group_labels[0])).otherwise(F.lit(cfg.group_labels[1]))
    ids = [cfg.id, "Group", "session", "ctsem_id", "ctsem_time", cfg.seq]
    return centred_long(series.withColumn("Group", label), cfg, ids)


def trajectory_smooth(series: DataFrame, cfg: PanelConfig, **options) -> DataFrame:
    """Local regression with band of the trajectories by centring, score and group."""
    from panelflow.models.local import local_regression
    return local_regression(trajectories(series, cfg), "ctsem_time", "Value", ["Centering", "Variable", "Group"], **options)


# --- D13 ------------------------------------------------------------------------
def reliability_long(ema: DataFrame, cfg: PanelConfig, items: Sequence[str] | None = None) -> DataFrame:
    """ID, occasion (row number in the person), item, value."""
    items = list(items or cfg.items)
    d = W.obs_counter(ema, cfg.id, cfg.time, cfg.seq, "occasion")
    return R.unpivot_items(d, [cfg.id, "occasion"], items, name="item", value="value")
