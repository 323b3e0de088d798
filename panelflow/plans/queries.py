"""Registered queries over the driver tables (one per operator group).

Every query reads the given parquet tables (``events``, ``customer``,
``nation``, ``lineitem``) through the whole tables; nothing is sampled or
capped.  Doubles are rounded to 6 decimals at the end so the results can
be compared with the DuckDB oracle in :mod:`panelflow.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions import columns as C
from panelflow.models import moments as M
from panelflow.operators import aggregates as A
from panelflow.operators import filters as K
from panelflow.operators import joins as J
from panelflow.operators import reshape as R
from panelflow.operators import timeseries as W
from panelflow.plans import compose as D
from panelflow.session import discard, ensure_checkpoint_dir, write_through
from panelflow.sources import tables as S

DIGITS = 6

SPARSE_CFG = D.PanelConfig(
    scales={"anti": list(S.SPARSE_SCALE_A), "pro": list(S.SPARSE_SCALE_B)},
    context_cols=list(S.SPARSE_CONTEXTS),
)
LINE_COLS = ["l_quantity", "price_k", "l_discount", "l_tax"]
LINE_SCALES = {"size": ["l_quantity", "price_k"], "rate": ["l_discount", "l_tax"]}


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Drop bookkeeping columns, round doubles, widen integers to bigint."""
    df = W.drop_helpers(df)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)   # no negative zero
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shared stages ---------------------------------------------------------------
def dense(spark, sf):
    return S.events_long(spark, sf).select("ID", "t", "seq", "ADHD", "Y1", "Y2")


def dense_sessions(spark, sf):
    return W.sessionize(dense(spark, sf), "ID", "t", "seq", 30.0, obs="obs")


def sparse_wide(spark, sf):
    return D.prepare_panel(S.sparse_responses(spark, sf), SPARSE_CFG, "label", "value",
                           list(S.SPARSE_LABELS), on_duplicate="max")


def sparse_sessions(spark, sf):
    return D.sessionize_panel(sparse_wide(spark, sf), SPARSE_CFG)


def sparse_scored(spark, sf):
    ema = D.quality_filters(sparse_sessions(spark, sf), SPARSE_CFG)
    return D.score_scales(ema, SPARSE_CFG)


def sparse_features(spark, sf):
    return D.context_features(sparse_scored(spark, sf), SPARSE_CFG)


def sparse_series(spark, sf):
    return D.build_series(sparse_features(spark, sf), SPARSE_CFG)


def persons(spark, sf):
    """Person table with covariates: customer by key, nation through the key map."""
    p = D.person_table(sparse_sessions(spark, sf), SPARSE_CFG)
    cust = S.driver_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"), "c_acctbal", "c_mktsegment", "c_nationkey")
    nat = S.driver_table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name")
    cov = J.natural_join(cust, nat)
    return D.with_covariates(p, cov, "ID")


def lineitem(spark, sf):
    li = S.driver_table(spark, sf, "lineitem")
    return li.select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000.0).alias("price_k"),
                     "l_discount", "l_tax")


# --- queries -----------------------------------------------------------------------
def q_w4_sessionize(spark, sf):
    d = dense_sessions(spark, sf)
    return finish(d.select("ID", "seq", "obs", "session", "new_session", "gap_hours",
                           "RawHours", "TimeHours", "time_interval"))


def q_a1_session_sizes(spark, sf):
    return finish(A.count_by(dense_sessions(spark, sf), ["ID", "session"], "n_obs"))


def q_a3_gap_summary(spark, sf):
    return finish(A.gap_summary(dense_sessions(spark, sf), "gap_hours", 30.0))


def q_a2_distinct_counts(spark, sf):
    d = dense_sessions(spark, sf)
    return finish(d.agg(A.distinct_count("ID").alias("n_persons"),
                        A.distinct_count(["ID", "session"]).alias("n_sessions")))


def q_w2_w3_elapsed_step(spark, sf):
    d = W.elapsed_and_step(dense(spark, sf), "ID", "t", "seq")
    return finish(d.select("ID", "seq", "TimeHours", "time_interval"))


def q_r1_pivot_prompts(spark, sf):
    return finish(sparse_wide(spark, sf))


def q_r1_duplicate_cells(spark, sf):
    d = R.duplicate_cells(S.sparse_responses(spark, sf), ["ID", "t", "ADHD"], "label")
    return finish(d.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_values")))


def q_d2_sessionize_panel(spark, sf):
    d = sparse_sessions(spark, sf)
    return finish(d.select("ID", "seq", "obs", "session", "gap_hours", "RawHours", "TimeHours",
                           "time_interval", "ADHD_first", "weekend", "day_of_week"))


def q_d3_person_table(spark, sf):
    return finish(persons(spark, sf))


def q_a14_describe_persons(spark, sf):
    p = persons(spark, sf)
    n = A.count_by(sparse_sessions(spark, sf), ["ID"], "n_prompts")
    return finish(A.describe_numeric(p.join(n, "ID"), ["c_acctbal", "ADHD_numeric", "n_prompts"]))


def q_k8_variance_flags(spark, sf):
    d = K.pooled_variance_flags(sparse_sessions(spark, sf), "ID", SPARSE_CFG.scales)
    # variances of some 1e3: beyond 4 decimals they depend on the order of summation
    return finish(d.select("ID", "var_anti", "var_pro", "flag_any").distinct(), digits=4)


def q_d5_score_scales(spark, sf):
    d = sparse_scored(spark, sf)
    return finish(d.select("ID", "seq", "anti_mean", "pro_mean", "Y1", "Y2"))


def q_a8_context_freq(spark, sf):
    return finish(A.freq_table(sparse_features(spark, sf), list(S.SPARSE_CONTEXTS)))


def q_a9_describe_groups(spark, sf):
    cols = list(S.SPARSE_CONTEXTS) + [f"ADHD_x_{c}" for c in S.SPARSE_CONTEXTS] + ["weekend", "ADHD_x_weekend"]
    return finish(A.describe_groups(sparse_features(spark, sf), ["ADHD_numeric"], cols))


def q_a10_within_sd(spark, sf):
    cols = list(S.SPARSE_CONTEXTS) + [f"ADHD_x_{c}" for c in S.SPARSE_CONTEXTS] + ["weekend"]
    return finish(A.within_sd(sparse_features(spark, sf), "ID", cols))


def q_w6_sequential_id(spark, sf):
    d = W.sequential_id(sparse_features(spark, sf), "ID", "person_id")
    return finish(d.select("ID", "person_id").distinct())


def q_d7_build_series(spark, sf):
    d = sparse_series(spark, sf)
    return finish(d.select("ID", "seq", "person_id", "session", "ctsem_id", "ctsem_time",
                           "series_key_collision"))


def q_a13_check_gaps(spark, sf):
    d = W.step_max_by_run(sparse_series(spark, sf), "ID", "t", "seq", "session", "dt")
    return finish(A.check_gaps(d, ["ID", "session"], "dt", 30.0))


def q_d8_var_design(spark, sf):
    d = D.var_design(sparse_series(spark, sf), SPARSE_CFG, order=1, center=True,
                     interact=list(S.SPARSE_CONTEXTS))
    return finish(d.select("ID", "seq", "Y1", "Y2", "Y1_pm", "Y2_pm", "Y1_wc", "Y2_wc",
                           "Y1_lag_wc", "Y2_lag_wc", "Y1_pm_lag", "Y2_pm_lag", "dt", "log_dt",
                           "ADHD_x_Y1_lag", "ADHD_x_Y2_lag", "ADHD_x_log_dt",
                           "ADHD_x_error_0", "ADHD_x_error_1"))


def var2(spark, sf):
    return D.var_design(sparse_series(spark, sf), SPARSE_CFG, order=2, center=False)


def q_d9_var_design_ar2(spark, sf):
    return finish(var2(spark, sf).select("ID", "seq", "Y1", "Y2", "Y1_lag", "Y1_lag2", "Y2_lag",
                                         "Y2_lag2", "dt", "log_dt"))


AR1_X = ["Y1_lag", "Y2_lag", "log_dt"]


def q_m1_panel_moments(spark, sf):
    return finish(M.panel_moments(var2(spark, sf), "ID", AR1_X, ["Y1", "Y2"]))


def q_m2_var_pooled(spark, sf):
    mom = M.panel_moments(var2(spark, sf), "ID", ["Y1_lag", "Y2_lag"], ["Y1", "Y2"])
    return finish(M.pooled_ols_table(mom, ["Y1_lag", "Y2_lag"], ["Y1", "Y2"]))


# --- models on the dense panel, where each person has some 60 rows -----------------
def dense_var(spark, sf):
    """Standardised scores with lags 1 and 2 inside sessions, complete rows (D9 on the dense panel)."""
    d = D.standardize(dense_sessions(spark, sf), {"Y1": "Z1", "Y2": "Z2"})
    d = d.drop("Y1", "Y2").withColumnsRenamed({"Z1": "Y1", "Z2": "Y2"})
    lags = {f"{y}_lag{'' if k == 1 else k}": (y, k) for y in ("Y1", "Y2") for k in (1, 2)}
    d = W.series_lags(d, "ID", "t", "seq", "session", {**lags, "_tp": ("t", 1)})
    d = d.withColumn("dt", (F.col("t") - F.col("_tp")) / F.lit(C.SECONDS_PER_HOUR))
    d = K.require_lags(d, ["Y1", "Y2", *lags], "dt")
    return d.withColumns({"log_dt": F.ln("dt"), "adhd": C.group_flag("ADHD").cast("double"),
                          "weekend": C.weekend_flag_epoch("t").cast("double")})


LAGS1, LAGS2 = ["Y1_lag", "Y2_lag"], ["Y1_lag", "Y1_lag2", "Y2_lag", "Y2_lag2"]
ONE = M.ONE


def ar_shapes():
    from panelflow.models.mixed import shape
    terms = [ONE, *LAGS2, "log_dt"]
    ar1 = shape(terms, ["Y1", "Y2"], {y: [ONE, *LAGS1] for y in ("Y1", "Y2")},
                {y: [ONE, f"{y}_lag", "log_dt"] for y in ("Y1", "Y2")})
    ar2 = shape(terms, ["Y1", "Y2"], {y: [ONE, *LAGS2] for y in ("Y1", "Y2")},
                {y: [ONE, *LAGS2, "log_dt"] for y in ("Y1", "Y2")})
    return {"AR(1)": ar1, "AR(2)": ar2}


def ar_moments(spark, sf):
    return M.gram_moments(dense_var(spark, sf), "ID", [*LAGS2, "log_dt"], ["Y1", "Y2"])


def fitted(spark, moments, s, prior=None):
    from panelflow.models import mixed
    return finish(mixed.result_table(spark, mixed.fit_mixed_var(moments, s.terms, s.ys, s.fixed, s.random, prior=prior)), digits=4)


def q_m3_mixed_var_ar1(spark, sf):
    """Bivariate multilevel VAR(1): correlated random intercepts, own lag and spacing effects."""
    return fitted(spark, ar_moments(spark, sf), ar_shapes()["AR(1)"])


def q_m3_mixed_var_ar2(spark, sf):
    """The same with two lags, all of them random."""
    return fitted(spark, ar_moments(spark, sf), ar_shapes()["AR(2)"])


CONTEXTS = ("click", "view", "purchase")


def full_design(spark, sf):
    """Moments and shape of the full model: group, lags, three contexts, their products with the group, three covariates, spacing."""
    from panelflow.models.mixed import shape
    cust = S.driver_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"), (F.col("c_acctbal") / 10000).alias("cov_balance"),
        (F.col("c_nationkey") / 25).alias("cov_nation"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("cov_segment"))
    kinds = S.driver_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), *[(F.col("event_type") == c).cast("double").alias(c) for c in CONTEXTS])
    covariates = ["cov_balance", "cov_nation", "cov_segment"]
    d = J.attach_person(dense_var(spark, sf), cust, "ID", covariates).join(kinds, "seq")
    d = d.withColumns(C.interactions("adhd", ["Y1_lag", "Y2_lag", "log_dt", *CONTEXTS]))
    x = [*LAGS1, "adhd", "adhd_x_Y1_lag", "adhd_x_Y2_lag", *CONTEXTS, *[f"adhd_x_{c}" for c in CONTEXTS], "weekend",
         *covariates, "log_dt", "adhd_x_log_dt"]
    s = shape([ONE, *x], ["Y1", "Y2"], {y: [ONE, *x] for y in ("Y1", "Y2")},
              {y: [ONE, "Y2_lag", "Y1_lag", "log_dt"] for y in ("Y1", "Y2")})
    return M.gram_moments(d, "ID", x, ["Y1", "Y2"]), s


def q_m3_mixed_var_full(spark, sf):
    """The full fixed part by maximum likelihood."""
    return fitted(spark, *full_design(spark, sf))


def q_m3_mixed_var_map(spark, sf):
    """The full fixed part with priors on the fixed effects and on the random effects' covariance."""
    from panelflow.models import mixed
    mom, s = full_design(spark, sf)
    return fitted(spark, mom, s, prior=mixed.prior(s))


# Literal parameters at which one EM step is compared with SQL.
STEP_BETA, STEP_SIGMA, STEP_PSI = (0.1, 0.2), 0.9, ((0.3, 0.05), (0.05, 0.2))


def q_m3_em_step(spark, sf):
    """Log-likelihood of Y1 ~ 1 + Y1_lag + (1 + Y1_lag | person) at literal parameters, and one EM step from them."""
    import numpy as np

    from panelflow.models import mixed
    s = mixed.shape([ONE, "Y1_lag"], ["Y1"], {"Y1": [ONE, "Y1_lag"]}, {"Y1": [ONE, "Y1_lag"]})
    params = (np.array(STEP_BETA), np.array([[STEP_SIGMA]]), np.array(STEP_PSI))
    total = mixed.person_sums(s, M.panel_moments(dense_var(spark, sf), "ID", ["Y1_lag"], ["Y1"]), [params])[0]
    beta, sigma, psi = mixed.m_step(s, total, params[1], 0.0)
    row = (float(s.split(total)[4][0]), *map(float, beta), float(sigma[0, 0]), float(psi[0, 0]), float(psi[0, 1]), float(psi[1, 1]))
    return finish(spark.createDataFrame([row], "loglik double, b0 double, b1 double, sigma double, psi11 double, psi12 double, psi22 double"))


STEP_MEAN, STEP_PRECISION, STEP_DF, STEP_SCALE = (0.05, 0.3), (4.0, 25.0), 5.0, 0.4


def q_m3_map_step(spark, sf):
    """The same model and parameters with a prior: log-posterior, and one step to the greatest posterior density."""
    import numpy as np

    from panelflow.models import mixed
    s = mixed.shape([ONE, "Y1_lag"], ["Y1"], {"Y1": [ONE, "Y1_lag"]}, {"Y1": [ONE, "Y1_lag"]})
    params = (np.array(STEP_BETA), np.array([[STEP_SIGMA]]), np.array(STEP_PSI))
    known = mixed.Prior(np.array(STEP_MEAN), np.array(STEP_PRECISION), STEP_DF, np.eye(2) * STEP_SCALE)
    total = mixed.person_sums(s, M.gram_moments(dense_var(spark, sf), "ID", ["Y1_lag"], ["Y1"]), [params])[0]
    beta, sigma, psi = mixed.m_step(s, total, params[1], 0.0, known)
    row = (float(s.split(total)[4][0]) + known.log(params[0], params[2]), *map(float, beta), float(sigma[0, 0]),
           float(psi[0, 0]), float(psi[0, 1]), float(psi[1, 1]))
    return finish(spark.createDataFrame([row], "logpost double, b0 double, b1 double, sigma double, psi11 double, psi12 double, psi22 double"))


def q_m4_row_densities(spark, sf):
    """Y1 ~ 1 + Y1_lag + (1 + Y1_lag | person) at literal parameters: each row's log density given its person's other rows."""
    import numpy as np

    from panelflow.models import mixed
    s = mixed.shape([ONE, "Y1_lag"], ["Y1"], {"Y1": [ONE, "Y1_lag"]}, {"Y1": [ONE, "Y1_lag"]})
    fit = {"shape": s, "params": (np.array(STEP_BETA), np.array([[STEP_SIGMA]]), np.array(STEP_PSI))}
    rows = dense_var(spark, sf)
    return finish(mixed.leave_row_out(rows, M.gram_moments(rows, "ID", ["Y1_lag"], ["Y1"]), "ID", "seq", {"log_density": fit}))


def q_m4_compare_rows(spark, sf):
    """Leave-observation-out comparison of both orders on the same rows, best first."""
    from panelflow.models.mixed import compare_rows
    rows = write_through(dense_var(spark, sf).select("ID", "seq", *LAGS2, "log_dt", "Y1", "Y2"))
    return finish(compare_rows(rows, M.gram_moments(rows, "ID", [*LAGS2, "log_dt"], ["Y1", "Y2"]), "ID", "seq", ar_shapes()), digits=3)


def q_m4_compare_orders(spark, sf):
    """Leave-persons-out comparison of both orders on the same rows, best first."""
    from panelflow.models.mixed import compare_models
    return finish(compare_models(ar_moments(spark, sf), "ID", ar_shapes()), digits=3)


def response_rows(spark, sf):
    d = D.response_pattern(sparse_wide(spark, sf), SPARSE_CFG, pattern=r"^(.*)_present$", numeric_item=False)
    d = d.withColumns({"item_no": C.level_order("item", list(S.SPARSE_SCALE_A + S.SPARSE_SCALE_B)).cast("double"),
                       "hours": F.col("RawHours") / 1000.0, "adhd": C.group_flag("ADHD").cast("double")})
    return d.withColumn("hours_x_adhd", F.col("hours") * F.col("adhd"))


RESPONSE_X = ["item_no", "hours", "adhd", "hours_x_adhd"]


def q_m5_response_moments(spark, sf):
    """Moment sums of all rows of the response model."""
    mom = M.panel_moments(response_rows(spark, sf), "ID", RESPONSE_X, ["responded"])
    sums = [c for c in mom.columns if c not in ("ID", "n")]
    return finish(mom.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]), digits=3)


def q_m5_response_mixed(spark, sf):
    """Linear random-slope model of item presence over time by group (M5).

    responded ~ item + hours * group + (1 + hours | person), hours in thousands.
    """
    from panelflow.models.mixed import shape
    mom = M.gram_moments(response_rows(spark, sf), "ID", RESPONSE_X, ["responded"])
    s = shape([ONE, *RESPONSE_X], ["responded"], {"responded": [ONE, *RESPONSE_X]}, {"responded": [ONE, "hours"]})
    return fitted(spark, mom, s)


def q_m6_response_curve(spark, sf):
    """Logistic spline curve of item presence over time, by group, with person-clustered errors (M6)."""
    from panelflow.models.curves import fit_response_curve
    d = response_rows(spark, sf)
    return finish(fit_response_curve(d, "hours", "responded", "adhd", cluster="ID"), digits=3)


# --- item design (M8) ----------------------------------------------------------------
def item_design(spark, sf):
    from panelflow.models import items as I
    items = list(SPARSE_CFG.items)
    per = A.item_stats(sparse_sessions(spark, sf), ["ID", "ADHD"], items, ("var",))
    long = R.unpivot_items(per, ["ID", "ADHD", "n_obs"], [f"var_{c}" for c in items], name="item", value="value")
    long = long.withColumns({"adhd": C.group_flag("ADHD"), "value": F.col("value") / 1000.0})
    levels = [f"var_{c}" for c in items]
    d, terms = I.design(long, "adhd", "n_obs", "item", levels)
    x = [c for cols in terms.values() for c in cols]
    return M.gram_moments(d, "ID", x, ["value"]), terms, levels


def q_m8_design_moments(spark, sf):
    """X'y and the diagonal of X'X of the 32-column three-way design."""
    mom, terms, _ = item_design(spark, sf)
    x = [ONE, *[c for cols in terms.values() for c in cols]]
    at = {name: i for i, name in enumerate(M.as_arrays(mom)[1])}
    total = lambda a, b: F.sum(F.get("g", F.lit(at[M.mname(a, b)])))
    return finish(mom.agg(F.sum("n").alias("n"), *[total(c, c).alias(f"xx_{c}") for c in x],
                          *[total(c, "value").alias(f"xy_{c}") for c in x]), digits=3)


def q_m8_item_terms(spark, sf):
    """Wald test of each term of value ~ (group + n_obs + item)^3 + (1 | person)."""
    from panelflow.models import items as I
    mom, terms, _ = item_design(spark, sf)
    return finish(I.wald_terms(spark, I.fit_items(mom, terms, "value"), terms, "value"), digits=3)


def q_m8_item_grid(spark, sf):
    """Marginal means by group and item at the mean number of rows."""
    from panelflow.models import items as I
    mom, terms, levels = item_design(spark, sf)
    mom = write_through(mom)
    total = M.total_moments(mom)
    at = total[M.mname(ONE, "d_n_obs")] / total["n"]
    fit = I.fit_items(mom, terms, "value")
    return finish(I.prediction_grid(spark, fit, terms, "value", "adhd", "n_obs", "item", levels, at), digits=3)


# --- other configurations -----------------------------------------------------------
COMPLETE_CFG = D.PanelConfig(scales={"anti": ["click_0", "view_0"], "pro": ["purchase_0"]},
                             context_cols=list(S.SPARSE_CONTEXTS), row_rule="all")
MIN_OBS = 25


def q_d13_complete(spark, sf):
    """Occasions of complete rows only, numbered after the others are dropped."""
    return finish(D.reliability_long(D.sessionize_panel(sparse_wide(spark, sf), COMPLETE_CFG), COMPLETE_CFG))


def q_d11_mean_bands(spark, sf):
    return finish(D.item_group_tables(sparse_sessions(spark, sf), SPARSE_CFG, "mean"))


def q_d11_points(spark, sf):
    """Person x item points behind the bands, for variance and mean."""
    ema = sparse_sessions(spark, sf)
    both = R.union_all([D.item_point_table(ema, SPARSE_CFG, stat) for stat in ("var", "mean")])
    # values of few decimals stand on halves; a nudge keeps the rounding from following the last bit
    return finish(both.select("ID", "variable", (F.col("value") + 1e-9).alias("value"), "group_label", "item_order", "item_label", "subscale"))


def q_counts_observed(spark, sf):
    """Counts of what each step made null, filled or dropped, taken in the passes themselves."""
    from pyspark.sql import Observation

    from panelflow.operators.observed import taken
    bad, filled, dropped, repeats = (Observation(n) for n in ("bad", "filled", "dropped", "repeats"))
    d = C.to_numeric(raw_panel(spark, sf), list(S.SPARSE_LABELS), counts=bad)
    d = C.binarize_columns(d, list(S.SPARSE_CONTEXTS), counts=filled)
    discard(write_through(K.complete_cases(d, ["click_0", "view_0", "purchase_0"], counts=dropped)))
    z = S.events_long(spark, sf).select("ID", (F.floor(F.col("t") / 43200) * 43200).cast("double").alias("t"), "seq",
                                        (F.floor(F.col("Y1") / 100) * 100).cast("double").alias("Y1"))
    z = W.sessionize(z, "ID", "t", "seq", 30.0)
    discard(write_through(W.drop_zero_dt_duplicates(z, "ID", "t", "seq", "session", ["Y1"], counts=repeats)))
    rows = [(step, name, n) for step, c in (("numbers", bad), ("filled", filled), ("complete", dropped), ("repeats", repeats))
            for name, n in taken(c).items()]
    return finish(spark.createDataFrame(rows, "step string, name string, n long"))


def q_s5_person_table(spark, sf):
    """Sessions of a panel saved bucketed by person and read back without a shuffle."""
    name = f"panelflow_{uuid.uuid4().hex}"
    table = S.write_person_table(dense(spark, sf), name, "ID", ["t", "seq"], buckets=8)
    out = write_through(W.sessionize(table, "ID", "t", "seq", 30.0, obs="obs"))
    S.drop_person_table(spark, name)
    return finish(out.select("ID", "seq", "obs", "session", "new_session", "gap_hours", "RawHours", "TimeHours", "time_interval"))


def shared_folder(spark, what):
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def q_s_formats(spark, sf):
    """Raw responses written as csv, json and parquet, partitioned by label, and read with the declared schema."""
    raw = S.raw_responses(spark, sf)
    out = []
    for fmt in ("csv", "json", "parquet"):
        path = shared_folder(spark, fmt)
        S.write_table(raw.withColumn("label", F.col("prompt_label")), path, fmt, partition_by=["label"],
                      **({"header": True} if fmt == "csv" else {}))
        back = S.read_responses(spark, path, fmt)
        out.append(back.groupBy(F.lit(fmt).alias("fmt"), "prompt_label").agg(
            F.count("*").alias("n_rows"), F.count("response").alias("n_answers"), F.sum("seq").alias("seq_sum"),
            F.count("session_instance_no").alias("n_session"), F.max("notification_time").alias("last_time")))
    return finish(R.union_all(out))


def q_str_sessions(spark, sf):
    """Sessions that a file stream of the events has closed when all files are read (Str)."""
    from panelflow.streaming.sessions import start_sessions_query
    events = S.driver_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, sink, state = (shared_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    S.write_table(events, source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    start_sessions_query(stream, "user_id", "ts", 30.0, sink="parquet", path=sink, checkpoint=state, available_now=True).awaitTermination()
    schema = "user_id long, session_window struct<start: timestamp, end: timestamp>, n_obs long, start timestamp, end timestamp"
    out = spark.read.schema(schema).parquet(sink)
    return finish(out.select("user_id", "n_obs", (F.unix_micros("start") / 1e6).alias("first_t"), (F.unix_micros("end") / 1e6).alias("last_t")))


def q_d11_complete_bands(spark, sf):
    return finish(D.item_group_tables(D.sessionize_panel(sparse_wide(spark, sf), COMPLETE_CFG), COMPLETE_CFG, "var"))


def q_k6_min_obs(spark, sf):
    d = W.min_group_size(sparse_sessions(spark, sf), "ID", MIN_OBS, "n_obs")
    return finish(d.select("ID", "seq", "n_obs"))


def raw_cfg():
    return SPARSE_CFG


def raw_panel(spark, sf):
    return D.prepare_raw_panel(S.raw_responses(spark, sf), raw_cfg(), list(S.SPARSE_LABELS), on_duplicate="last")


def q_d1_raw_panel(spark, sf):
    """Raw text responses -> wide panel: sentinel, unparsable times, missing session numbers."""
    return finish(raw_panel(spark, sf))


def q_d1_parse_report(spark, sf):
    return finish(D.parse_report(D.read_raw(S.raw_responses(spark, sf), raw_cfg())))


def q_d10_raw_pattern(spark, sf):
    """Item presence from raw responses: a skipped answer isn't one; the item is its number."""
    names = {v: f"item{i + 1}" for i, v in enumerate(S.SPARSE_SCALE_A + S.SPARSE_SCALE_B)}
    wide = D.prepare_raw_panel(S.raw_responses(spark, sf), raw_cfg(), names, on_duplicate="last")
    return finish(D.response_pattern(wide, raw_cfg(), list(names.values()), pattern=r"item(\d+)_present"))


def q_k9_zero_repeats(spark, sf):
    """Exact repeats at the same time, with times floored to 12 hours and values to hundreds so that there are some."""
    d = S.events_long(spark, sf).select("ID", (F.floor(F.col("t") / 43200) * 43200).cast("double").alias("t"), "seq",
                                        (F.floor(F.col("Y1") / 100) * 100).cast("double").alias("Y1"))
    d = W.sessionize(d, "ID", "t", "seq", 30.0)
    return finish(W.drop_zero_dt_duplicates(d, "ID", "t", "seq", "session", ["Y1"]).select("ID", "seq", "session", "Y1"))


def q_o2_context_order(spark, sf):
    return finish(A.freq_table(sparse_features(spark, sf), list(S.SPARSE_CONTEXTS), ordered=True))


def q_s_names(spark, sf):
    """Repaired, renamed and added column names."""
    d = S.driver_table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation key"), F.col("n_name").alias("2nd name"), F.col("n_regionkey").alias("if"))
    d = S.rename_regex(S.make_names(d), r"\.", "_")
    d = S.rename_columns(S.rename_positional(d, ["key"]), {"if_": "region", "absent": "x"})
    d = S.ensure_columns(S.drop_if_present(d, "absent"), {"region": -1, "flag": 0})
    return finish(d)


def q_j_null_safe(spark, sf):
    """J2 null-safe: rows whose key is missing meet the table's row without a key."""
    d = dense(spark, sf).select(F.when(F.col("ID") % 10 != 0, F.col("ID") % 10).alias("key"))
    names = S.driver_table(spark, sf, "nation").where("n_nationkey < 10").select(
        F.when(F.col("n_nationkey") > 0, F.col("n_nationkey").cast("bigint")).alias("key"), "n_name")
    return finish(A.count_by(J.attach(d, names, "key", null_safe=True), ["key", "n_name"], "n"))


def q_m2_var_full(spark, sf):
    """Pooled VAR(2) with person-clustered errors."""
    mom = M.panel_moments(var2(spark, sf), "ID", LAGS2, ["Y1", "Y2"])
    return finish(M.pooled_ols_table(mom, LAGS2, ["Y1", "Y2"], with_se=True))


def q_m2_var1_se(spark, sf):
    """Pooled VAR(1) of one outcome with its person-clustered errors and residual variance."""
    mom = M.panel_moments(dense_var(spark, sf), "ID", ["Y1_lag"], ["Y1"])
    return finish(M.pooled_ols_table(mom, ["Y1_lag"], ["Y1"], with_se=True))


def q_m7_components(spark, sf):
    """Variance components and occasion reliability of all items and of each scale."""
    from panelflow.models import varcomp
    long = D.reliability_long(sparse_sessions(spark, sf), SPARSE_CFG)
    return finish(varcomp.reliability_table(long, "value", ["ID", "occasion", "item"], "occasion", "item", {
        "all": SPARSE_CFG.items, **SPARSE_CFG.scales}), digits=2)


def q_d10_response_pattern(spark, sf):
    d = D.response_pattern(sparse_wide(spark, sf), SPARSE_CFG, pattern=r"^(.*)_present$",
                           numeric_item=False)
    return finish(d)


def q_d11_item_variance_bands(spark, sf):
    return finish(D.item_group_tables(sparse_sessions(spark, sf), SPARSE_CFG, "var"))


def q_a11_person_summary(spark, sf):
    d = A.person_summary(sparse_series(spark, sf), "ID", "t", "seq")
    return finish(d)


def centred(spark, sf):
    return D.centred_series(sparse_features(spark, sf), SPARSE_CFG)


def q_d12_distribution_hist(spark, sf):
    return finish(A.histogram(D.centred_long(centred(spark, sf), SPARSE_CFG), "Value", 30, ["Centering", "Variable"]))


def q_d12_trajectories(spark, sf):
    return finish(D.trajectories(centred(spark, sf), SPARSE_CFG))


def q_m9_trajectory_smooth(spark, sf):
    """Local smooth with band of the scores over the session clock, by centring, score and group."""
    d = D.trajectory_smooth(centred(spark, sf), SPARSE_CFG)
    return finish(d, digits=4)


def q_a16_interval_hist(spark, sf):
    d = W.step_max_by_run(sparse_series(spark, sf), "ID", "t", "seq", "session", "dt")
    return finish(A.histogram(d, "dt", 50))


def q_a16_null_panel(spark, sf):
    """Histogram by a panel that a third of the rows lack."""
    d = dense(spark, sf).select(F.when(F.col("seq") % 3 != 0, F.col("ADHD")).alias("panel"), "Y1")
    return finish(A.histogram(d, "Y1", 20, ["panel"]))


def q_d13_reliability_long(spark, sf):
    return finish(D.reliability_long(sparse_sessions(spark, sf), SPARSE_CFG))


def q_m7_vc_forms(spark, sf):
    from panelflow.models import varcomp
    long = D.reliability_long(sparse_sessions(spark, sf), SPARSE_CFG)
    return finish(varcomp.quadratic_forms(long, "value", ["ID", "occasion", "item"]), digits=2)


def q_a5_pooled_stats(spark, sf):
    return finish(A.pooled_stats(lineitem(spark, sf), ["l_suppkey"], LINE_SCALES))


def q_a6_item_stats(spark, sf):
    return finish(A.item_stats(lineitem(spark, sf), ["l_suppkey"], LINE_COLS))


def q_a7_item_variability(spark, sf):
    d = A.item_variability(lineitem(spark, sf), ["l_suppkey"], LINE_COLS, LINE_SCALES)
    return finish(d.select("l_suppkey", "n_obs", "var_overall", "sd_overall", "mean_overall",
                           "n_zero_var", "n_low_var", "n_zero_sd", "n_low_sd",
                           "any_zero_var", "multiple_low_var", "overall_low_var"))


def q_a15_correlations(spark, sf):
    return finish(A.correlation_matrix(lineitem(spark, sf), LINE_COLS))


def q_a12_mean_ci(spark, sf):
    d = A.item_stats(lineitem(spark, sf), ["l_suppkey"], LINE_COLS, ("mean",))
    sup = S.driver_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    long = R.unpivot_items(d.join(sup, "l_suppkey"), ["l_suppkey", "s_nationkey"],
                           [f"mean_{c}" for c in LINE_COLS], name="variable", value="value")
    return finish(A.mean_ci(long, ["s_nationkey", "variable"], "value"))


def q_p_clean_times(spark, sf):
    """P1, P6, P7-P10 on text: a sentinel, numbers and times parsed from text."""
    ev = S.driver_table(spark, sf, "events")
    txt = ev.select(
        F.col("event_id").alias("seq"),
        C.null_if(F.when(F.col("event_type") == "error", F.lit(C.SKIPPED_SENTINEL))
                  .otherwise(F.get_json_object("props", "$.k")), C.SKIPPED_SENTINEL).alias("resp"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when_text"))
    d = txt.select("seq", C.to_number("resp").alias("resp_num"),
                   C.epoch_seconds_text("when_text").alias("t"))
    d = d.withColumns({"weekday": C.weekday_from_epoch("t"), "weekend": C.weekend_flag_epoch("t"),
                       "day_of_week": C.weekday_label_epoch("t")})
    return finish(d)


def q_k_filters(spark, sf):
    """Require, exclusion list, any/all rule, membership."""
    w = sparse_wide(spark, sf)
    d = K.require(w, ["t"])
    d = K.exclude_ids(d, "ID", [1, 2, 3])
    a = K.keep_any(d, list(S.SPARSE_SCALE_A)).agg(F.count(F.lit(1)).alias("n_any"))
    b = K.complete_cases(d, ["click_0", "view_0"]).agg(F.count(F.lit(1)).alias("n_all"))
    c = K.where_in(d, "day_of_week", ["Sat", "Sun"]).agg(F.count(F.lit(1)).alias("n_weekend"))
    return finish(a.crossJoin(b).crossJoin(c))


def q_j_joins(spark, sf):
    """Natural join, inner join, left join with fill, semi join."""
    cust = S.driver_table(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), "c_nationkey", "c_acctbal")
    nat = S.driver_table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    reg = S.driver_table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    users = A.count_by(dense(spark, sf), ["ID"], "n_events")
    cov = J.attach(J.natural_join(cust, nat), reg, "n_regionkey")
    m = J.attach_person(users, cov, "ID", ["c_acctbal", "r_name"], {"r_name": "none"})
    m = J.keep_members(m, cust, "ID")
    return finish(m)


def q_u_union_distinct(spark, sf):
    """Union by name with a missing column, then distinct rows."""
    d = dense(spark, sf)
    a = d.select("ID", F.lit("Y1").alias("variable"), F.col("Y1").alias("value"))
    b = d.select("ID", F.lit("Y2").alias("variable"), F.col("Y2").alias("value"), F.col("ADHD"))
    u = R.union_all([a, b])
    return finish(R.distinct_rows(u.select("ID", "variable", "ADHD")))


def q_p_row_ops(spark, sf):
    """Presence, row means/counts, group flag, binarise, products, recode."""
    w = sparse_wide(spark, sf)
    d = w.withColumns({**C.presence_flags(S.SPARSE_SCALE_A),
                       "anti_mean": C.row_mean(list(S.SPARSE_SCALE_A)),
                       "n_high": C.row_count_where(list(S.SPARSE_SCALE_A), lambda c: c > 50),
                       "g": C.group_flag("ADHD"),
                       "err": C.binarize("error_0"),
                       "day_no": C.level_order("day_of_week", C.DAY_LABELS),
                       "log_click": C.log_col("click_0")})
    d = d.withColumns(C.interactions("g", ["err", "weekend"]))
    return finish(d.select("ID", "seq", *[f"{c}_present" for c in S.SPARSE_SCALE_A], "anti_mean",
                           "n_high", "g", "err", "g_x_err", "g_x_weekend", "day_no", "log_click"))


def q_a4_quality_report(spark, sf):
    d = sparse_sessions(spark, sf)
    return finish(A.quality_report(d, {"n_large_gap": F.col("gap_hours") > 30,
                                       "n_no_click": F.col("click_0").isNull(),
                                       "n_weekend": F.col("weekend") == 1}, key="ID"))


def q_k7_min_run_size(spark, sf):
    d = W.run_sizes(sparse_sessions(spark, sf), "ID", "t", "seq", "session", "series_n")
    return finish(d.select("ID", "seq", "session", "series_n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "w4_sessionize": q_w4_sessionize,
    "a1_session_sizes": q_a1_session_sizes,
    "a3_gap_summary": q_a3_gap_summary,
    "a2_distinct_counts": q_a2_distinct_counts,
    "w2_w3_elapsed_step": q_w2_w3_elapsed_step,
    "r1_pivot_prompts": q_r1_pivot_prompts,
    "r1_duplicate_cells": q_r1_duplicate_cells,
    "d2_sessionize_panel": q_d2_sessionize_panel,
    "d3_person_table": q_d3_person_table,
    "a14_describe_persons": q_a14_describe_persons,
    "k8_variance_flags": q_k8_variance_flags,
    "d5_score_scales": q_d5_score_scales,
    "a8_context_freq": q_a8_context_freq,
    "a9_describe_groups": q_a9_describe_groups,
    "a10_within_sd": q_a10_within_sd,
    "w6_sequential_id": q_w6_sequential_id,
    "d7_build_series": q_d7_build_series,
    "k7_run_sizes": q_k7_min_run_size,
    "a13_check_gaps": q_a13_check_gaps,
    "d8_var_design": q_d8_var_design,
    "d9_var_design_ar2": q_d9_var_design_ar2,
    "m1_panel_moments": q_m1_panel_moments,
    "m2_var_pooled": q_m2_var_pooled,
    "m3_mixed_var_ar1": q_m3_mixed_var_ar1,
    "m5_response_mixed": q_m5_response_mixed,
    "d10_response_pattern": q_d10_response_pattern,
    "d11_item_variance_bands": q_d11_item_variance_bands,
    "a11_person_summary": q_a11_person_summary,
    "d12_distribution_hist": q_d12_distribution_hist,
    "m9_trajectory_smooth": q_m9_trajectory_smooth,
    "a16_interval_hist": q_a16_interval_hist,
    "a16_null_panel": q_a16_null_panel,
    "d13_reliability_long": q_d13_reliability_long,
    "m7_vc_quadratic_forms": q_m7_vc_forms,
    "a5_pooled_stats": q_a5_pooled_stats,
    "a6_item_stats": q_a6_item_stats,
    "a7_item_variability": q_a7_item_variability,
    "a15_correlations": q_a15_correlations,
    "a12_mean_ci": q_a12_mean_ci,
    "p_clean_times": q_p_clean_times,
    "p_row_ops": q_p_row_ops,
    "k_filters": q_k_filters,
    "j_joins": q_j_joins,
    "u_union_distinct": q_u_union_distinct,
    "a4_quality_report": q_a4_quality_report,
    "d1_raw_panel": q_d1_raw_panel,
    "d1_parse_report": q_d1_parse_report,
    "d10_raw_pattern": q_d10_raw_pattern,
    "d11_mean_bands": q_d11_mean_bands,
    "d11_complete_bands": q_d11_complete_bands,
    "d11_points": q_d11_points,
    "counts_observed": q_counts_observed,
    "s5_person_table": q_s5_person_table,
    "s_formats": q_s_formats,
    "str_sessions": q_str_sessions,
    "d12_trajectories": q_d12_trajectories,
    "d13_complete": q_d13_complete,
    "k6_min_obs": q_k6_min_obs,
    "k9_zero_repeats": q_k9_zero_repeats,
    "o2_context_order": q_o2_context_order,
    "s_names": q_s_names,
    "j_null_safe": q_j_null_safe,
    "m2_var_full": q_m2_var_full,
    "m2_var1_se": q_m2_var1_se,
    "m3_em_step": q_m3_em_step,
    "m3_mixed_var_ar2": q_m3_mixed_var_ar2,
    "m3_mixed_var_full": q_m3_mixed_var_full,
    "m3_mixed_var_map": q_m3_mixed_var_map,
    "m3_map_step": q_m3_map_step,
    "m4_row_densities": q_m4_row_densities,
    "m4_compare_rows": q_m4_compare_rows,
    "m4_compare_orders": q_m4_compare_orders,
    "m5_response_moments": q_m5_response_moments,
    "m6_response_curve": q_m6_response_curve,
    "m7_components": q_m7_components,
    "m8_design_moments": q_m8_design_moments,
    "m8_item_terms": q_m8_item_terms,
    "m8_item_grid": q_m8_item_grid,
}
