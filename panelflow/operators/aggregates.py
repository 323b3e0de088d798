"""Aggregations.

Everything is a ``groupBy().agg()`` of built-in aggregates (partial on the
map side, so a hot group costs one partial buffer per task, not a gather)
or a join of small results.  Global results are one-row DataFrames; a
one-row table is cross-joined with ``broadcast`` (size 1 is proven).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.columns import round_half_even
from panelflow.operators.gram import pairwise_correlations
from panelflow.operators.ranks import (
    kept_between,
    median_of_ranks,
    null_safe,
    numbered,
    ranked,
    running_counts,
    value_counts,
    weighted_mean,
)
from panelflow.session import write_through

# Fixed values of the descriptive table and the interval band.
MAD_CONSTANT = 1.4826       # scale of the median absolute deviation
TRIM = 0.1                  # share dropped at each end for the trimmed mean
Z95 = 1.96                  # normal quantile of the 95% band
SQL_PAIRS = 50              # correlations of one aggregate up to which Spark compiles it as one piece


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per group (A1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_count(c: str | Sequence[str], approx: bool = False, rsd: float = 0.01) -> Column:
    """Exact (or HyperLogLog++ approximate) distinct count (A2)."""
    cols = [c] if isinstance(c, str) else list(c)
    if approx:
        x = F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)
        return F.approx_count_distinct(x, rsd)
    return F.count_distinct(*[F.col(x) for x in cols])


def gap_summary(df: DataFrame, gap: str = "gap_hours", limit: float = 30.0) -> DataFrame:
    """Mean, median, max and count above ``limit`` of the gaps (A3); the median is exact."""
    large = F.when(F.col("x") > F.lit(limit), F.col("count"))
    return ranked(df, gap).agg(weighted_mean(F.col("x")).alias("mean_gap"), median_of_ranks().alias("median_gap"),
                               F.max("x").alias("max_gap"), F.coalesce(F.sum(large), F.lit(0)).alias("n_large"))


def quality_report(df: DataFrame, checks: Mapping[str, Column],
                   key: str | None = None) -> DataFrame:
    """One row of named counts (A4): ``checks[name]`` is a boolean column.

    With ``key``: also the number of persons and the largest person
    (rows), which tells whether ordered scans will split a hot person.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    out = df.agg(*aggs)
    if key:
        per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        top = per.agg(F.count(F.lit(1)).alias("n_persons"), F.max("_n").alias("max_rows_per_person"))
        out = out.crossJoin(F.broadcast(top))
    return out


def pooled_stats(df: DataFrame, keys: Sequence[str], scales: Mapping[str, Sequence[str]],
                 stats: Sequence[str] = ("var", "sd", "mean")) -> DataFrame:
    """Statistics of all values of several columns pooled per group (A5).

    One aggregate gives each column's count, mean and squared deviations;
    a scale's pooled moments follow from those of its columns.
    """
    cols = sorted({c for cs in scales.values() for c in cs})
    d = df.groupBy(*keys).agg(*_moments(cols))
    return d.select(*keys, *[_pooled(cs)[st].alias(f"{st}_{s}") for s, cs in scales.items() for st in stats])


def _moments(cols: Sequence[str]) -> list[Column]:
    out = []
    for c in cols:
        x = F.col(c).cast("double")
        out += [F.count(x).alias(f"_n_{c}"), F.avg(x).alias(f"_a_{c}"), F.var_samp(x).alias(f"_v_{c}")]
    return out


def _pooled(cols: Sequence[str]) -> dict[str, Column]:
    """Pooled n, mean, var and sd from the columns of ``_moments``."""
    total = lambda f: sum((F.coalesce(f(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(f"_n_{c}") for c in cols), F.lit(0))
    mean = F.try_divide(total(lambda c: F.col(f"_n_{c}") * F.col(f"_a_{c}")), n.cast("double"))
    dev = sum((F.coalesce(F.col(f"_v_{c}") * (F.col(f"_n_{c}") - 1), F.lit(0.0))
               + F.coalesce(F.col(f"_n_{c}") * (F.col(f"_a_{c}") - mean) ** 2, F.lit(0.0)) for c in cols), F.lit(0.0))
    var = F.when(n >= 2, dev / (n - 1).cast("double"))
    return {"n": n, "mean": mean, "var": var, "sd": F.sqrt(var)}


def item_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
               stats: Sequence[str] = ("var", "sd", "mean")) -> DataFrame:
    """Per-group mean/var/sd of each column."""
    fn = {"var": F.var_samp, "sd": F.stddev_samp, "mean": F.avg}
    aggs = [F.count(F.lit(1)).alias("n_obs")]
    aggs += [fn[s](F.col(c)).alias(f"{s}_{c}") for s in stats for c in cols]
    return df.groupBy(*keys).agg(*aggs)


def item_variability(df: DataFrame, keys: Sequence[str], items: Sequence[str],
                     scales: Mapping[str, Sequence[str]], *, low_var: float = 0.1,
                     low_sd: float = 0.3, many_low: int = 3, overall_low_sd: float = 0.5,
                     group: str | None = None, positive=1,
                     labels: tuple[str, str] = ("ADHD", "Control")) -> DataFrame:
    """Item statistics + pooled statistics + row counts + flags (A7), from one aggregate.

    ``labels``: of the positive group and of the others.
    """
    fn = {"var": F.var_samp, "sd": F.stddev_samp, "mean": F.avg}
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), *_moments(items),
                                *[fn[s](F.col(c)).alias(f"{s}_{c}") for s in fn for c in items])
    pooled = {"overall": items, **scales}
    out = out.withColumns({f"{st}_{s}": _pooled(cs)[st] for s, cs in pooled.items() for st in fn})
    out = out.drop(*[f"_{k}_{c}" for k in "nav" for c in items])
    vars_ = [f"var_{c}" for c in items]
    sds = [f"sd_{c}" for c in items]

    def cnt(cs, pred):
        return sum((F.coalesce(pred(F.col(c)), F.lit(False)).cast("int") for c in cs), F.lit(0))

    out = out.withColumns({
        "n_zero_var": cnt(vars_, lambda c: (c == 0) | c.isNull()),
        "n_low_var": cnt(vars_, lambda c: c < F.lit(low_var)),
        "n_zero_sd": cnt(sds, lambda c: (c == 0) | c.isNull()),
        "n_low_sd": cnt(sds, lambda c: c < F.lit(low_sd)),
    })
    out = out.withColumns({
        "any_zero_var": F.col("n_zero_var") > 0,
        "multiple_low_var": F.col("n_low_var") >= F.lit(many_low),
        "overall_low_var": F.col("sd_overall") < F.lit(overall_low_sd),
    })
    if group:
        out = out.withColumn("group_label", F.when(F.col(group) == F.lit(positive), F.lit(labels[0]))
                             .otherwise(F.lit(labels[1])))
    return out


def freq_table(df: DataFrame, cols: Sequence[str], digits: int = 1, ordered: bool = False) -> DataFrame:
    """Counts of each combination with percent of all rows, half-even.

    ``ordered``: most frequent first, ties by value, with its place as ``rank`` (O2).
    """
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = (counts.crossJoin(F.broadcast(total))
           .withColumn("pct", round_half_even(F.lit(100.0) * F.col("n") / F.col("_total"), digits))
           .drop("_total"))
    if not ordered:
        return out
    first = [F.desc("n"), *[F.asc(c) for c in cols]]   # one row per combination
    return numbered(out, first).orderBy("rank")


def describe_groups(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                    digits: int = 1) -> DataFrame:
    """Group size and percent (100 * mean) of 0/1 columns, half-even."""
    aggs = [F.count(F.lit(1)).alias("n_obs")]
    aggs += [round_half_even(F.lit(100.0) * F.avg(F.col(c).cast("double")), digits).alias(f"pct_{c}")
             for c in cols]
    return df.groupBy(*by).agg(*aggs)


def within_sd(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per-person sample SD of each column (A10)."""
    return df.groupBy(key).agg(*[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}_sd") for c in cols])


def person_summary(df: DataFrame, key: str, time: str, seq: str, *, session: str = "session",
                   elapsed: str = "RawHours", group: str = "ADHD_numeric",
                   scores: Mapping[str, str] | None = None, positive=1,
                   labels: tuple[str, str] = ("ADHD", "Control")) -> DataFrame:
    """One row per person: rows, sessions, span, first group value, score
    means/SDs/ranges (A11)."""
    scores = dict(scores or {"anti": "Y1", "pro": "Y2"})
    order = F.struct(F.col(time).isNull(), F.col(time), F.col(seq))
    aggs = [F.count(F.lit(1)).alias("n_obs"),
            F.count_distinct(session).alias("n_sessions"),
            (F.max(elapsed) - F.min(elapsed)).alias("total_hours"),
            F.min_by(F.col(group), order).alias(group)]
    for name, c in scores.items():
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd"),
                 (F.max(c) - F.min(c)).alias(f"{name}_range")]
    out = df.groupBy(key).agg(*aggs)
    return out.withColumn("Group", F.when(F.col(group) == F.lit(positive), F.lit(labels[0]))
                          .otherwise(F.lit(labels[1])))


def mean_ci(df: DataFrame, by: Sequence[str], value: str, z: float = Z95,
            n_valid: bool = False) -> DataFrame:
    """Mean, standard error and normal band per group.

    The standard error divides by the number of rows (``count(*)``), as the
    reference does; ``n_valid=True`` divides by the present values only.
    """
    n = F.count(value) if n_valid else F.count(F.lit(1))
    d = df.groupBy(*by).agg(F.avg(value).alias("mean_val"),
                            (F.stddev_samp(value) / F.sqrt(n.cast("double"))).alias("se_val"))
    return d.withColumns({"lo": F.col("mean_val") - F.lit(z) * F.col("se_val"),
                          "hi": F.col("mean_val") + F.lit(z) * F.col("se_val")})


def check_gaps(df: DataFrame, keys: Sequence[str], dt: str = "dt", limit: float = 30.0,
               violations_only: bool = False) -> DataFrame:
    """Largest step of each series; optionally only those over ``limit``."""
    out = df.where(F.col(dt).isNotNull()).groupBy(*keys).agg(F.max(dt).alias("max_dt"))
    return out.where(F.col("max_dt") > F.lit(limit)) if violations_only else out


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Descriptive table, one row per column.

    n, mean, sd, median, trimmed mean (``floor(TRIM * n)`` values dropped at
    each end), mad (scaled median absolute deviation), min, max, range,
    skew and kurtosis (sample-size corrected type-3 forms:
    ``g1 * ((n-1)/n)^1.5`` and ``(g2+3) * (1-1/n)^2 - 3``), se.

    Everything is computed from distinct values and their counts, so equal
    values never meet in one task.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "vars", "x").where(F.col("x").isNotNull())
    r = write_through(ranked(long, "x", ["vars"]))
    x = F.col("x")
    first = r.groupBy("vars").agg(
        F.first("n").alias("n"), weighted_mean(x).alias("mean"), median_of_ranks().alias("median"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    d = r.join(first.select("vars", "mean", "median"), on="vars")
    k = F.floor(F.col("n") * F.lit(TRIM))
    kept, away = kept_between(k + 1, F.col("n") - k), x - F.col("mean")
    second = d.groupBy("vars").agg(
        F.try_divide(F.sum(x * kept), F.sum(kept).cast("double")).alias("trimmed"),
        *[weighted_mean(F.pow(away, F.lit(float(j)))).alias(f"_m{j}") for j in (2, 3, 4)])
    far = value_counts(d.withColumn("_away", F.abs(x - F.col("median"))), "_away", ["vars"], F.col("count"))
    second = second.join(running_counts(far, ["vars"]).groupBy("vars").agg(median_of_ranks().alias("_mad")), "vars")
    out = first.join(second, on="vars")
    n = F.col("n").cast("double")
    out = out.withColumn("sd", F.sqrt(F.try_divide(F.col("_m2") * n, n - 1)))
    g1 = F.try_divide(F.col("_m3"), F.pow(F.col("_m2"), 1.5))
    g2 = F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")) - F.lit(3.0)
    return out.select(
        "vars", F.col("n").cast("long").alias("n"), "mean", "sd", "median", "trimmed",
        (F.lit(MAD_CONSTANT) * F.col("_mad")).alias("mad"),
        "min", "max", (F.col("max") - F.col("min")).alias("range"),
        (g1 * F.pow((n - 1) / n, 1.5)).alias("skew"),
        ((g2 + F.lit(3.0)) * F.pow(F.lit(1.0) - F.lit(1.0) / n, 2) - F.lit(3.0)).alias("kurtosis"),
        (F.col("sd") / F.sqrt(n)).alias("se"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form.

    A few columns are SQL aggregates; from ``SQL_PAIRS`` pairs on batches of
    rows are multiplied as matrices.
    """
    if len(cols) * (len(cols) - 1) // 2 > SQL_PAIRS:
        return pairwise_correlations(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs],
                 *[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n:{a}|{b}")
                   for a, b in pairs])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                         F.col(f"`{a}|{b}`").alias("r"),
                                         F.col(f"`n:{a}|{b}`").alias("n")) for a, b in pairs]))
    return row.select(stack.alias("_p")).select("_p.*")


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram per panel, empty bins as 0.

    Width = range / (bins - 1); the first bin is centred on the minimum and
    bins are closed on the right.  Each panel uses its own range; rows whose
    panel is null are a panel.
    """
    by = list(by)
    v = F.col(value)
    d = df.where(v.isNotNull())
    rng = d.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rng = rng.withColumn("_w", F.when(F.col("_hi") > F.col("_lo"),
                                      (F.col("_hi") - F.col("_lo")) / F.lit(bins - 1))
                         .otherwise(F.lit(0.1)))
    rng = write_through(rng)     # one row per panel; Spark broadcasts it where it is small
    j = null_safe(d, rng, by) if by else d.crossJoin(F.broadcast(rng))
    start = F.col("_lo") - F.col("_w") / 2
    b = F.greatest(F.lit(1), F.ceil((v - start) / F.col("_w"))).cast("int")
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*by, "_lo", "_w", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = null_safe(grid, counts, [*by, "bin"], "left")
    return out.select(*by, "bin",
                      (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("x"),
                      (F.col("_lo") + (F.col("bin") - F.lit(1.5)) * F.col("_w")).alias("xmin"),
                      (F.col("_lo") + (F.col("bin") - F.lit(0.5)) * F.col("_w")).alias("xmax"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
