"""Column-level helpers (projections and scalar functions).

Every helper returns a ``Column`` or a DataFrame built only from built-in
expressions, so it stays inside whole-stage codegen.  Null rules follow
the analysis scripts: a sentinel string is a missing value, bad casts and
bad times become NULL (never an error), NaN never enters a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.operators.observed import observed

# Fixed values the results depend on.
SKIPPED_SENTINEL = "#skipped#"          # response text that means "no answer"
WEEKEND_DAYS = (1, 7)                   # dayofweek numbers of Sunday and Saturday
DEFAULT_TIME_FORMATS = (                # year-month-day hour:minute:second inputs
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)
SECONDS_PER_HOUR = 3600.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1 ------------------------------------------------------------------
def null_if(c: str | Column, sentinel: str = SKIPPED_SENTINEL) -> Column:
    """Sentinel value -> NULL."""
    return F.nullif(col(c), F.lit(sentinel))


# --- P6 ------------------------------------------------------------------
def to_number(c: str | Column, dtype: str = "double") -> Column:
    """Text -> number; unparsable text becomes NULL instead of failing."""
    return col(c).try_cast(dtype)


def cast_failed(c: str | Column, dtype: str = "double") -> Column:
    """1 when a present value does not parse as ``dtype`` (the P6 failure count)."""
    return (col(c).isNotNull() & col(c).try_cast(dtype).isNull()).cast("int")


def to_numeric(df: DataFrame, cols: Iterable[str], dtype: str = "double",
               counts: Observation | None = None) -> DataFrame:
    """Cast many columns with ``try_cast``.

    ``counts`` gets ``n_rows`` and ``bad_<column>``, present values that are
    no numbers, in the pass that casts (see ``operators.observed``).
    """
    cols = list(cols)
    if counts is not None:
        df = observed(df, counts, {f"bad_{c}": cast_failed(c, dtype) == 1 for c in cols})
    return df.withColumns({c: col(c).try_cast(dtype) for c in cols})


# --- P7-P11: times ----------------------------------------------------------
def parse_time(c: str | Column, formats: Sequence[str] = DEFAULT_TIME_FORMATS) -> Column:
    """Text -> timestamp trying each format in turn; NULL when none fits.

    The wall clock is read in the session time zone, which panel sessions
    keep at UTC.
    """
    c = col(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def weekday(c: str | Column) -> Column:
    """Day number, 1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(col(c))


def weekday_label(c: str | Column) -> Column:
    """Short English day name, e.g. ``Sun``."""
    return F.date_format(col(c), "E")


def weekday_from_epoch(c: str | Column) -> Column:
    """Day number (1 = Sunday) of epoch seconds in UTC, independent of the
    session zone (1970-01-01 was a Thursday, day 5)."""
    return (F.pmod(F.floor(col(c) / F.lit(86400)) + F.lit(4), F.lit(7)) + F.lit(1)).cast("int")


def weekend_flag_epoch(c: str | Column) -> Column:
    """Weekend flag of epoch seconds; a missing time gives 0."""
    return F.coalesce(weekday_from_epoch(c).isin(*WEEKEND_DAYS), F.lit(False)).cast("int")


# Short English day names, Sunday first.
DAY_LABELS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def weekday_label_epoch(c: str | Column) -> Column:
    """Short day name of epoch seconds in UTC."""
    day = weekday_from_epoch(c)
    return F.when(day.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in DAY_LABELS]), day))


def weekend_flag(c: str | Column) -> Column:
    """1 on Saturday/Sunday, 0 otherwise *and* for a missing time."""
    return F.coalesce(F.dayofweek(col(c)).isin(*WEEKEND_DAYS), F.lit(False)).cast("int")


def _ntz_epoch(c: Column) -> Column:
    """Seconds since 1970 of a wall-clock (NTZ) timestamp read as UTC.

    Built from the date and clock fields, so no session zone (and no
    daylight-saving shift) is involved; whole microseconds are summed as
    integers before the single division, which rounds exactly once.
    """
    whole = (F.unix_date(F.to_date(c)).cast("bigint") * F.lit(86400)
             + F.hour(c).cast("bigint") * F.lit(3600) + F.minute(c).cast("bigint") * F.lit(60))
    micros = whole * F.lit(1_000_000) + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return micros.cast("double") / F.lit(1e6)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Timestamp (with or without zone) -> double seconds since 1970 UTC (P10).

    A timestamp without zone is read as a UTC wall clock; numbers pass
    through.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return _ntz_epoch(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double") * F.lit(86400.0)
    return c.cast("double")


def epoch_seconds_text(c: str | Column, formats: Sequence[str] = DEFAULT_TIME_FORMATS) -> Column:
    """Text -> epoch seconds, the text's wall clock read as UTC (P7 + P10).

    NULL when no format fits.  The parsed value is turned back into its
    wall clock, so the session zone does not matter.
    """
    return _ntz_epoch(parse_time(c, formats).cast("timestamp_ntz"))


# --- P12-P17: row-wise ------------------------------------------------------
def presence_flags(cols: Iterable[str], suffix: str = "_present") -> dict[str, Column]:
    """``{c+suffix: 1 if c present else 0}``."""
    return {f"{c}{suffix}": F.col(c).isNotNull().cast("int") for c in cols}


def count_present(cols: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the present values in a row; NULL (not NaN) when none."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, count_present(cols).cast("double"))


def row_count_where(cols: Sequence[str], pred) -> Column:
    """How many cells of the row satisfy ``pred(Column) -> Column``.

    A NULL test result counts as 0, like ``rowSums(..., na.rm=TRUE)``.
    """
    return sum((F.coalesce(pred(F.col(c)), F.lit(False)).cast("int") for c in cols), F.lit(0))


def any_present(cols: Sequence[str]) -> Column:
    return _or_all([F.col(c).isNotNull() for c in cols])


def all_present(cols: Sequence[str]) -> Column:
    return _and_all([F.col(c).isNotNull() for c in cols])


def _or_all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _and_all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def group_flag(c: str | Column, positive: str = "Y") -> Column:
    """1 when the value equals ``positive``; 0 for anything else incl. NULL."""
    return col(c).eqNullSafe(F.lit(positive)).cast("int")


def binarize(c: str | Column) -> Column:
    """NULL -> 0, then 1 for any non-zero value."""
    return (F.coalesce(col(c).cast("double"), F.lit(0.0)) != F.lit(0.0)).cast("int")


def binarize_columns(df: DataFrame, cols: Iterable[str], counts: Observation | None = None) -> DataFrame:
    """``binarize`` several columns in place.

    ``counts`` gets ``n_rows`` and ``filled_<column>``, nulls that became 0.
    """
    cols = list(cols)
    if counts is not None:
        df = observed(df, counts, {f"filled_{c}": col(c).cast("double").isNull() for c in cols})
    return df.withColumns({c: binarize(c) for c in cols})


def interactions(by: str, cols: Sequence[str], prefix: str | None = None,
                 as_int: bool = True) -> dict[str, Column]:
    """Product columns ``{prefix+c: by*c}``; NULL stays NULL.

    ``as_int`` truncates toward zero like an integer cast of the product.
    """
    prefix = prefix if prefix is not None else f"{by}_x_"
    out = {}
    for c in cols:
        p = F.col(by) * F.col(c)
        out[f"{prefix}{c}"] = p.cast("int") if as_int else p.cast("double")
    return out


# --- P18-P23 ----------------------------------------------------------------
def recode(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Literal value map lookup; unmapped values -> ``default``."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None
               else out.when(c == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def level_order(c: str | Column, levels: Sequence) -> Column:
    """1-based position of the value in ``levels`` (ordered factor code, P18)."""
    return recode(c, {v: i + 1 for i, v in enumerate(levels)}).cast("int")


def log_col(c: str | Column) -> Column:
    """Natural log; NULL for values <= 0."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def number_in_name(c: str | Column, pattern: str = r"(\d+)") -> Column:
    """Number captured from a name such as ``item3_present``."""
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit("")).try_cast("double")


def series_key(person: str | Column, session: str | Column, base: int = 1000) -> Column:
    """Combined bigint key ``person*base + session``.

    Collides once a session number reaches ``base``; check with
    :func:`series_key_collides` or key on the pair instead.
    """
    return col(person).cast("bigint") * F.lit(base) + col(session).cast("bigint")


def series_key_collides(session: str | Column, base: int = 1000) -> Column:
    return col(session) >= F.lit(base)


def flag_rules(rules: Mapping[str, Column]) -> dict[str, Column]:
    """Named boolean columns; a rule that can't be decided (NULL) doesn't flag."""
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def round_half_even(c: str | Column, digits: int = 1) -> Column:
    """Round half to even, as R's ``round`` (rule 9)."""
    return F.bround(col(c), digits)
