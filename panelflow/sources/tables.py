"""Readers, name repair and writers (S1-S5), plus the driver-table views.

``events`` plays the long response table: ``user_id`` is the person,
``ts`` the prompt time, ``event_id`` the input row number (``seq``).
Two panels are derived from it (see FIXTURES.md):

* the **dense panel**: one row per event, ``Y1 = value``, ``Y2 = k`` of
  ``props``;
* the **sparse panel**: long responses ``label = event_type || '_' || k%2``
  at prompt = (user, day), pivoted to wide with ``max`` for repeated cells.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.functions.columns import SKIPPED_SENTINEL, epoch_seconds

# Fixed values of the sparse panel mapping (FIXTURES.md §2).
SPARSE_SCALE_A = ("click_0", "click_1", "view_0", "view_1")
SPARSE_SCALE_B = ("purchase_0", "purchase_1", "signup_0", "signup_1")
SPARSE_CONTEXTS = ("error_0", "error_1")
SPARSE_LABELS = SPARSE_SCALE_A + SPARSE_SCALE_B + SPARSE_CONTEXTS
PROMPT_SECONDS = 86400          # prompt = (user, time floored to 24 h)
POSITIVE_GROUP = "Y"

RESPONSE_SCHEMA = T.StructType([
    T.StructField("participant_id", T.LongType()),
    T.StructField("notification_time", T.StringType()),
    T.StructField("session_instance_no", T.IntegerType()),
    T.StructField("adhd", T.StringType()),
    T.StructField("prompt_label", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("seq", T.LongType()),
])


# --- S1-S3 ----------------------------------------------------------------
def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, header: bool = True,
               **options) -> DataFrame:
    """Read parquet/csv/json/orc with an optional declared schema."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", str(header).lower())
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = RESPONSE_SCHEMA, **options) -> DataFrame:
    """The long response table (S1).  Spreadsheets have no Spark source:
    export them to CSV or Parquet first."""
    return read_table(spark, path, fmt, schema, **options)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- S4, P3-P5 ----------------------------------------------------------------
_R_RESERVED = {"if", "else", "repeat", "while", "function", "for", "next", "break",
               "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "in"}


def make_name(name: str) -> str:
    """A syntactically valid name: bad characters -> '.', an ``X`` prefix
    when the name does not start with a letter or a dot not followed by a
    digit, a trailing '.' for reserved words (S4)."""
    s = re.sub(r"[^0-9A-Za-z._]", ".", name)
    if not s or not (s[0].isalpha() or (s[0] == "." and not (len(s) > 1 and s[1].isdigit()))):
        s = "X" + s
    if s in _R_RESERVED:
        s = s + "."
    return s


def make_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[make_name(c) for c in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename the first ``len(names)`` columns by position."""
    cols = list(names) + df.columns[len(names):]
    return df.toDF(*cols)


def rename_regex(df: DataFrame, pattern: str, repl: str) -> DataFrame:
    """Regex replace in every column name (P5)."""
    return df.toDF(*[re.sub(pattern, repl, c) for c in df.columns])


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def ensure_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add a column only when absent."""
    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


# --- S5 ---------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] | None = None, mode: str = "overwrite", **options) -> None:
    """Write ``df`` to a folder, in subfolders by ``partition_by``."""
    w = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_person_table(df: DataFrame, name: str, key: str, order: Sequence[str] = (), *, buckets: int = 200,
                       mode: str = "overwrite") -> DataFrame:
    """Save ``df`` as table ``name`` in the warehouse, bucketed by person and sorted in each bucket; returns the table.

    A person's rows lie in one bucket, so whatever groups or orders by the
    person afterwards (sessions, lags, counts, moments) reads the table
    without a shuffle, in every later session.  Rows are dealt to the buckets
    before they are written: one file per bucket, ordered by (key, order), and
    scans may use that order.  ``buckets`` should give files of some 100 MB.
    """
    spark = df.sparkSession
    sort = [key, *order]
    (df.repartition(buckets, key).sortWithinPartitions(*sort).write.mode(mode).format("parquet")
     .bucketBy(buckets, key).sortBy(*sort).saveAsTable(name))
    return spark.table(name)


def drop_person_table(spark: SparkSession, name: str) -> None:
    """Delete a table of ``write_person_table``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- driver-table panels ----------------------------------------------------
def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the panel columns: ID, t (epoch s), seq, group, Y1, Y2."""
    ev = driver_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return ev.select(
        F.col("user_id").alias("ID"),
        epoch_seconds(ev, "ts").alias("t"),
        F.col("event_id").alias("seq"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 1, F.lit("Y")).otherwise(F.lit("N")).alias("ADHD"),
        F.col("value").alias("Y1"),
        k.cast("double").alias("Y2"),
        F.col("event_type"),
        k.alias("k"),
        F.col("ts"),
    )


def sparse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long responses of the sparse panel: one row per event.

    Columns: ID, t (prompt time, epoch s, day floor), seq, ADHD, label, value.
    """
    ev = driver_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    ts = epoch_seconds(ev, "ts")
    return ev.select(
        F.col("user_id").alias("ID"),
        (F.floor(ts / F.lit(PROMPT_SECONDS)) * F.lit(PROMPT_SECONDS)).cast("double").alias("t"),
        F.col("event_id").alias("seq"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 1, F.lit("Y")).otherwise(F.lit("N")).alias("ADHD"),
        F.concat(F.col("event_type"), F.lit("_"), F.pmod(k, F.lit(2)).cast("string")).alias("label"),
        F.col("value").alias("value"),
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw response rows of ``RESPONSE_SCHEMA``: text answers and times, with what goes wrong in them.

    Every 7th event is skipped, every 29th has an answer that is no number,
    every 101st a time that can't be parsed, every 53rd no session number.
    """
    ev = driver_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    n = F.col("event_id")
    day = F.date_trunc("day", "ts")
    return ev.select(
        F.col("user_id").alias("participant_id"),
        F.when(n % 101 == 0, F.concat(F.lit("late "), F.date_format(day, "dd.MM.")))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("notification_time"),
        F.when(n % 53 != 0, F.lit(1)).alias("session_instance_no"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 1, F.lit("Y")).otherwise(F.lit("N")).alias("adhd"),
        F.concat(F.col("event_type"), F.lit("_"), F.pmod(k, F.lit(2)).cast("string")).alias("prompt_label"),
        F.when(n % 7 == 0, F.lit(SKIPPED_SENTINEL)).when(n % 29 == 0, F.lit("often"))
        .otherwise(F.floor("value").cast("bigint").cast("string")).alias("response"),
        n.alias("seq"))
