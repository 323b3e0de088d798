"""Operator 10: URL filters by a sorted sweep over reversed-host keys (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelflow.llm.store import cut, partitions
from panelflow.llm.words import ascii_lower

#: (verdict, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
# Parts host from path in a key; below every character that a label may hold.
_PART = "\u0001"
# Above every key that starts with the same text.
_TOP = "\U0010ffff"


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path): after ``://`` up to /, ?, # or the end, A-Z lower-cased; then up to ? or #."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(_PART), path)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, host, path) rows from tuples."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(r, ("verdict", "host", "path"), strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "verdict string, host string, path string")


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of ``urls``.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest host and path together win, at a tie the longer
    host.  Of rules alike in host and path, block wins.

    A rule's key is its reversed host, a divider and its path; the urls that
    it fits at that host level are the interval of keys that start so.  Each
    url takes part once per host level, up to the deepest level that any
    rule has.  Rule starts, rule ends and distinct url keys are range
    partitioned and swept in key order.  The intervals are nested, so the
    open ones are a stack: the running count of starts less ends is its
    height, and its top is the last rule that started at that height.  A
    rule open at a partition's border starts anew in each later partition
    that it reaches.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    labels = _reversed(F.col("host"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("hl"),
                         F.size(labels).alias("n"), _key(labels, F.col("path")).alias("key"))
    deepest = rules.agg(F.coalesce(F.max("n"), F.lit(0)).alias("deepest"))  # one row
    labels = _reversed(F.col("host"))
    probes = (urls.select("host", "path").distinct().crossJoin(F.broadcast(deepest))
              .withColumn("_l", labels)
              .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("_l"), F.greatest("deepest", F.lit(1))))))
              .select(_key(F.slice("_l", 1, F.col("level")), F.col("path")).alias("key")).distinct())
    none = F.lit(None).cast("string")
    events = (probes.select("key", F.lit(1).alias("kind"), none.alias("rule"), none.alias("verdict"),
                            F.lit(0).alias("hl"), F.col("key").alias("own"))
              .unionByName(rules.select("key", F.lit(0).alias("kind"), "rule", "verdict", "hl", F.col("key").alias("own")))
              .unionByName(rules.select(F.concat("key", F.lit(_TOP)).alias("key"), F.lit(2).alias("kind"),
                                        "rule", "verdict", "hl", F.col("key").alias("own"))))
    n = partitions(urls.sparkSession)
    events = cut(events.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()))
    reach = (events.where("kind <> 1").groupBy("own").agg(
        F.min("part").alias("a"), F.max("part").alias("b"), F.first("rule").alias("rule"),
        F.first("verdict").alias("verdict"), F.first("hl").alias("hl")).where("b > a"))
    again = reach.withColumn("part", F.explode(F.sequence(F.col("a") + 1, F.col("b")))).select(
        F.col("own").alias("key"), F.lit(-1).alias("kind"), "rule", "verdict", "hl", "own", "part")
    swept = events.unionByName(again).withColumn("fresh", F.col("kind") >= 0)
    order = [F.col("fresh"), F.col("key"), F.col("kind")]
    step = F.when(F.col("kind") <= 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    height = F.sum(step).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = swept.withColumn("height", height)
    top = F.last(F.when(F.col("kind") <= 0, F.struct("rule", "verdict", "hl")), ignorenulls=True).over(
        Window.partitionBy("part", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = (swept.withColumn("top", top).where("kind = 1 AND height > 0")
             .select("key", "top.rule", "top.verdict", "top.hl"))
    # back to the urls: the best of the levels
    levels = (urls.select("host", "path").distinct().crossJoin(F.broadcast(deepest)).withColumn("_l", labels)
              .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("_l"), F.greatest("deepest", F.lit(1))))))
              .select("host", "path", _key(F.slice("_l", 1, F.col("level")), F.col("path")).alias("key")))
    best = (levels.join(found, "key", "left").groupBy("host", "path")
            .agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(
                F.length("rule").alias("l"), "hl", "rule", "verdict"))).alias("b")))
    return best.select("host", "path", F.col("b.rule").alias("rule"),
                       F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    Null url, or one without ``://``: empty host and path, no rule, the
    default verdict.  Repeated rows and null page_id stay as they are.
    Empty table or no rules: defined the same way.  Other columns are
    ignored.  Verdicts are found once per distinct (host, path); the join
    back has one row per key on that side, so a hot url can be split.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    return urls.join(judge(urls, rules, default), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""
