"""Operator 2: mixing sources to target weights by systematic sampling (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.prefix import prefix_sums
from panelflow.llm.store import cut, whole_row
from panelflow.llm.words import n_words

#: Weights of the sources by code point, repeating; share of all sizes; most copies.
WEIGHTS, SHARE, MOST, SEED, TIES = (5, 2, 1), 1.0, 3.0, 42, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    A target is the weight's share of the total, held at ``most`` times the
    source's size; what is above goes to the others by weight until none is
    above.  With the sources in order of cap per weight that is one running
    sum: the capped ones come first.  One row per source is scanned, never a
    row per document.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    t = (sizes.withColumn("_n", F.row_number().over(one))
         .withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                        ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
         .withColumn("_cap", F.lit(float(most)) * F.col("source_size")))
    all_ = Window.partitionBy()
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(all_)
                      - F.coalesce(F.sum("_cap").over(up), F.lit(0.0)))
         .withColumn("_wleft", F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(up), F.lit(0.0)))
         .withColumn("_unit", F.col("_left") / F.col("_wleft"))
         .withColumn("_open", F.col("_cap") > F.col("_w") * F.col("_unit")))
    unit = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_n", "_unit"))).over(all_)
    return t.select("source", "source_size",
                    F.when(F.col("_open"), F.col("_w") * unit["_unit"]).otherwise(F.col("_cap")).alias("target"))


def _hex(c: Column, chars: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, chars), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per document.

    Systematic sampling: within a source each document expects
    target / source_size copies.  Their prefix sums, plus one random offset
    per source, cross an integer once per copy taken.  Documents stand in
    order of size, so that every stretch of the line holds documents of one
    size and the words taken stay within about one document of the target.
    The offset and the order among equal sizes come from hashes of ``seed``,
    source and doc_id: reruns agree.

    Null or empty text: size 0, no words taken.  Null source: a source of
    its own, last.  Null or repeated doc_id: each row counts by itself.
    Empty table: empty result.  Other columns are ignored.
    """
    base = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    base = base.withColumn("_down", -F.col("size")).withColumn("_tie", _hex(F.col("doc_id"), 3) % TIES)
    ranked = prefix_sums(base, ["source"], ["_down", "_tie"], ["doc_id", "size"], F.lit(1), "_before")
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    offset = _hex(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("\u0000"))), 8) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda n: F.floor(F.col("_rate") * n + F.col("_offset"))
    return (ranked.join(t, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_rate", rate).withColumn("_offset", offset)
            .withColumn("copies", (upto(F.col("_before") + 1) - upto(F.col("_before"))).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the sample takes it.

    Copies are decided per (doc_id, source, size); rows alike in these are
    dealt their copies one by one, in no particular order.
    """
    key = ["doc_id", "source", "size"]
    w = Window.partitionBy(*key).orderBy("copies")
    plan = mix(docs, **options).withColumn("_n", F.row_number().over(w))
    rows = docs.select(whole_row(docs).alias("_row"), n_words(F.col("text")).alias("_size"))
    rows = rows.withColumn("_n", F.row_number().over(
        Window.partitionBy("_row.doc_id", "_row.source", "_size").orderBy(F.xxhash64("_row.text"))))
    p = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"),
                    F.col("_n").alias("_k"), "copies").where("copies > 0")
    joined = rows.join(p, F.col("_row.doc_id").eqNullSafe(F.col("_d")) & F.col("_row.source").eqNullSafe(F.col("_s"))
                       & (F.col("_size") == F.col("_z")) & (F.col("_n") == F.col("_k")))
    return (joined.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("_row.*"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def sql(docs: str = "documents", size: str = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)") -> str:
    """DuckDB SQL for ``op2_mixing`` over the relation ``docs``."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST({size} AS BIGINT) AS size FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
c AS (SELECT *, ([5.0, 2.0, 1.0])[CAST((n - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM w),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS unit
      FROM c WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, cap > w * unit AS open FROM u),
t AS (SELECT source, source_size, CASE WHEN open THEN w * (SELECT arg_min(unit, cap / w) FROM v WHERE open) ELSE cap END AS target FROM v),
r AS (SELECT d.doc_id, d.source, d.size,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC,
          CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 3) AS BIGINT), d.doc_id NULLS FIRST) AS rn
      FROM d),
x AS (SELECT r.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('42/' || coalesce(r.source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CAST(floor(rate * rn + off) - floor(rate * (rn - 1) + off) AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM y"""
