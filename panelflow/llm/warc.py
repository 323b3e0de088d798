"""Operator 8: Merkle fixity audit of WARC replicas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.prefix import prefix_sums
from panelflow.llm.store import cut, discard

#: Records of consecutive page_ids in one WARC file, bytes of a leaf's offset range, children of a node.
FILE_IDS, LEAF_BYTES, FANOUT, TIES = 256, 32768, 4, 64


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a WARC response record; nulls are empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def archive(pages: DataFrame, file_ids: int = FILE_IDS, rotten: Column | None = None) -> DataFrame:
    """(file, page_id, record_offset, length, digest): the pages as records of WARC files.

    A file holds the records of ``file_ids`` consecutive page_ids in order
    (ties by digest); a record's offset is the prefix sum of the lengths
    before it.  Null page_id: a file of its own, named by null.  Where
    ``rotten`` holds, a bit of the record's bytes is flipped.
    """
    rec = warc_record(F.col("url"), F.col("html"))
    if rotten is not None:  # the version's 1, which every record has
        rec = F.when(rotten, F.overlay(rec, F.lit("0").cast("binary"), F.lit(6))).otherwise(rec)
    rows = pages.select(F.floor(F.col("page_id") / file_ids).alias("file"), "page_id",
                        F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"))
    # rows of one page_id in order of digest: by its leading digits, then by itself
    rows = rows.withColumn("_tie", F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") * TIES / 65536))
    return prefix_sums(rows, ["file"], ["page_id", "_tie"], ["digest", "length"], F.col("length"),
                       "record_offset").drop("_tie")


def leaves(records: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, node, digest): the hash of each ordered offset range, from its records' own digests.

    A record belongs to the range in which it starts, so a group holds at
    most ``leaf_bytes`` bytes of records and one more.
    """
    one = F.array_sort(F.collect_list(F.struct("record_offset", "length", "digest")))
    return (records.withColumn("node", F.floor(F.col("record_offset") / leaf_bytes))
            .groupBy("file", "node").agg(one.alias("r"))
            .select("file", "node", F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(
                "/", x["record_offset"], x["length"], x["digest"])), ";"), 256).alias("digest")))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level of the tree: each node hashes its ``fanout`` children in order."""
    return (nodes.withColumn("up", F.floor(F.col("node") / fanout)).groupBy("file", "up")
            .agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("r"))
            .select("file", F.col("up").alias("node"), F.sha2(F.array_join(F.transform(
                "r", lambda x: F.concat_ws("/", x["node"], x["digest"])), ";"), 256).alias("digest")))


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("digest").alias("_digest"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    j = a.select(*keys, "digest").join(b, on, "full")
    return j.where(~F.col("digest").eqNullSafe(F.col("_digest"))).select(
        *[F.when(F.col("digest").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys])


def _within(rows: DataFrame, marked: DataFrame, node: Column) -> DataFrame:
    """Rows whose (file, node) is marked; null files meet."""
    m = marked.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    return rows.join(m, F.col("file").eqNullSafe(F.col("_f")) & (node == F.col("_n")), "left_semi")


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, record_offset, length, page_id, problem): the records in which two replicas differ.

    Both are (file, page_id, record_offset, length, digest).  Each replica's
    records are hashed into leaves and the leaves into trees, as many levels
    as the longest file needs; all files share them.  Roots are compared
    first; below, only children of nodes that differ are compared, and only
    the records of differing leaves are read.  problem: ``changed`` (other
    bytes at the same offset), ``missing`` or ``extra`` (nothing starts
    there in the right or left replica); length and page_id are of the left
    replica, else of the right.

    Equal replicas, and two empty ones: no rows.  Records alike in file and
    offset are compared as a sorted list.
    """
    both = [cut(left), cut(right)]
    end = reduce(lambda a, b: a.unionByName(b), [x.agg(F.max("record_offset").alias("m")) for x in both])
    longest = end.agg(F.max("m")).first()[0] or 0
    levels, top = [[cut(leaves(x, leaf_bytes)) for x in both]], longest // leaf_bytes
    while top > 0:
        levels.append([cut(parents(x, fanout)) for x in levels[-1]])
        top //= fanout
    marked = cut(_differing(*levels[-1], ["file", "node"]))
    for below in reversed(levels[:-1]):
        up = F.floor(F.col("node") / fanout)
        above, marked = marked, cut(_differing(*[_within(x, marked, up) for x in below], ["file", "node"]))
        discard(above)
    discard(*[x for level in levels for x in level])
    sides = []
    for x, name in zip(both, ("l", "r"), strict=True):
        bad = _within(x, marked, F.floor(F.col("record_offset") / leaf_bytes))
        sides.append(bad.groupBy("file", "record_offset").agg(
            F.array_sort(F.collect_list(F.struct("digest", "length", "page_id"))).alias(name)))
    b = sides[1].select(F.col("file").alias("_f"), F.col("record_offset").alias("_o"), "r")
    j = sides[0].join(b, F.col("file").eqNullSafe(F.col("_f")) & (F.col("record_offset") == F.col("_o")), "full")
    j = j.where(~F.col("l").eqNullSafe(F.col("r")))
    shown = F.coalesce("l", "r")
    return j.select(F.when(F.col("l").isNotNull(), F.col("file")).otherwise(F.col("_f")).alias("file"),
                    F.coalesce("record_offset", "_o").alias("record_offset"), shown[0]["length"].alias("length"),
                    shown[0]["page_id"].alias("page_id"),
                    F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra")
                    .otherwise("changed").alias("problem"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica as bit rot leaves it, hashed from its own bytes: every 97th page_id has other ones, every 193rd is gone.

    A lost record leaves its place: those behind it keep their offsets.
    """
    records = archive(pages, rotten=F.col("page_id") % 97 == 5)
    return records.where(F.coalesce(F.col("page_id") % 193 != 7, F.lit(True)))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """The records in which a damaged replica of all pages' WARC files differs from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(archive(pages), damaged(pages))


SQL = r"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
        || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
        || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM b),
r AS (SELECT CAST(floor(page_id / 256.0) AS BIGINT) AS file, page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest FROM t),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM r)
SELECT file, record_offset, length, page_id,
  CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS problem
FROM o WHERE page_id % 193 = 7 OR page_id % 97 = 5"""
