"""Operator 1: SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.llm.graph import components
from panelflow.llm.store import cut, discard, whole_row

#: Words of a shingle, most differing bits of a link, hash seed.
SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: A table key shared by more fingerprints than this is matched through Hamming balls.
WIDE = 128
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles, repeats included, as unsigned int."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[min(shingle, len(words)) - 1:].tolist()
    start = start[:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(start[at:at + _CHUNK], stop[at:at + _CHUNK])], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits."""
    masks = [[0]]
    for _ in range(radius):
        masks.append([m | 1 << b for m in masks[-1] for b in range(m.bit_length(), bits)])
    return [m for level in masks for m in level]


def _masks(bits: int, radius: int) -> Column:
    # one-row constants; Spark folds them
    return F.array(*[F.lit(m).cast("long") for m in _ball(bits, radius)])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that differ in at most MAX_BITS = 3 bits.

    Enough of them that the links' connected groups are those of all pairs.
    Joins are merge joins: no table that grows with the input is broadcast.

    Multi-index hashing: a fingerprint has two segments of 32 bits, and one
    of them differs in at most 1 bit if all differ in at most 3.  Each
    segment's table holds every fingerprint by its segment; each fingerprint
    looks up its own segment and the ball of radius 1 around it (only bits
    that are 0 there: of two neighbours, one has the 0), and the complete
    distance of each match is verified.

    A key that more than WIDE fingerprints share would give all pairs of a
    dense group.  There the ball goes on into the other segment: a centre is
    entered at each point within 1 bit of its other segment, what looked the
    key up at each point within the rest of the distance (2 bits for the
    key's own members, 1 for neighbours by one bit).  A pair within distance
    meets at a point, all that meet a centre there are within distance of
    it, and one link to the smallest centre stands for the point.  A point
    holds at most the volume of these balls.
    """
    low = F.lit(0xFFFFFFFF).cast("long")
    seg = lambda s: F.col("fp").bitwiseAND(low) if s == 0 else F.shiftrightunsigned("fp", 32)
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), seg(s).alias("own"), seg(1 - s).alias("other"))
                                                 for s in (0, 1)])).alias("t")).select("fp", "t.*")
    wide = cut(table.groupBy("s", "own").count().where(F.col("count") > WIDE).select(
        "s", F.col("own").alias("key"), F.lit(True).alias("wide")))
    one = [F.lit(1 << i).cast("long") for i in range(32)]
    flips = F.concat(F.array(F.lit(0).cast("long")),
                     F.filter(F.array(*one), lambda m: F.col("own").bitwiseAND(m) == 0))
    looks = table.withColumn("m", F.explode(flips)).select(
        "s", "fp", "other", (F.col("m") > 0).alias("flipped"), F.col("own").bitwiseOR(F.col("m")).alias("key"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    if wide.isEmpty():
        narrow = looks
    else:
        looks = looks.join(wide.hint("merge"), ["s", "key"], "left")
        narrow = looks.where("wide IS NULL")
    held = table.select("s", F.col("own").alias("key"), F.col("fp").alias("b"))
    near = (narrow.withColumnRenamed("fp", "a").join(held.hint("merge"), ["s", "key"])
            .where((F.col("flipped") | (F.col("a") < F.col("b"))) & far).select("a", "b"))
    if wide.isEmpty():
        return near
    at = looks.where("wide")
    point = lambda masks, rows, centre: (
        rows.withColumn("m", F.explode(masks)).select(
            "s", "key", F.col("other").bitwiseXOR(F.col("m")).alias("z"), "fp", F.lit(centre).alias("centre")))
    own, neighbours = at.where("NOT flipped"), at.where("flipped")
    points = (point(_masks(32, 1), own, True)
              .unionByName(point(_masks(32, 2), own, False))
              .unionByName(point(_masks(32, 1), neighbours, False)))
    first = F.min(F.when(F.col("centre"), F.col("fp"))).over(Window.partitionBy("s", "key", "z"))
    dense = (points.withColumn("a", first).where("a IS NOT NULL AND a <> fp")
             .select("a", F.col("fp").alias("b")).distinct())
    return near.unionByName(dense)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of at
    most 3 differing bits, the row's own included; rows of one fingerprint
    are linked without pairing them.  Null text and texts without words:
    fingerprint 0, linked like any other.  Null doc_id: kept, never a
    component's id unless no other is there.  Repeated rows: each is
    returned.  Empty table: empty result.  Other columns are ignored.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the index is built for 3 bits: two segments, balls of radius 1")
    fps = cut(fingerprints(docs, shingle, seed))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(groups.select("fp")))
    rooted = cut(groups.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
                 .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    discard(groups, roots)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return (fps.join(rooted.select("fp", "root").hint("merge"), "fp").join(ids.hint("merge"), "root")
            .select("doc_id", "fp", "component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document per near-duplicate group: that of the smallest doc_id.

    Of rows alike in doc_id and text one stays; rows without doc_id stay,
    as nothing tells which document they are.  All columns are kept,
    whatever their names.
    """
    found = near_dedup(docs.select("doc_id", "text"), **options).where("doc_id = component_id")
    rows = docs.select(whole_row(docs).alias("_row"))
    kept = rows.join(found.select(F.col("doc_id").alias("_id")).distinct().hint("merge"), F.col("_row.doc_id") == F.col("_id"), "left_semi")
    one = Window.partitionBy("_row.doc_id", F.xxhash64("_row.text")).orderBy("_row.doc_id")
    kept = kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
