"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local master.

    A cluster without the setting is an error: a machine-local folder there
    would hide files from the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="panelflow-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a kept RDD the table survives lost executors, and unlike
    ``checkpoint()`` the last stage runs only once.
    """
    path = _new_path(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_turn(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The union of ``parts`` (one at least) as one table of ``cut``; only one part's shuffles are on disk at a time."""
    path, schema = _new_path(spark), None
    for df in parts:
        df.write.mode("append").option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the files go of shuffles that nothing reads any more.

    Spark deletes them once the driver has collected the plan that they
    belong to; with much free memory there that can be long after the next
    tables are written.
    """
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            at = name.rfind("/cut-")
            path = spark._jvm.org.apache.hadoop.fs.Path(name[:name.index("/", at + 1)])
            if at > 0:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs clashes with a column added beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number of hash buckets operators deal into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
