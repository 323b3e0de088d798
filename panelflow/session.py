"""Spark session helpers.

The library never creates a session on its own inside an operator; these
helpers are for tests, the bench and scripts.  On a cluster the caller's
session is used as is: only settings that are unset get a local default.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every panel job relies on.  UTC makes epoch seconds and weekday
# numbers independent of the machine; AQE coalesces the many small shuffle
# partitions of per-person tables and splits skewed sort-merge joins.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "panelflow") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PANELFLOW_DRIVER_MEMORY", "8g"))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is read
    from the session and never replaced.  Only when nothing is configured
    (tests on one machine) a fresh scratch folder is used; off a local
    master that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="panelflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_written: list[str] = []        # folders of tables that this process wrote and has not deleted


def write_through(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several branches can then read one fixed result: its lineage is cut,
    nothing stays persisted, and a lost executor takes nothing with it.
    Column metadata is kept.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``write_through`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            at = name.rfind("/table-")
            if at > 0:
                path = name[:name.index("/", at + 1)]
                _delete(df.sparkSession, path)
                _written[:] = [p for p in _written if not path.endswith(p[p.rfind("/table-"):])]


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are deleted at the end.

    Sessions, series, ranks and fits write intermediate tables that their
    lazy results still read; run the action that needs a result (write,
    collect) inside, and nothing is left in the shared folder.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _delete(spark, path)
        del _written[before:]
