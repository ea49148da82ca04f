"""A folder of this application that driver and executors share, for files that a plan writes and reads again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (or the folder set at run time), as a URI; a cluster without one is refused. Removed when the driver ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/cells-{sc.applicationId}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(root).toString()
    if uri not in _MADE:
        fs.mkdirs(root)
        _MADE.add(uri)
        atexit.register(remove, spark, uri)
    return f"{uri}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again: the lineage ends there."""
    df.write.parquet(path := work_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
