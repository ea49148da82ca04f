"""The folder that driver and executors share: staged tables, files of our own formats, their removal."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only in a local session that names no ``spark.checkpoint.dir`` (tests on one machine).
FALLBACK_DIR = "file:///tmp/checkpoints"
_ROOTS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application below ``spark.checkpoint.dir``, or below the folder set at run time; removed when the driver ends.

    The path is qualified once by the file system that Spark takes for it, so that tables and our own files go to one store. A cluster
    session without such a folder is refused.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(FALLBACK_DIR)
        base = FALLBACK_DIR
    key = sc.applicationId, base
    if key not in _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/gridlore-{sc.applicationId}")
        _ROOTS[key] = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        atexit.register(_forget, spark, _ROOTS[key])
    return _ROOTS[key]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session is gone already
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str, **seen: Column) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: the lineage ends there.

    seen: aggregates of the rows that are written, which come with the write, without a job of their own; the result's ``seen`` has them (null: 0).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    watch = Observation()
    rows = df.observe(watch, *[c.alias(k) for k, c in seen.items()]) if seen else df
    rows.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path, out.seen = path, {k: v or 0 for k, v in watch.get.items()} if seen else {}
    return out


def rows_seen() -> dict[str, Column]:
    """For stage: the number of rows."""
    return {"rows": F.count(F.lit(1))}


def n_seen() -> dict[str, Column]:
    """For stage, of a table with a column n: the number of rows, the largest n and the sum of n."""
    return rows_seen() | {"most": F.max("n"), "total": F.sum("n")}


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            remove(df.sparkSession, path)


#: Most keys whose rows are joined where they are; the bound of the broadcast in join_spread.
SPREAD_KEYS = 4096


def join_spread(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many joined with one on key; one has a row for each key, with n, about the rows of many that have it (n goes). total: the sum of n.

    Keys with more than a SPREAD_KEYS-th of the rows (fewer than SPREAD_KEYS) are broadcast, so their rows stay where they are; the
    others are shuffled, and none of them can fill a task. Both tables should be staged: each is read twice. If the largest n was seen as one was staged (n_seen), no job asks for it.
    """
    limit = max(256, total // SPREAD_KEYS)
    hot = one.where(F.col("n") > limit).drop("n")
    most = getattr(one, "seen", {}).get("most")
    if hot.isEmpty() if most is None else most <= limit:
        return many.join(one.drop("n"), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(rest.join(one.where(F.col("n") <= limit).drop("n"), key))


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, each: int = 4000):
    """Fewer shuffle partitions for tables of few rows that go through many rounds; never more than the session asks for, four at least."""
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(asked), max(4, rows // each)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)


class Folder:
    """Byte files in a shared folder, for executors: a mounted path by plain calls, other stores through pyarrow."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        u = urlparse(uri)
        self.local = u.path.rstrip("/") if u.scheme in ("", "file") else None

    def write(self, name: str, chunks) -> int:
        """Write under another name, then rename: a task that dies leaves no half file under ``name``."""
        n = 0
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.part"
            with open(part, "wb") as f:
                for c in chunks:
                    n += f.write(c)
            os.replace(part, f"{self.local}/{name}")
            return n
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{name}.part", compression=None) as f:
            for c in chunks:
                f.write(c)
                n += len(c)
        store.move(f"{root}/.{name}.part", f"{root}/{name}")
        return n

    def open(self, name: str):
        if self.local:
            return open(f"{self.local}/{name}", "rb")
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        return store.open_input_file(f"{root}/{name}")
