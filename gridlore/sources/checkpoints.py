"""Checkpoints of many species: a folder each, whose meta file is written last. Readers take no folder without one, nor one whose rows aren't as many as it claims."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "_meta.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Under another name, then renamed: nobody reads half of it."""
    fs, at = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.part")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, at):
        raise OSError(f"{path} can't be written")


def write_checkpoints(df: DataFrame, root: str, key: str = "species", version: str = "1") -> list[str]:
    """Write each key's rows below root, replacing what is there of it: all rows in one distributed job aside, then for each key a rename and, last, its meta file. The keys written, in order.

    A run that dies leaves the keys it has finished, whole, and of the others nothing that a reader takes. Rows of a null key are left out. The driver sees a key and a number for each key.
    """
    spark = df.sparkSession
    aside = f"{root.rstrip('/')}/.{uuid.uuid4().hex[:12]}"
    df.where(F.col(key).isNotNull()).withColumn("_of", F.sha2(F.col(key).cast("string"), 256)).write.partitionBy("_of").parquet(aside)
    rows = spark.read.schema(f"{df.select(key).schema[0].simpleString().replace(':', ' ')}, _of string").parquet(aside).groupBy("_of").agg(F.first(key).alias("k"), F.count("*").alias("n")).orderBy("k").collect()
    fs, _ = _fs(spark, root)
    path, done = spark._jvm.org.apache.hadoop.fs.Path, []
    for r in rows:
        home = f"{root.rstrip('/')}/{r['_of']}"
        fs.delete(path(f"{home}/{META}"), False)  # from here on the old one is gone for readers
        fs.delete(path(home), True)
        if not fs.rename(path(f"{aside}/_of={r['_of']}"), path(home)):
            raise OSError(f"{home} can't be written")
        _put(spark, f"{home}/{META}", json.dumps({"key": str(r["k"]), "rows": r["n"], "version": version}))
        done.append(str(r["k"]))
    fs.delete(path(aside), True)
    return done


def metas(spark: SparkSession, root: str, version: str | None = "1") -> dict[str, dict]:
    """The meta of each finished checkpoint, by folder; those of another version aren't finished."""
    fs, at = _fs(spark, root)
    out = {}
    if fs.exists(at):
        for s in fs.listStatus(at):
            home = s.getPath().toString()
            if s.isDirectory() and not s.getPath().getName().startswith(".") and _fs(spark, f"{home}/{META}")[0].exists(_fs(spark, f"{home}/{META}")[1]):
                meta = json.loads(_text(spark, f"{home}/{META}"))
                if version is None or meta.get("version") == version:
                    out[home] = meta
    return out


def read_checkpoints(spark: SparkSession, root: str, schema: str, version: str | None = "1") -> tuple[DataFrame, list[str]]:
    """(rows of all finished checkpoints, keys whose folder holds another number of rows than its meta claims: theirs are left out)."""
    found = metas(spark, root, version)
    if not found:
        return spark.createDataFrame([], schema), []
    rows = spark.read.schema(schema).parquet(*found).withColumn("_home", F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})/[^/]*$", 1))
    claimed = spark.createDataFrame([(h.rsplit("/", 1)[1], m["rows"], m["key"]) for h, m in found.items()], "_home string, claimed long, key string")  # a row for each key
    wrong = rows.groupBy("_home").agg(F.count("*").alias("n")).join(F.broadcast(claimed), "_home", "right").where("coalesce(n, 0) <> claimed").select("_home", "key").collect()
    if wrong:
        rows = rows.where(~F.col("_home").isin([r["_home"] for r in wrong]))
    return rows.drop("_home"), sorted(r["key"] for r in wrong)


def unfinished(keys: DataFrame, root: str, key: str = "species", version: str | None = "1") -> DataFrame:
    """Of a table of keys those without a finished checkpoint: what a resumed run has to do."""
    spark = keys.sparkSession
    done = spark.createDataFrame([(m["key"],) for m in metas(spark, root, version).values()], "_done string")
    return keys.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
