"""Saved models: tables of model texts, suitability maps as cell tables, and reference scores kept by model version."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import Booster, Network, score


def save_models(models: DataFrame, path: str, key: str = "species", text: str = "model") -> None:
    """One Parquet row for each model text; Spark's commit lets nobody see half of it. Rows without a model are left out."""
    models.where(F.col(text).isNotNull()).select(key, text).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, name: str, key: str = "species", text: str = "model") -> Booster | Network:
    rows = spark.read.parquet(path).where(F.col(key) == name).select(text).limit(1).collect()
    if not rows:
        raise ValueError(f"no model of {name}")
    kind = Network if '"format"' in rows[0][0][:40] else Booster
    return kind.from_json(rows[0][0])


def suitability_map(cells: DataFrame, model: Booster, features: Sequence[str], threshold: float, excluded: str | None = None) -> DataFrame:
    """(cell_id, suitability, recommended): null where the cell is excluded, recommended from the threshold on."""
    keep = ["cell_id", *([excluded] if excluded else [])]
    out = score(cells, model, features, "suitability", keep)
    if excluded:
        out = out.withColumn("suitability", F.when(~F.coalesce(F.col(excluded), F.lit(False)), F.col("suitability"))).drop(excluded)
    return out.withColumn("recommended", (F.col("suitability") >= threshold).cast("int"))


def reference_scores(spark: SparkSession, folder: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The sorted reference scores of a model version: read if they are there whole, else built, written and read."""
    path = f"{folder.rstrip('/')}/reference-{version}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().repartitionByRange("species", "score").sortWithinPartitions("species", "score").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_existing(spark: SparkSession, candidates: Sequence[str], label: str) -> str:
    """The first of the paths that exists, in whatever file system it is."""
    for c in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(c)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return c
    raise FileNotFoundError(f"no {label} at {', '.join(candidates)}")


def resolve(spark: SparkSession, path: str, roots: Sequence[str]) -> str:
    """A path as it is if absolute or with a scheme, else below the first root that has it."""
    if path.startswith("/") or "://" in path:
        return path
    return first_existing(spark, [f"{r.rstrip('/')}/{path}" for r in roots], path)
