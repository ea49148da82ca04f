"""The corpus pipeline: documents pass through STAGES in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontamination, near_copies, packing, quality
from gridlore.llm.queries import HELD_OUT, QUALITY_LEAST
from gridlore.llm.shared import fresh_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under QUALITY_LEAST go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = quality.train(docs, labels, teach=~F.expr(HELD_OUT))
    name = "_score" + "_" * max(map(len, docs.columns))  # no column of the documents
    return quality.score(docs, scorer, out_col=name).where(F.col(name) >= QUALITY_LEAST).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8 or more) stays, the one with the smallest id."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens take their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: No SQL for a trained classifier, near copies' components, tiling or a tokenizer: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        out.write.parquet(path := fresh_path(spark, f"stage{i}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
