"""Names against a table of matches: guards on rank and lineage, accepted names, homonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(names: DataFrame, matches: DataFrame, rank: str = "SPECIES") -> DataFrame:
    """(name) with the match table (name, usageKey, acceptedUsageKey, rank, kingdom, phylum, canonicalName, status) -> key, accepted_name, problem.

    A match of another rank, of no vascular plant, or of another genus is refused and says why; synonyms go to the accepted key.
    """
    j = names.join(matches, "name", "left")
    genus = lambda c: F.lower(F.get(F.split(c, " "), 0))
    other = genus(F.coalesce("canonicalName", "name")) != genus(F.col("name"))
    problem = F.when(F.col("usageKey").isNull(), "no match").when(F.col("rank") != rank, F.concat(F.lit("rank "), F.col("rank"))).when(F.coalesce("kingdom", F.lit("")) != "Plantae", "not a plant").when(F.coalesce("phylum", F.lit("")) != "Tracheophyta", "not a vascular plant").when(other, "another genus")
    ok = problem.isNull()
    return j.select("name", F.when(ok, F.coalesce("acceptedUsageKey", "usageKey")).alias("key"), F.when(ok, F.coalesce("canonicalName", "name")).alias("accepted_name"), problem.alias("problem"))


def homonyms(unresolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Genera that no single match pins down: the one accepted vascular-plant genus of exactly this name, if there is one only."""
    exact = candidates.where("rank = 'GENUS' and kingdom = 'Plantae' and phylum = 'Tracheophyta' and status = 'ACCEPTED'").select(F.lower("canonicalName").alias("_l"), "key", "family").distinct()
    j = unresolved.select("name").withColumn("_l", F.lower("name")).join(exact, "_l", "left")
    n = F.count("key")
    return j.groupBy("name").agg(F.when(n == 1, F.max("key")).alias("key"), F.when(n == 0, "no accepted genus").when(n > 1, "several accepted genera").alias("problem"))
