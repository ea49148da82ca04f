"""Recommendations at pins as one plan: envelope, sampling, gates, scores now and later, notes, picks and what to avoid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import recommend as R
from ..operators.score import Booster
from .guards import layer_gate


def score_all(rows: DataFrame, models: dict[str, Booster], features: Sequence[str], keep: Sequence[str], out: str = "p") -> DataFrame:
    """rows times models: (keep.., species, out), the models sent once. All models take the same features in the same order."""
    if any(list(m.features) != list(features) for m in models.values()):
        raise ValueError("the features aren't those of the models, in their order")
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(features))])
            p = np.column_stack([m.predict(x) for m in shared.value.values()])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(list(p), pa.list_(pa.float64()))], names=[*keep, "_p"])

    src = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    scored = src.mapInArrow(run, f"{kinds}, _p array<double>").select(*keep, F.posexplode("_p").alias("_i", out))
    return scored.select(*keep, F.element_at(F.array(*[F.lit(n) for n in models]), F.col("_i") + 1).alias("species"), out)


def recommend(
    pins: DataFrame, cells: DataFrame, grid: Grid, models: dict[str, Booster], traits: DataFrame, features: Sequence[str], later: dict[str, str],
    envelope: tuple[float, float, float, float], needed: Sequence[str], most_missing: int = 15, goal: str | None = None, sun: str | None = None, top: int = 5, avoid: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(lists, refused) for pins (site, latitude, longitude).

    lists: site, list (picks or avoid), rank, species, p, p_later, note, confidence. refused: site and why no list can be made: outside of the envelope, or layers missing.
    traits has species, seq, auc, n_folds, goals, sun, avoid; later names, for features that change, the column of cells with their later value: a null there leaves p_later null.
    """
    west, south, east, north = envelope
    inside = F.coalesce(F.col("latitude").between(south, north) & F.col("longitude").between(west, east), F.lit(False))
    keyed = pins.select("site", "latitude", "longitude", grid.row(F.col("latitude")).alias("grid_row"), grid.col(F.col("longitude")).alias("grid_col"), inside.alias("_inside"))
    columns = list(dict.fromkeys([*features, *later.values()]))
    at = keyed.join(cells.select("grid_row", "grid_col", *columns), ["grid_row", "grid_col"], "left")
    at = at.withColumn("problem", F.when(~F.col("_inside"), F.lit("outside of the area")).otherwise(layer_gate(needed, features, most_missing)))
    refused = at.where("problem is not null").select("site", "problem")

    fine = at.where("problem is null")
    now = score_all(fine, models, features, ["site"])
    known = F.lit(True)
    for c in later.values():
        known = known & F.col(c).isNotNull()
    then = score_all(fine.where(known).select("site", *[F.col(later.get(f, f)).alias(f) for f in features]), models, features, ["site"], "p_later")
    rows = now.join(F.broadcast(traits), "species").where(R.goal_filter(F.col("goals"), F.col("sun"), goal, sun))  # a row for each species
    rows = R.gated(rows).join(then, ["site", "species"], "left")
    rows = rows.withColumns({"note": R.future_note(F.col("p"), F.col("p_later")), "confidence": R.confidence(F.col("p"), F.col("auc"), F.col("n_folds"))})
    cols = ["site", "list", "rank", "species", "p", "p_later", "note", "confidence"]
    lists = R.top_picks(rows, top).withColumn("list", F.lit("picks")).unionByName(R.avoid_list(rows, avoid).withColumn("list", F.lit("avoid")))
    return lists.select(cols), refused
