"""Running sums and medians of many groups of which one may hold most rows: no window, buffer or sort holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group's values are cut into so many stretches.
STRETCHES = 64
#: Ranks of the sketches are right to within a part of it, ...
ACCURACY = 2000
#: ... so a bracket of so many parts on both sides of the middle holds it.
MARGIN = 4


def running_by_key(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """df, a row for each value of ``order`` within its keys, with upto_<c>, the sum of c over the key's rows up to this one, and all_<c>, over all of them.

    Two levels: stretches of a key's values, cut by a sketch, are summed as wholes and run over as such (STRETCHES rows a key); within a stretch a window runs over its rows only. Null keys are groups.
    """
    if not keys:
        raise ValueError("one key at least")
    cuts = F.percentile_approx(order, F.array(*(F.lit(i / STRETCHES) for i in range(1, STRETCHES))), ACCURACY)
    own = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    gone = [f"_k{i}" for i in range(len(keys))]

    def joined(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        for c in own:
            on = on & c
        return left.join(right, on).drop(*gone)

    of_key = df.groupBy(*renamed).agg(cuts.alias("_cuts"))
    at = joined(df, of_key, F.lit(True)).withColumn("_stretch", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    sums = at.groupBy(*renamed, F.col("_stretch").alias("_of")).agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before, whole = Window.partitionBy(*gone).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*gone)
    sums = sums.select(*gone, "_of", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in columns))
    within = Window.partitionBy(*keys, "_stretch").orderBy(order)
    ran = at.withColumns({f"_upto_{c}": F.sum(c).over(within) for c in columns})
    out = joined(ran, sums, F.col("_stretch") == F.col("_of"))
    return out.withColumns({f"upto_{c}": F.col(f"_upto_{c}") + F.col(f"_before_{c}") for c in columns}).drop("_stretch", "_of", *(f"_{s}_{c}" for s in ("upto", "before") for c in columns))


def group_medians(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns, n): exact medians of each key's values, the mean of the middle two for even numbers, nulls left out; n: the key's rows. Rows of a null key are left out.

    A sketch of bounded size brackets the middle; a second look at the rows counts what is below the bracket and each distinct value within, combined before the shuffle; the middle is read off a
    running count over the bracket, some parts in a thousand of the key's values. A middle outside of its bracket would be an error, never a wrong number.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    sides = F.array(F.lit(0.5 - MARGIN / ACCURACY), F.lit(0.5 + MARGIN / ACCURACY))
    about = rows.groupBy("_key").agg(F.count("*").alias("n"), *(x for i in range(len(columns)) for x in (F.count(f"_{i}").alias(f"_n{i}"), F.percentile_approx(f"_{i}", sides, ACCURACY).alias(f"_b{i}"))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_{i}").alias("v"), F.col(f"_b{i}").alias("b"), F.col(f"_n{i}").alias("n")) for i in range(len(columns)))))
    values = rows.join(about, "_key").select("_key", each.alias("x")).where("x.v <= x.b[1]")
    counts = values.groupBy("_key", "x.i", "x.n", F.expr("if(x.v >= x.b[0], x.v, null)").alias("v")).agg(F.count("*").alias("c"))  # null: below the bracket
    upto = F.sum("c").over(Window.partitionBy("_key", "i").orderBy(F.col("v").asc_nulls_first()))
    met = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    missed = F.raise_error(F.lit("the middle is not in its bracket")).cast("double")
    at = lambda i, rank: F.max(F.when((F.col("i") == i) & F.expr(f"before <= {rank} and {rank} < upto"), F.coalesce("v", missed)))
    middle = met.groupBy("_key").agg(*((at(i, "(n - 1) div 2") / 2 + at(i, "n div 2") / 2).alias(f"_m{i}") for i in range(len(columns))))
    return about.select("_key", "n").join(middle, "_key", "left").select(F.col("_key").alias(key), *(F.col(f"_m{i}").alias(c) for i, c in enumerate(columns)), "n")
