"""Background points: target-group, uniform and effort-weighted sampling, by hash-derived uniforms so that runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hashed_uniform, weighted_key


def sample_rows(df: DataFrame, n: int, key: str = "rid") -> DataFrame:
    """n rows without replacement by the smallest hashed keys; input order is the key's."""
    return df.orderBy(hashed_uniform(F.col(key)), key).limit(n).orderBy(key)


#: Stretches of the hashed uniforms, by which ranks are cut, for each halving of it: a species reads a twentieth more than it needs.
STEPS = 16
#: Rows of a stretch are dealt over so many keys when species read them.
SALTS = 32


def target_group(occ: DataFrame, most: int = 25_000) -> DataFrame:
    """For each species, records of other species outside its presence cells, duplicates kept: as many as it has presence cells, at most ``most``.

    Every record draws a hashed uniform of its own, and a species takes those with the smallest. Counts by stretches of it, less those of the species' own cells, tell how far a species has to read
    to find what it wants; it is joined with the records of these stretches only. Stretches are parts of a halving, so they shorten towards zero: what is read follows from what
    is wanted, not from the table, of which there are a few hundred stretches whatever its size. Species meet a stretch's rows salted, as all read the first ones.
    """
    drawn = occ.select("rid", "cell_id", hashed_uniform(F.col("rid")).alias("u")).withColumn("b", F.floor(F.log2("u") * STEPS).cast("int"))
    presence = occ.select("species", "cell_id").distinct()
    wanted = presence.groupBy("species").agg(F.count("*").alias("n")).select("species", F.least("n", F.lit(most)).alias("n"))
    whole = drawn.groupBy("b").agg(F.count("*").alias("c"))  # a row for each stretch that holds any
    by_cell = drawn.groupBy("cell_id", "b").agg(F.count("*").alias("c"))
    own = presence.join(by_cell, "cell_id").groupBy("species", "b").agg(F.sum("c").alias("own"))
    free = wanted.join(F.broadcast(whole.agg(F.collect_list(F.struct("b", "c")).alias("whole")))).select("species", "n", F.inline("whole"))
    upto = F.sum(F.col("c") - F.coalesce("own", F.lit(0))).over(Window.partitionBy("species").orderBy("b"))
    free = free.join(own, ["species", "b"], "left")
    reach = free.withColumn("before", upto - (F.col("c") - F.coalesce("own", F.lit(0)))).where("before < n").select("species", "n", "b", F.pmod(F.xxhash64("species"), F.lit(SALTS)).alias("salt"))
    last = F.broadcast(reach.agg(F.max("b").alias("last")))  # one row: what no species reads isn't dealt out
    read = drawn.join(last, F.col("b") <= F.col("last")).drop("last").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    cand = read.join(reach, ["b", "salt"]).join(presence, ["species", "cell_id"], "left_anti")
    pick = cand.withColumn("j", F.row_number().over(Window.partitionBy("species").orderBy("u", "rid"))).where("j <= n")
    return pick.select("species", "rid", "cell_id")


def anti_presence(pool: DataFrame, presence: DataFrame, species: str) -> DataFrame:
    """Rows of the pool outside the species' cells, duplicates kept."""
    return pool.join(presence.where(F.col("species") == species).select("cell_id"), "cell_id", "left_anti")


def padded_pool(cells: DataFrame, presence: DataFrame, need: int, pads: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """Cells without presence in the padded box of the presence points (latitude, longitude): the smallest pad that has enough, else the largest."""
    box = presence.agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    free = cells.join(presence.select("cell_id").distinct(), "cell_id", "left_anti").join(F.broadcast(box))  # one row
    inside = lambda p: F.col("latitude").between(F.col("s") - p, F.col("n") + p) & F.col("longitude").between(F.col("w") - p, F.col("e") + p)
    free = free.withColumn("pad", F.coalesce(*[F.when(inside(p), F.lit(p)) for p in pads])).where("pad is not null").drop("s", "n", "w", "e")
    per = free.groupBy("pad").agg(F.count("*").alias("c"))
    per = per.withColumn("upto", F.sum("c").over(Window.orderBy("pad")))
    chosen = per.agg(F.coalesce(F.min(F.when(F.col("upto") >= need, F.col("pad"))), F.max("pad")).alias("chosen"))
    return free.join(F.broadcast(chosen), F.col("pad") <= F.col("chosen")).drop("chosen")


def effort_weights(effort: DataFrame, power: float = 1.0, column: str = "effort") -> DataFrame:
    """weight = (effort + floor)^power, the floor a twentieth of the median of positive efforts."""
    floor = effort.agg((F.median(F.when(F.col(column) > 0, F.col(column))) / 20).alias("floor"))
    return effort.join(F.broadcast(floor)).withColumn("weight", F.pow(F.col(column) + F.coalesce("floor", F.lit(0.0)), F.lit(power))).drop("floor")


def weighted_without(df: DataFrame, n: int, key: str = "cell_id", weight: str = "weight", u: Column | None = None) -> DataFrame:
    """n rows by the exponential race: one pass and a top-n."""
    k = weighted_key(hashed_uniform(F.col(key)) if u is None else u, F.col(weight))
    return df.withColumn("_k", k).where("_k is not null").orderBy("_k", key).limit(n).drop("_k")


def weighted_with(df: DataFrame, n: int, key: str = "cell_id", weight: str = "weight") -> DataFrame:
    """n draws with replacement: each row owns a stretch of the cumulated weight, systematic draws fall into it; times = draws of a row."""
    share = running_sum(df.where(F.col(weight) > 0), weight, key)
    total = share.agg(F.sum(weight).alias("_total"))
    share = share.join(F.broadcast(total)).withColumns({"_b": F.round(F.col("_upto") / F.col("_total") * n, 9), "_a": F.round((F.col("_upto") - F.col(weight)) / F.col("_total") * n, 9)})
    times = (F.floor(F.col("_b") + 0.5) - F.floor(F.col("_a") + 0.5)).cast("int")
    return share.withColumn("times", times).where("times > 0").drop("_a", "_b", "_upto", "_total")


def running_sum(df: DataFrame, value: str, key: str, parts: int = 1000, out: str = "_upto") -> DataFrame:
    """df with the sum of value over all rows up to this one by a number key (ties together): sums of ranges of the key first, then within a range. No window holds more than a range."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    ends = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("_part", F.size(F.filter(ends, lambda e: e < F.col(key))) if cuts else F.lit(0))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each range
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn(out, within).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def choose_source(distinct_file_cells: int, presence_cells: int, has_effort: bool) -> str:
    """file if it has half as many distinct cells as there are presence cells, else effort if there is any, else uniform."""
    if distinct_file_cells and distinct_file_cells >= 0.5 * presence_cells:
        return "file"
    return "effort" if has_effort else "uniform"


def stratified_share(df: DataFrame, per_group: int, group: str = "species", stratum: str = "stratum", order: str = "rid") -> DataFrame:
    """per_group rows of each group: equal shares of its strata first, then a top-up in order over what is left."""
    n = df.select(group, stratum).distinct().groupBy(group).agg(F.count("*").alias("_s"))
    r = df.join(n, group).withColumn("_k", F.row_number().over(Window.partitionBy(group, stratum).orderBy(order)))
    r = r.withColumn("_first", F.col("_k") <= F.ceil(F.lit(per_group) / F.col("_s")))
    return r.withColumn("_j", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_first").desc(), order))).where(F.col("_j") <= per_group).drop("_s", "_k", "_first", "_j")
