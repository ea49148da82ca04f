"""Recommendations at places: gates, notes, ranking with quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_fraction

# Words in a species' texts that rule planting out or ask for caution, bands of confidence.
DO_NOT_PLANT = r"(?i)\b(invasive|naturalised|naturalized|noxious)\b"
CAUTION_TOKENS = ("dieback", "disease", "canker", "blight")
CONFIDENCE = ("Looks like records", "Somewhat like records", "Weak likeness")


def do_not_plant(invasive_in: Column, *texts: Column) -> Column:
    """Invasive in any region, or said so in a text."""
    return F.coalesce(F.size(F.filter(invasive_in, lambda x: F.trim(x) != "")) > 0, F.lit(False)) | F.coalesce(F.concat_ws(" ", *texts).rlike(DO_NOT_PLANT), F.lit(False))


def confidence(p: Column, auc: Column, n_folds: Column) -> Column:
    return F.when((p >= 0.70) & (auc >= 0.85) & (n_folds >= 4), CONFIDENCE[0]).when((p >= 0.50) & (auc >= 0.75), CONFIDENCE[1]).otherwise(CONFIDENCE[2])


def future_note(p: Column, later: Column) -> Column:
    """drops or rises by whole percent, empty where nothing much changes or the match stays strong."""
    d = later - p
    pct = lambda x: F.format_string("%d%%", F.bround(x * 100).cast("int"))
    return F.when(later.isNull() | F.isnan(later), "").when((later >= 0.70) & (d >= -0.05), "").when(d <= -0.15, F.concat(F.lit("Record-likeness drops "), pct(-d), F.lit(" under 2050 BIO."))).when(d >= 0.10, F.concat(F.lit("Record-likeness rises "), pct(d), F.lit(" under 2050 BIO."))).otherwise("")


def site_filter(exclusion: Column, water: Column, snow: Column, built: Column, crop: Column, tree: Column, ndvi: Column) -> Column:
    """Struct of blocked and notes from satellite shares (fractions or percent); a missing value never blocks."""
    e, w, s, b, c, t, n = map(as_fraction, (exclusion, water, snow, built, crop, tree, ndvi))
    at = lambda v, x: F.coalesce(v >= x, F.lit(False))
    over = F.coalesce(e > 0.5, F.lit(False))
    notes = F.filter(F.array(F.when(over, F.lit("excluded")), F.when(at(w, 0.5), F.lit("water")), F.when(at(s, 0.5), F.lit("snow")), F.when(at(b, 0.4), F.lit("built-up")), F.when(at(c, 0.5), F.lit("cropland")), F.when(at(t, 0.4), F.lit("tree cover")).when(at(n, 0.6), F.lit("green"))), lambda x: x.isNotNull())
    return F.struct((over | at(w, 0.5) | at(s, 0.5)).alias("blocked"), notes.alias("notes"))


def cell_status(blocked: Column, built: Column, crop: Column) -> Column:
    return F.when(blocked, "blocked").when(as_fraction(built) >= 0.4, "city").when(as_fraction(crop) >= 0.5, "farm").otherwise("plantable")


def goal_filter(goals: Column, sun: Column, goal: str | None = None, yard: str | None = None) -> Column:
    """The goal among the species' goals; a shady yard leaves out full-sun species, a sunny one shade species, part sun none."""
    ok = F.lit(True) if goal is None else F.coalesce(F.array_contains(goals, goal), F.lit(False))
    out = {"shade": "full", "full": "shade"}.get(yard or "")
    return ok & (F.coalesce(sun != out, F.lit(True)) if out else F.lit(True))


def gated(scores: DataFrame, least: float = 0.30) -> DataFrame:
    return scores.where(F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") >= least))


def top_picks(scores: DataFrame, k: int = 5, by: Sequence[str] = ("site",)) -> DataFrame:
    """The k best by p * auc of each site among plantable species, ties in metrics order (seq)."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("p") * F.col("auc")).desc(), "seq"))
    return scores.where(~F.col("avoid")).withColumn("rank", r).where(F.col("rank") <= k)


def avoid_list(scores: DataFrame, k: int = 8, by: Sequence[str] = ("site",)) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("p").desc(), "seq"))
    return scores.where(F.col("avoid")).withColumn("rank", r).where(F.col("rank") <= k)


def importance(long: DataFrame, k: int = 5, least: float = 0.01) -> DataFrame:
    """(species, feature, gain) -> the k largest shares of each species, those of at least 1 %."""
    share = F.try_divide("gain", F.sum("gain").over(Window.partitionBy("species")))
    r = F.row_number().over(Window.partitionBy("species").orderBy(F.col("share").desc(), "feature"))
    return long.withColumn("share", share).withColumn("rank", r).where((F.col("rank") <= k) & (F.col("share") >= least))


def bucket(avoid: Column, auc: Column, occupancy: Column) -> Column:
    """invasive, well_matched (AUC unknown or at least 0.70), general (widespread) or unrankable."""
    return F.when(avoid, "invasive").when(auc.isNull() | (auc >= 0.70), "well_matched").when(occupancy >= 400, "general").otherwise("unrankable")


def quota_rank(rows: DataFrame, top: int = 5, share: int | None = None, warn: float = 75.0) -> DataFrame:
    """Picks of each site: three of five slots for well-matched species, both groups filling up what the other leaves; group invasive: those to warn of.

    Within a group: species under their own cut-off last, then by percentile. Counts never fall below zero.
    """
    top = max(1, int(top))
    want = -(-top * 3 // 5) if share is None else int(share)
    below = F.coalesce(F.col("passes") == F.lit(False), F.lit(False)).cast("int")
    r = rows.where("`group` <> 'unrankable'").withColumn("_k", F.row_number().over(Window.partitionBy("site", "group").orderBy(below, F.col("percentile").desc(), "species")))
    n = r.groupBy("site").agg(F.sum((F.col("group") == "well_matched").cast("int")).alias("_w"), F.sum((F.col("group") == "general").cast("int")).alias("_g"))
    zero = F.lit(0)
    first = F.greatest(zero, F.least(F.lit(want), F.col("_w"), F.lit(top)))
    n = n.withColumn("_ng", F.greatest(zero, F.least(top - first, F.col("_g")))).withColumn("_nw", F.greatest(zero, F.least(F.col("_w"), top - F.col("_ng"))))
    r = r.join(n, "site")
    keep = ((F.col("group") == "well_matched") & (F.col("_k") <= F.col("_nw"))) | ((F.col("group") == "general") & (F.col("_k") <= F.col("_ng")))
    picks = r.where(keep).withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy((F.col("group") != "well_matched").cast("int"), below, F.col("percentile").desc(), "species")))
    warned = r.where((F.col("group") == "invasive") & (F.col("percentile") >= warn)).withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("_k"))).where(F.col("rank") <= top)
    cols = ["site", "species", "group", "percentile", "rank"]
    return picks.select(cols).unionByName(warned.select(cols))


def describe_site(temp: Column, rain: Column, ph: Column, drain: Column, elevation: Column) -> Column:
    """A sentence of what is known of a place."""
    whole = lambda c: F.bround(c).cast("int").cast("string")
    t = F.when(temp < 5, "cold").when(temp < 12, "cool").when(temp < 18, "mild").when(temp < 24, "warm").when(temp.isNotNull(), "hot")
    r = F.when(rain < 400, "dry").when(rain < 800, "moderately wet").when(rain.isNotNull(), "wet")
    a = F.when(ph < 5.5, "acidic soil").when(ph < 7.3, "roughly neutral soil").when(ph.isNotNull(), "alkaline soil")
    d = F.when(drain < 3.5, "slow-draining ground").when(drain < 5.5, "average drainage").when(drain.isNotNull(), "well-drained ground")
    bits = F.concat_ws(", ", F.concat(t, F.lit(" (yearly average about "), whole(temp), F.lit("°C)")), F.concat(r, F.lit(" ("), whole(rain), F.lit(" mm rain/year)")), F.concat(a, F.lit(" (pH "), F.format_string("%.1f", ph), F.lit(")")), d, F.concat(F.lit("about "), whole(elevation), F.lit(" m above sea level")))
    return F.when(bits == "", "We could not read climate or soil at this pin.").otherwise(F.concat(F.lit("This location looks "), bits, F.lit(".")))


def default_common_name(species: Column, genera: dict[str, str]) -> Column:
    """Epithet in title case and the genus' English name, or the name itself for an unknown genus."""
    english = F.try_element_at(F.create_map(*[F.lit(x) for kv in genera.items() for x in kv]), F.get(F.split(species, " "), 0))
    return F.when(english.isNotNull(), F.concat_ws(" ", F.initcap(F.get(F.split(species, " "), 1)), english)).otherwise(species)


def origin(region: Column, native: Column, invasive: Column) -> Column:
    """invasive is asked before native."""
    return F.when(F.array_contains(invasive, region), "invasive").when(F.array_contains(native, region), "native").otherwise("introduced")


def country_region(country: Column, regions: dict[str, Sequence[str]]) -> Column:
    pairs = [F.lit(x) for r, cs in regions.items() for c in cs for x in (c.lower(), r)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(country)))


def cautions(text: Column, tokens: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(text), t))


def work_list(species: DataFrame, previous: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Species that still need a run: without a saved row whose file is there."""
    done = previous.where("status = 'saved'").join(artifacts.select("model_path").distinct(), "model_path", "left_semi")
    return species.join(done.select("species"), "species", "left_anti")


def incomplete(rows: DataFrame, meta: DataFrame, key: str = "species") -> DataFrame:
    """Checkpoints to reject: no meta, a number of rows other than claimed, or none."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    j = n.join(meta.select(key, "claimed"), key, "full_outer").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    why = F.when(F.col("claimed").isNull(), "no meta").when(F.col("n_rows") == 0, "empty").when(F.col("n_rows") != F.col("claimed"), "rows differ")
    return j.withColumn("reason", why).where("reason is not null").select(key, "n_rows", "claimed", "reason")


def rank_countries(rows: DataFrame, cap: int = 1000) -> DataFrame:
    """Countries by (country, species, n): species that are usable, median, capped total, share of the five largest."""
    r = rows.withColumn("_k", F.row_number().over(Window.partitionBy("country").orderBy(F.col("n").desc(), "species")))
    return r.groupBy("country").agg(F.count(F.when(F.col("n") >= 30, 1)).alias("n_usable"), F.median("n").alias("median_n"), F.sum(F.least("n", F.lit(cap))).alias("capped"), F.try_divide(F.sum(F.when(F.col("_k") <= 5, F.col("n"))), F.sum("n")).alias("top5_share"))


def reason(name: Column, p: Column, temp: Column, rain: Column, drain: Column) -> Column:
    """One sentence on how well a species suits a place."""
    climate = F.when(temp.isNull() | rain.isNull(), "your climate").when((temp >= 18) & (rain < 500), "your warm, dry climate").when(temp >= 18, "your warm climate").when(temp < 8, "your cool climate").when(rain < 450, "your relatively dry climate").otherwise("your climate")
    ground = F.when(drain >= 5.5, " and well-drained ground").when(drain < 3.5, ", though the soil here holds water").otherwise("")
    place = F.concat(climate, ground)
    return F.when(p >= 0.70, F.concat(name, F.lit(" is a strong climate-and-soil match for "), place, F.lit("."))).when(p >= 0.50, F.concat(name, F.lit(" can work in "), place, F.lit(", with some care."))).otherwise(F.concat(name, F.lit(" is only a borderline match for "), place, F.lit(".")))
