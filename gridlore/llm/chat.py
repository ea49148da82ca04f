"""Quotation linking: quotes in messages are parsed, tied to the messages they come from, and removed.

A line's quote level is the number of ``>`` signs before it; lines of one level in a row are a segment. Segments of level 0 are the message's own
text, without a last line that only introduces a quote ("On ... wrote:"). Quoted segments and their lines are normalised (lower case, single blanks), hashed
(MD5 of the text) and looked up among the hashes of the own texts, own paragraphs and own lines of earlier turns in the conversation; of several
messages with one passage the latest before the reply counts. A message replies to the message that most hashes of its segments of level 1 name, of equals the latest; without such a
link, to the message before it. Deeper segments are what the answered message quoted itself: they are linked and counted, and never decide.

Replies make a tree of each conversation. Its messages come out in reply order (preorder): a message, the replies to it in turn order, each with all that hangs on it.
Messages that follow each other without a link elsewhere are a run; only runs that branch off are placed, so a conversation without links costs nothing: pointer doubling
gives the size of each run's tree, sums over siblings and along the way give its place. Every row keeps its size, however long the way.

All is DataFrame functions. Conversations are sorted in ranges of (conversation, turn), so a very long one is spread over tasks; numbers that run over them are summed by
partition first. A line that very many messages of one conversation hold is looked up by ranges of turns, too.

Defined results: a null text is empty; messages with a null conversation are kept, each by itself, without links; a null turn is never linked and comes first; equal turns are
ordered by role, then text; repeated rows stay; a message that is all quotes has an empty text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_spread, shuffles_for, stage, unstage

QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)+)"
INTRODUCES = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _hashes(texts: Column) -> Column:
    """Distinct hashes of the texts that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normal), lambda t: t != ""), F.md5))


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with own (text without quotes) and segments, an array of (level, text) of the quotes."""
    m = messages.withColumn("_line", F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n", -1))
    m = m.withColumn("_level", F.transform("_line", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", ""))))
    m = m.withColumn("_plain", F.transform("_line", lambda x: F.regexp_replace(x, QUOTE, "")))
    places = F.sequence(F.lit(1), F.size("_line"))
    m = m.withColumn("_start", F.filter(places, lambda i: (i == 1) | (F.get("_level", i - 1) != F.get("_level", i - 2))))
    end = lambda k: F.coalesce(F.get("_start", k + 1) - 1, F.size("_line"))
    seg = F.transform("_start", lambda s, k: F.struct(F.get("_level", s - 1).alias("level"), s.alias("s"), end(k).alias("e")))
    m = m.withColumn("_seg", seg)

    def own(x):
        # a line that introduces the quote after it goes
        last = F.when((x["e"] < F.size("_line")) & F.get("_plain", x["e"] - 1).rlike(INTRODUCES), x["e"] - 1).otherwise(x["e"])
        return F.array_join(F.slice("_plain", x["s"], F.greatest(last - x["s"] + 1, F.lit(0))), "\n")

    m = m.withColumn("own", F.trim(F.array_join(F.transform(F.filter("_seg", lambda x: x["level"] == 0), own), "\n"), F.lit(" \n\t")))
    text = lambda x: F.array_join(F.slice("_plain", x["s"], x["e"] - x["s"] + 1), "\n")
    m = m.withColumn("segments", F.transform(F.filter("_seg", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), text(x).alias("text"))))
    return m.drop("_line", "_level", "_plain", "_start", "_seg")


def _running(df: DataFrame, order: str, **exprs: Column) -> DataFrame:
    """df (part, ..), sorted by order over its parts, with each expr's maximum from the first row to this one; a window is one part, parts are joined by a row of each."""
    own = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy("part").agg(*[F.max(e).alias(k) for k, e in exprs.items()])
    ends = ends.select("part", *[F.max(k).over(earlier).alias(f"{k}_before") for k in exprs])
    df = df.withColumns({k: F.max(e).over(own) for k, e in exprs.items()}).join(F.broadcast(ends), "part")
    return df.withColumns({k: F.greatest(k, f"{k}_before") for k in exprs}).drop(*[f"{k}_before" for k in exprs])


def _linked(placed: DataFrame) -> DataFrame:
    """(g, to, n_linked, n_deeper) of the messages with links; to: turn and g of the message that is answered."""
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    units = lambda deep: F.flatten(F.transform(F.filter("segments", lambda s: (s["level"] > 1) == F.lit(deep)), lambda s: F.concat(F.array(s["text"]), F.split(s["text"], "\n"))))
    tagged = lambda deep: F.transform(_hashes(units(deep)), lambda h: F.struct(F.lit(deep).alias("deep"), h.alias("hash")))
    both = F.concat(tagged(False), tagged(True))
    quoted = placed.where((F.size("segments") > 0) & known)
    asked = quoted.select("conv_id", "turn", "range", "g", F.inline(both))
    own = F.concat(F.array("text"), F.split("text", r"\n\s*\n"), F.split("text", "\n"))
    convs = stage(placed.where(known).groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.size("segments")).alias("quotes")).where("quotes > 0").drop("quotes"), "quoting")
    said = join_spread(placed.where((F.col("text") != "") & known), convs, "conv_id", convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    said = said.select("conv_id", "turn", "range", "g", F.explode(_hashes(own)).alias("hash"))
    said = said.groupBy("conv_id", "hash", "range", "turn").agg(F.max("g").alias("source"))
    rows = asked.withColumn("source", F.lit(None).cast("long")).unionByName(said.withColumns({"g": F.lit(None).cast("long"), "deep": F.lit(None).cast("boolean")}))
    # the latest earlier turn with the passage: of the same range of turns, else of the ranges before
    at = F.when(F.col("source").isNotNull(), F.struct("turn", F.col("source").alias("g")))
    within = Window.partitionBy("conv_id", "hash", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = stage(rows.withColumn("here", F.max(at).over(within)).withColumn("at", at), "passages")
    before = Window.partitionBy("conv_id", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = rows.groupBy("conv_id", "hash", "range").agg(F.max("at").alias("last")).withColumn("there", F.max("last").over(before)).where("there is not null").drop("last")
    found = rows.where("g is not null").join(ends, ["conv_id", "hash", "range"], "left").select("g", "deep", F.coalesce("here", "there").alias("to")).where("to is not null")
    votes = found.groupBy("g", "to").agg(F.count_if(~F.col("deep")).alias("n"), F.count_if("deep").alias("n_deep"))
    best = votes.groupBy("g").agg(F.max(F.when(F.col("n") > 0, F.struct("n", "to"))).alias("best"), F.sum("n").alias("n_linked"), F.sum("n_deep").alias("n_deeper"))
    return best.select("g", F.col("best.to").alias("to"), "n_linked", "n_deeper")


def _doubled(cur: DataFrame, name: str, below: bool) -> DataFrame:
    """cur (head, anc, val, up): sums over a forest by pointer doubling, anc being the run above or null for a root's children. Every row stays of constant size.

    up becomes its sum along the way to the root. val becomes its sum over all runs below, the run's own included, or, if not below, along the way as well: a run with 2^k runs
    summed takes over what the run that many places away has.
    """
    while total := cur.where("anc is not null").count():
        moving = cur.where("anc is not null")
        wanted = moving.groupBy("anc").agg(F.count("*").alias("n"), F.sum("val").alias("more_below"))
        above = stage(wanted.join(cur.select(F.col("head").alias("anc"), F.col("anc").alias("next"), F.col("val").alias("more"), F.col("up").alias("higher")), "anc"), "above")
        moved = join_spread(moving, above.drop("more_below"), "anc", total)
        val = F.col("val") if below else F.col("val") + F.col("more")
        rows = moved.select("head", F.col("next").alias("anc"), val.alias("val"), (F.col("up") + F.col("higher")).alias("up")).unionByName(cur.where("anc is null"))
        if below:
            rows = rows.join(above.select(F.col("anc").alias("head"), "more_below"), "head", "left").withColumn("val", F.col("val") + F.coalesce("more_below", F.lit(0))).drop("more_below")
        done, cur = cur, stage(rows, name)
        unstage(done, above)
    return cur


def _branches(messages: DataFrame) -> DataFrame:
    """messages (g, head, parent), parent null or elsewhere only in heads of runs -> (head, start, up): the place in reply order, over all conversations, and the depth of each run's head.

    A run stands before the runs that hang on it, those of its later messages first. So it starts behind the run that it hangs on and the whole
    trees of the siblings before it: an Euler tour from the sizes of the trees.
    """
    runs = stage(messages.groupBy("head").agg(F.count("*").alias("size"), F.max("parent").alias("parent")), "runs")
    off = runs.where("parent is not null")
    wanted = off.groupBy(F.col("parent").alias("g")).agg(F.count("*").alias("n"))
    of_parent = stage(messages.select("g", F.col("head").alias("on")).join(wanted, "g").withColumnRenamed("g", "parent"), "parents")
    hung = stage(join_spread(off, of_parent, "parent", off.count()), "hung")  # head, size, parent, on: the run that the parent is in
    n = hung.count()
    with shuffles_for(messages.sparkSession, n):
        tops = stage(hung.groupBy("on").agg(F.count("*").alias("n")).join(runs.select(F.col("head").alias("on"), F.col("size").alias("length"), F.col("parent").isNull().alias("top")), "on"), "tops")
        hung = stage(join_spread(hung, tops, "on", n), "hung")
        anc = F.when(~F.col("top"), F.col("on"))
        step = F.col("parent") - F.col("on") + 1
        trees = _doubled(stage(hung.select("head", anc.alias("anc"), F.col("size").alias("val"), F.lit(0).cast("long").alias("up")), "trees"), "trees", True)
        # sizes of trees summed over all siblings in their order; what was summed before the first of a run's is taken off
        order = [F.col("on"), F.col("parent").desc(), F.col("head")]
        placed = hung.join(trees.select("head", "val"), "head").repartitionByRange(*order).sortWithinPartitions(*order)
        placed = stage(placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "head", "on", "length", "val", anc.alias("anc"), step.alias("up")), "siblings")
        parts = placed.groupBy("part").agg(F.sum("val").alias("n"))  # a row for each partition
        parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
        so_far = F.sum("val").over(Window.partitionBy("part").orderBy("row")) - F.col("val")
        placed = stage(placed.withColumn("so_far", so_far).join(F.broadcast(parts), "part").withColumn("so_far", F.col("so_far") + F.col("earlier")), "siblings")
        first = stage(placed.groupBy("on").agg(F.min("so_far").alias("first"), F.count("*").alias("n")), "first")
        shift = F.col("length") + F.col("so_far") - F.col("first") + F.when(F.col("anc").isNull(), F.col("on")).otherwise(0)  # a run without parent starts at its own place
        steps = stage(join_spread(placed, first, "on", n).select("head", "anc", shift.alias("val"), "up"), "starts")
        starts = _doubled(steps, "starts", False)
    out = runs.join(starts.select("head", F.col("val"), "up"), "head", "left")
    return stage(out.select("head", F.coalesce("val", "head").alias("start"), F.coalesce("up", F.lit(0)).alias("up"), F.col("size").alias("n")), "places")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message: conv_id, position (place in reply order: none comes before what it replies to), turn, role, text without quotes, reply_to (turn of the
    message it replies to), root (turn of the conversation's first message), depth (replies from there), n_quotes (segments), n_linked and n_deeper (linked passages of level 1 and deeper)."""
    src = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("raw"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "raw")]
    parsed = parse(src.repartitionByRange(*order).sortWithinPartitions(*order), "raw")
    parsed = stage(parsed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", F.col("own").alias("text"), "segments"), "messages")

    # places: rows before the partition, and its first row's neighbour
    sizes = parsed.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max_by(F.struct("conv_id", "turn"), "row").alias("last"))  # a row for each partition
    by_part = Window.orderBy("part")
    sizes = sizes.select("part", (F.sum("n").over(by_part) - F.col("n") - F.col("first")).alias("shift"), F.lag("last").over(by_part).alias("neighbour"))
    placed = parsed.join(F.broadcast(sizes), "part").withColumn("g", F.col("row") + F.col("shift"))
    before = F.coalesce(F.lag(F.struct("conv_id", "turn")).over(Window.partitionBy("part").orderBy("row")), "neighbour")
    placed = placed.withColumn("before", before)
    starts = F.col("before").isNull() | ~F.col("before.conv_id").eqNullSafe(F.col("conv_id"))
    turns = starts | ~F.col("before.turn").eqNullSafe(F.col("turn"))
    placed = placed.withColumns({"starts": starts, "of": F.when(turns, F.struct("g", "part"))})
    placed = _running(placed, "g", turn_start=F.col("of"), conv_start=F.when(F.col("starts"), F.struct("g", "turn")))
    # equal turns of a conversation share a range: the partition of the first of them
    placed = stage(placed.select("part", "g", "conv_id", "turn", "role", "text", "segments", "before", "starts", F.col("turn_start.part").alias("range"), F.col("conv_start.g").alias("g0"), F.col("conv_start.turn").alias("root")), "placed")

    joined = placed.join(_linked(placed), "g", "left").withColumn("alone", F.col("starts") | F.col("conv_id").isNull())
    elsewhere = F.col("to").isNotNull() & (F.col("to.g") != F.col("g") - 1)
    joined = _running(joined.withColumn("elsewhere", elsewhere), "g", head=F.when(F.col("alone") | F.col("elsewhere"), F.col("g")))
    reply_to = F.when(~F.col("alone"), F.coalesce("to.turn", "before.turn"))
    out = stage(joined.select("g", "g0", "head", F.when(F.col("elsewhere"), F.col("to.g")).alias("parent"), "conv_id", "turn", "role", "text", reply_to.alias("reply_to"), F.when(F.col("conv_id").isNull(), F.col("turn")).otherwise(F.col("root")).alias("root"), F.size("segments").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_deeper", F.lit(0)).alias("n_deeper")), "linked")
    if out.where("parent is not null").isEmpty():
        out = out.withColumns({"position": F.col("g") - F.col("g0"), "depth": F.col("g") - F.col("head")})
    else:
        out = join_spread(out, _branches(out), "head", out.count()).withColumns({"position": F.col("start") + F.col("g") - F.col("head") - F.col("g0"), "depth": F.col("up") + F.col("g") - F.col("head")})
    return out.select("conv_id", "position", "turn", "role", "text", "reply_to", "root", "depth", "n_quotes", "n_linked", "n_deeper")
