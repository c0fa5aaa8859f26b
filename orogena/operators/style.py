"""Operators on rule tables and drawings: ladders, zoom plans, free numbers, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ported(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Codes by meaning, place by place on both ladders (meaning, code); beyond the end of theirs the last one again."""
    order = Window.partitionBy("meaning").orderBy("code")
    size = F.count("*").over(Window.partitionBy("meaning"))
    a = ours.withColumn("place", F.row_number().over(order))
    b = theirs.select("meaning", F.col("code").alias("theirs"), F.row_number().over(order).alias("at"), size.alias("n"))
    ends = b.select("meaning", "n").distinct()
    return a.join(ends, "meaning").withColumn("at", F.least("place", "n")).join(b.drop("n"), ["meaning", "at"]).select("meaning", "place", F.col("code").alias("ours"), "theirs")


def claimed(offers: DataFrame) -> DataFrame:
    """One offer for each of ours (kind, ours, code, agreement, stray, weight): most agreement, least stray, most weight, least code."""
    order = Window.partitionBy("kind", "ours").orderBy(F.desc("agreement"), "stray", F.desc("weight"), "code")
    return offers.withColumn("r", F.row_number().over(order)).withColumn("rivals", F.count("*").over(Window.partitionBy("kind", "ours")) - 1).where("r = 1").drop("r")


def free_number(used: DataFrame, first: int, last: int) -> DataFrame:
    """(lowest, highest): the lowest and the highest number of a range that no row (code) uses."""
    spark = used.sparkSession
    return spark.range(first, last + 1).select(F.col("id").alias("code")).join(used, "code", "left_anti").agg(F.min("code").alias("lowest"), F.max("code").alias("highest"))


def drawn_and_emitted(emitted: DataFrame, drawn: DataFrame) -> DataFrame:
    """(code, rules, drawings): every code of either side; the other side's count is 0."""
    a, b = emitted.groupBy("code").agg(F.count("*").alias("rules")), drawn.groupBy("code").agg(F.count("*").alias("drawings"))
    return a.join(b, "code", "full_outer").select("code", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("drawings", F.lit(0)).alias("drawings"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tag by tag the codes of two maps (tag, code): how often each has them, where the counts differ."""
    x, y = a.groupBy("tag", "code").agg(F.count("*").alias("n")), b.groupBy("tag", "code").agg(F.count("*").alias("m"))
    both = x.join(y, ["tag", "code"], "full_outer").select("tag", "code", F.coalesce("n", F.lit(0)).alias("left_n"), F.coalesce("m", F.lit(0)).alias("right_n"))
    return both.where("left_n <> right_n")


def shifted(rules: DataFrame, windows: DataFrame) -> DataFrame:
    """(rule, was, moved): rules (rule, family, was) move with the first window (family, ord, upper) that claims their family.

    moved = was + (upper - the family's coarsest), held to 10 to 24; a family without a window stays.
    """
    owner = windows.groupBy("family").agg(F.min_by("upper", "ord").alias("upper"))
    coarsest = rules.groupBy("family").agg(F.min("was").alias("coarsest"))
    moved = F.least(F.lit(24), F.greatest(F.lit(10), F.col("was") + F.col("upper") - F.col("coarsest")))
    return rules.join(coarsest, "family").join(owner, "family", "left").select("rule", "was", F.when(F.col("upper").isNull(), F.col("was")).otherwise(moved).alias("moved"))


def fitted(bands: DataFrame, ladder: list[int]) -> DataFrame:
    """Bands (id, lo, hi) with both ends at the nearest rung of a short ladder, ties to the lower."""

    def near(c: str):  # noqa: ANN202
        return F.element_at(F.array_sort(F.transform(F.array(*map(F.lit, ladder)), lambda r: F.struct(F.abs(r - F.col(c)).alias("d"), r.alias("r")))), 1)["r"]

    return bands.select("id", near("lo").alias("lo"), near("hi").alias("hi"))


def silenced(rules: DataFrame, palette: DataFrame, exempt: list[str]) -> DataFrame:
    """Rules (rule, kind, code) whose code the palette (kind, code) can't paint; exempt kinds always can."""
    return rules.where(~F.col("kind").isin(exempt)).join(palette, ["kind", "code"], "left_anti")


def hidden(rules: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, feature) with their type taken away where a name (feature) says so, and the names that meet no rule."""
    told = names.select("feature").distinct().withColumn("hide", F.lit(True))
    return rules.join(told, "feature", "left").withColumn("hide", F.coalesce("hide", F.lit(False))), told.select("feature").join(rules, "feature", "left_anti")


def ladders(levels: DataFrame) -> DataFrame:
    """(ladder, tiles): tiles (tile, level, zoom) grouped by their whole ladder of zooms."""
    own = levels.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "zoom"))), lambda x: x["zoom"]).alias("ladder"))
    return own.groupBy("ladder").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))


def findings(tiles: DataFrame, needed: list[str]) -> DataFrame:
    """(tile, missing, routable): parts (tile, ext) that a tile lacks of those needed, and whether it has NET and NOD."""
    have = tiles.groupBy("tile").agg(F.collect_set("ext").alias("have"))
    return have.select("tile", F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "have")).alias("missing"), (F.array_contains("have", "NET") & F.array_contains("have", "NOD")).alias("routable"))


def twins(rules: DataFrame, offset: int) -> DataFrame:
    """Each road rule (rule, ord, code, road) twice, the second with its code moved; others once."""
    copies = F.when(F.col("road"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rules.withColumn("twin", F.explode(copies)).select("rule", (F.col("ord") * 2 + F.col("twin")).alias("ord"), (F.col("code") + F.col("twin") * offset).alias("code"))


def substituted(rules: DataFrame, sheet: DataFrame) -> DataFrame:
    """(file, line, text): lines (file, line, text) with those that a sheet (file, old, new) names replaced.

    A line is replaced only where the sheet's old text stands exactly once in its file.
    """
    once = rules.groupBy("file", F.col("text").alias("old")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    good = sheet.join(once, ["file", "old"]).withColumnRenamed("old", "text")
    return rules.join(good, ["file", "text"], "left").select("file", "line", F.coalesce("new", "text").alias("text"))


def hideable(lines: DataFrame, categories: list[str], protected: list[str]) -> DataFrame:
    """(file, line, key, value): lines (file, line, text) that are rules which can be taken away by themselves.

    Such a rule is a single key=value of a known category that isn't protected, with a type in brackets, and sets no tags; a line that
    goes on to the next, and a comment, are none.
    """
    parts = r"^([a-z][a-z0-9_:]*) *= *([A-Za-z0-9_:.-]+)(.*)$"
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    told = lines.select("file", "line", text.alias("text")).where(~F.col("text").startswith("#") & ~F.col("text").endswith("|"))
    told = told.select("file", "line", *[F.regexp_extract("text", parts, k).alias(n) for k, n in ((1, "key"), (2, "value"), (3, "rest"))])
    at = F.instr("rest", "[0x")
    actions, digit = F.substring("rest", F.lit(1), at - 1), F.substring("rest", at + 3, F.lit(1))
    good = (F.col("key") != "") & (at > 0) & digit.rlike("^[0-9a-fA-F]$") & ~actions.contains("{set ") & ~actions.contains("{add mkgmap:")
    return told.where(good & F.col("key").isin(categories) & ~F.col("key").isin(protected)).select("file", "line", "key", "value")


def rung_spread(rules: DataFrame) -> DataFrame:
    """(family, finest, coarsest, rules): the rungs that rules (family, rung) of a family begin at; those without a rung don't count."""
    return rules.where("rung IS NOT NULL").groupBy("family").agg(F.min("rung").alias("finest"), F.max("rung").alias("coarsest"), F.count("*").alias("rules"))


#: Outcomes of matching, the better ones later: a name beats a doubt.
OUTCOMES = ["unmatched", "ambiguous", "matched"]


def best_outcomes(outcomes: DataFrame) -> DataFrame:
    """(kind, outcome, n): elements (kind, element, extract, outcome) by the best outcome that any extract gives them."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    best = outcomes.groupBy("kind", "element").agg(F.max(rank).alias("rank"))
    return best.groupBy("kind", F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("rank").cast("int")).alias("outcome")).agg(F.count("*").alias("n"))


def classed_tags(counts: DataFrame, fewest: int, stray: float) -> DataFrame:
    """(tag, built, open): whether each class is a real share of a tag, from counts (tag, built, n), of which the largest of a class counts.

    A class is real with at least ``fewest`` and a share ``stray`` of the other's, so that some strays make no class.
    """
    own = counts.groupBy("tag").agg(F.max(F.when(F.col("built"), F.col("n"))).alias("b"), F.max(F.when(~F.col("built"), F.col("n"))).alias("o"))
    b, o = F.coalesce("b", F.lit(0)), F.coalesce("o", F.lit(0))
    real = lambda x, y, name: ((x >= fewest) & (x >= stray * y)).alias(name)
    return own.select("tag", real(b, o, "built"), real(o, b, "open"))
