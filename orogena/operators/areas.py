"""Corrections of tiles once they are cut: halving those that failed, moving round borders, ground across 180 degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogena.functions.units import CELL_BITS

#: Units of a grid cell, borders that show as seams, map units of half a turn, and cells of an empty stretch that divides.
GRAIN, ROUND, HALF_TURN, GAP = 1 << CELL_BITS, 1 << 16, 1 << 23, 16
SIDES = ("min_lat", "min_lon", "max_lat", "max_lon")


def refined(areas: DataFrame, failed: DataFrame) -> DataFrame:
    """(tile, part, min_lat, ...): areas (tile, min_lat, ...) of which those in ``failed`` (tile) are halved along their longer side.

    The cut is the middle held to the grid; an area that would leave a half without a cell stays whole, as part 0.
    """
    told = areas.join(failed.select("tile").distinct().withColumn("_failed", F.lit(True)), "tile", "left")
    tall = (F.col("max_lat") - F.col("min_lat")) >= (F.col("max_lon") - F.col("min_lon"))
    low, high = F.when(tall, F.col("min_lat")).otherwise(F.col("min_lon")), F.when(tall, F.col("max_lat")).otherwise(F.col("max_lon"))
    cut = F.shiftleft(F.shiftright((low + F.floor((high - low) / 2)).cast("int"), CELL_BITS), CELL_BITS)
    halves = F.col("_failed").isNotNull() & (cut > low) & (cut < high)
    end = lambda c, axis: F.when(tall if axis == "lat" else ~tall, cut).otherwise(F.col(c)).alias(c)
    lower = F.struct(F.lit(0).alias("part"), "min_lat", "min_lon", end("max_lat", "lat"), end("max_lon", "lon"))
    upper = F.struct(F.lit(1).alias("part"), end("min_lat", "lat"), end("min_lon", "lon"), "max_lat", "max_lon")
    whole = F.struct(F.lit(0).alias("part"), *SIDES)
    return told.select("tile", F.explode(F.when(halves, F.array(lower, upper)).otherwise(F.array(whole))).alias("a")).select("tile", "a.*")


def _covered(cover: DataFrame, spans: DataFrame) -> DataFrame:
    """The values of which every span (value, lo, hi) lies in the union of the value's covering spans."""
    order = Window.partitionBy("value").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = cover.withColumn("_new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = runs.groupBy("value", "_run").agg(F.min("lo").alias("c_lo"), F.max("hi").alias("c_hi"))
    met = spans.join(runs, "value", "left").groupBy("value", "lo", "hi").agg(F.bool_or((F.col("c_lo") <= F.col("lo")) & (F.col("c_hi") >= F.col("hi"))).alias("held"))
    return met.groupBy("value").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held")).where("held").select("value")


def _steps(areas: DataFrame, axis: str, stride: int) -> DataFrame:
    """(value, step): how far each round border shared by two areas moves along an axis, if it can."""
    other = "lon" if axis == "lat" else "lat"
    told = areas.select(F.col(f"min_{axis}").alias("low"), F.col(f"max_{axis}").alias("high"), F.col(f"min_{other}").alias("lo"), F.col(f"max_{other}").alias("hi"))
    round_ = lambda c: (F.col(c) != 0) & (F.col(c) % stride == 0)
    starting, ending = told.where(round_("low")).withColumnRenamed("low", "value"), told.where(round_("high")).withColumnRenamed("high", "value")
    both = starting.select("value").intersect(ending.select("value"))
    starting, ending = starting.join(both, "value"), ending.join(both, "value")
    tall = starting.groupBy("value").agg(F.bool_and(F.col("high") - F.col("value") > GRAIN).alias("ok")).where("ok").select("value")
    deep = ending.groupBy("value").agg(F.bool_and(F.col("value") - F.col("low") > GRAIN).alias("ok")).where("ok").select("value")
    spans = lambda df: df.select("value", "lo", "hi")
    up = tall.intersect(_covered(spans(ending), spans(starting)))
    down = deep.intersect(_covered(spans(starting), spans(ending))).subtract(up)
    return up.select("value", F.lit(GRAIN).alias("step")).unionByName(down.select("value", F.lit(-GRAIN).alias("step")))


def nudged(areas: DataFrame, stride: int = ROUND) -> DataFrame:
    """Areas (tile, min_lat, ...) whose shared borders on multiples of ``stride`` moved by a cell, so that no ground is lost or held twice.

    A border moves up where all that start on it are taller than a cell and what ends on it covers the strip given away; else
    down on the same terms; else not at all.  A border moves as one value for all areas.
    """
    out = areas
    for axis in ("lat", "lon"):
        steps = _steps(areas, axis, stride)
        for side in (f"min_{axis}", f"max_{axis}"):
            to = steps.select(F.col("value").alias(side), F.col("step").alias("_step"))
            out = out.join(to, side, "left").withColumn(side, (F.col(side) + F.coalesce("_step", F.lit(0))).cast("int")).drop("_step")
    return out.select(*areas.columns)


def ground(cells: DataFrame, gap: int = GAP) -> DataFrame:
    """(part, min_cy, min_cx, max_cy, max_cx): where cutting starts, from occupied cells (cy, cx): one box, or the two sides of 180 degrees.

    Two where the widest empty stretch of columns inside the box is wider than that through 180 degrees; each then runs on to 180 degrees,
    unless the stretch there is a divide itself.  Bounds are half-open; no cells have no ground.
    """
    seam = HALF_TURN >> CELL_BITS
    columns = cells.groupBy("cx").agg(F.min("cy").alias("lo"), F.max("cy").alias("hi"))
    # the columns' gaps, found within ranges of columns first, so that no task sorts more than one range and the ranges' edges
    block = F.shiftright("cx", 8)
    within = Window.partitionBy("_b").orderBy("cx")
    told = columns.withColumn("_b", block).withColumn("next", F.lead("cx").over(within))
    inner = told.where("next IS NOT NULL").select(F.col("cx").alias("at"), (F.col("next") - F.col("cx") - 1).alias("run"))
    ends = told.groupBy("_b").agg(F.min("cx").alias("first"), F.max("cx").alias("last")).withColumn("next", F.lead("first").over(Window.orderBy("_b")))  # 32 blocks at most
    between = ends.where("next IS NOT NULL").select(F.col("last").alias("at"), (F.col("next") - F.col("last") - 1).alias("run"))
    widest = inner.unionByName(between).where("run > 0").agg(F.max("run").alias("run"), F.min_by("at", F.struct(-F.col("run"), F.col("at"))).alias("at"))
    box = columns.agg(F.min("lo").alias("y0"), (F.max("hi") + 1).alias("y1"), F.min("cx").alias("x0"), (F.max("cx") + 1).alias("x1")).where("x0 IS NOT NULL")
    outside = (F.lit(seam) - F.col("x1")) + (F.col("x0") + seam)
    on = box.join(F.broadcast(widest)).withColumn("out", outside)  # a row each
    divided = F.coalesce(F.col("run") > F.col("out"), F.lit(False))
    part = lambda k, x0, x1: F.struct(F.lit(k).alias("part"), F.col("y0").cast("int").alias("min_cy"), x0.cast("int").alias("min_cx"), F.col("y1").cast("int").alias("max_cy"), x1.cast("int").alias("max_cx"))
    onward = F.col("out") < gap
    west = part(0, F.when(onward, -seam).otherwise(F.col("x0")), F.col("at") + 1)
    east = part(1, F.col("at") + 1 + F.col("run"), F.when(onward, seam).otherwise(F.col("x1")))
    return on.select(F.explode(F.when(divided, F.array(west, east)).otherwise(F.array(part(0, F.col("x0"), F.col("x1"))))).alias("g")).select("g.*")


def near_side(lon: Column, centre: Column) -> Column:
    """A longitude in degrees continued past 180 where that is nearer to ``centre``."""
    away = lon - centre
    return F.when(away > 180, lon - 360).when(away < -180, lon + 360).otherwise(lon)
