"""Changes applied to ways and rules, names chosen for code pages, contours as ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogena.storage import written


def rewritten(refs: DataFrame, merges: DataFrame, inserts: DataFrame, routable: DataFrame) -> DataFrame:
    """(way_id, refs): references with merges (id, into) followed on routable ways (way_id) and nodes inserted.

    Inserts (way_id, after_pos, node_id) stand behind the reference at that place, in order of node. A reference that
    merging makes equal to its predecessor goes.
    """
    told = refs.join(routable.withColumn("road", F.lit(True)), "way_id", "left").join(merges.select(F.col("id").alias("node_id"), "into"), "node_id", "left")
    own = told.select("way_id", "pos", F.lit(0).alias("nth"), F.when(F.col("road"), F.coalesce("into", "node_id")).otherwise(F.col("node_id")).alias("node_id"))
    added = inserts.select("way_id", F.col("after_pos").alias("pos"), F.row_number().over(Window.partitionBy("way_id", "after_pos").orderBy("node_id")).alias("nth"), "node_id")
    order = Window.partitionBy("way_id").orderBy("pos", "nth")
    all_ = own.unionByName(added).withColumn("last", F.lag("node_id").over(order)).where("last IS NULL OR last <> node_id")
    return all_.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nth", "node_id"))), lambda x: x["node_id"]).alias("refs"))


def readable_name(tags: Column, keys: list[str], unreadable: str) -> Column:
    """The first name, in the order of keys, without a character of the class; null if all have one."""
    return F.coalesce(*[F.when((tags[k] != "") & ~tags[k].rlike(f"[{unreadable}]"), tags[k]) for k in keys])


def as_ways(lines: DataFrame, first_id: int = 1 << 42, medium: int = 5, major: int = 10, step: int = 20) -> DataFrame:
    """(way_id, level, contour_ext): numbers for contour lines (cell, level, line), cells in slices of 2^20, and their class."""
    n = F.row_number().over(Window.partitionBy("cell").orderBy("level", "line"))
    ext = F.when(F.col("level") % (step * major) == 0, "elevation_major").when(F.col("level") % (step * medium) == 0, "elevation_medium").otherwise("elevation_minor")
    return lines.select("cell", "level", "line", (F.lit(first_id) + F.col("cell").cast("long") * (1 << 20) + n).alias("way_id"), ext.alias("contour_ext"))


def spliced(rules: DataFrame, added: DataFrame) -> DataFrame:
    """(file, line, text): rules (file, line, text) with added lines (file, after, ord, text) behind the line they name."""
    both = rules.select("file", F.col("line").alias("at"), F.lit(-1).alias("ord"), "text").unionByName(added.select("file", F.col("after").alias("at"), "ord", "text"))
    return both.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at", "ord")) - 1).cast("long").alias("line"), "text")


def dilated(cells: DataFrame, margin: int) -> DataFrame:
    """Cells (y, x) and all within the margin of one, each once."""
    around = F.sequence(F.lit(-margin), F.lit(margin))
    grown = cells.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    return grown.select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()


def dry_runs(points: DataFrame, least: int = 2) -> DataFrame:
    """(line, start, end): runs of places (line, pos, wet) outside water; short ones between two shores go."""
    line = Window.partitionBy("line").orderBy("pos")
    told = points.withColumn("g", F.col("pos") - F.sum(F.when(F.col("wet"), 0).otherwise(1)).over(line)).withColumn("last", F.max("pos").over(Window.partitionBy("line")))
    runs = told.where("NOT wet").groupBy("line", "g", "last").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    ends = (F.col("start") == 0) | (F.col("end") == F.col("last"))
    return runs.where(ends | (F.col("end") - F.col("start") + 1 >= least)).select("line", "start", "end")


def venue_marks(areas: DataFrame, points: DataFrame) -> DataFrame:
    """(id): areas (id, seen, tag, name, box) that stand for another venue of the same tag.

    An area is marked by a point (tag, y, x, name) in its box, unless it has a name and the point none or another;
    and by a named smaller area inside it, if it has none itself. Both sides meet by tag and grid cell, first one point for each
    name and one area, the smallest, of a cell; all others meet only the areas that these leave unmarked.
    """
    areas = written(areas, "areas")
    points, named = written(points, "points"), written(areas.where("name IS NOT NULL"), "named")
    cell = [F.shiftright(c, VENUE_BITS) for c in ("min_lat", "min_lon")]
    extent = (F.col("max_lat") - F.col("min_lat")).cast("long") * (F.col("max_lon") - F.col("min_lon"))
    least = named.groupBy("tag", cell[0].alias("cy"), cell[1].alias("cx")).agg(F.min_by(F.struct(*named.columns), F.struct(extent, "id")).alias("a")).select("a.*")
    one = points.groupBy("tag", "name", F.shiftright("y", VENUE_BITS).alias("cy"), F.shiftright("x", VENUE_BITS).alias("cx")).agg(F.min(F.struct("y", "x")).alias("p")).select("tag", "p.y", "p.x", "name")
    marked = written(_marked(areas, one, least), "marked")
    rest = _marked(areas.join(marked, "id", "left_anti"), points, named)
    return marked.unionByName(rest).distinct()


#: A venue is filed in cells of 2^10 units.
VENUE_BITS = 10


def _marked(areas: DataFrame, points: DataFrame, named: DataFrame) -> DataFrame:
    """(id): areas that one of the points, or of the named areas, marks."""
    bits = VENUE_BITS
    span = lambda lo, hi: F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits)))
    filed = areas.withColumn("cy", span("min_lat", "max_lat")).withColumn("cx", span("min_lon", "max_lon"))
    p = points.select("tag", "y", "x", F.col("name").alias("point_name"), F.shiftright("y", bits).alias("cy"), F.shiftright("x", bits).alias("cx"))
    inside = (F.col("y") >= F.col("min_lat")) & (F.col("y") <= F.col("max_lat")) & (F.col("x") >= F.col("min_lon")) & (F.col("x") <= F.col("max_lon"))
    agrees = F.col("name").isNull() | F.coalesce(F.col("point_name") == F.col("name"), F.lit(False))
    by_point = filed.join(p, ["tag", "cy", "cx"]).where(inside & agrees).select("id")
    size = lambda: ((F.col("max_lat") - F.col("min_lat")).cast("long") * (F.col("max_lon") - F.col("min_lon")))
    # an inner area is met where its own corner lies
    inner = named.select("tag", F.col("id").alias("inner"), size().alias("isize"), F.shiftright("min_lat", bits).alias("cy"), F.shiftright("min_lon", bits).alias("cx"), *[F.col(c).alias("i_" + c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")])
    held = (F.col("i_min_lat") >= F.col("min_lat")) & (F.col("i_max_lat") <= F.col("max_lat")) & (F.col("i_min_lon") >= F.col("min_lon")) & (F.col("i_max_lon") <= F.col("max_lon"))
    by_area = filed.where("name IS NULL").withColumn("size", size()).join(inner, ["tag", "cy", "cx"]).where(held & (F.col("inner") != F.col("id")) & (F.col("isize") < F.col("size"))).select("id")
    return by_point.unionByName(by_area).distinct()
