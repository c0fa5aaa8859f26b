"""Region trees: search, ancestors, reachability, cells, coverage and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def search(regions: DataFrame, text: str, most: int = 300) -> DataFrame:
    """The best regions for a text, best first: where it starts in the name, then the name's length.

    100 a character before the match, plus the name's length, plus 5000 without a file; a match in the id alone counts as 20
    characters further on.  Blanks around the text don't count, and an empty text finds nothing.
    """
    t = text.strip(" \t").lower()
    in_name, in_id = F.instr(F.lower("name"), t), F.instr(F.lower("id"), t)
    at = F.when(in_name > 0, in_name - 1).otherwise(in_id - 1 + 20)
    score = at * 100 + F.length("name") + F.when(F.col("url").isNull(), 5000).otherwise(0)
    return regions.where(F.lit(bool(t)) & ((in_name > 0) | (in_id > 0))).select("id", "name", score.cast("long").alias("score")).orderBy("score", "name", "id").limit(most)


def listing(regions: DataFrame, text: str) -> DataFrame:
    """Roots for an empty text, the children of a region of that very id that has any, else what a search finds."""
    if not text:
        return regions.where("parent IS NULL").select("id", "name")
    below = regions.where(F.col("parent") == text).select("id", "name")
    return below if not below.isEmpty() else search(regions, text).select("id", "name")


def ancestors(regions: DataFrame, hops: int = 12) -> DataFrame:
    """(id, ancestor, depth): every region above each one, up to ``hops`` steps; a loop ends there too."""
    up = regions.where("parent IS NOT NULL").select("id", "parent")
    step = up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = step
    for depth in range(2, hops + 1):
        step = step.join(up.select(F.col("id").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): seeds and all that edges (id, holder) lead to from them, loops included once."""
    found = front = seeds.select("id").distinct()
    while not front.isEmpty():
        nxt = edges.join(front, "id").select(F.col("holder").alias("id")).distinct().join(found, "id", "left_anti")
        front = _cut(nxt)
        found = _cut(found.unionByName(front))
    return found


def _cut(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut at a reliable checkpoint, where the session has a folder for it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def chain_ends(merges: DataFrame) -> DataFrame:
    """(id, into): where chains of merges (id, into) end, by following twice as far each round; null where a chain comes back on itself.

    No chain is longer than there are merges, so that what still moves after as many doublings goes round in a circle.
    """
    now = merges.select("id", "into")
    for _ in range(max(1, now.count()).bit_length() + 1):
        nxt = now.select(F.col("id").alias("into"), F.col("into").alias("then"))
        after = _cut(now.join(nxt, "into", "left").select("id", F.coalesce("then", "into").alias("into"), F.col("then").isNotNull().alias("moved")))
        now = after.select("id", "into")
        if after.where("moved").isEmpty():
            return now
    return after.select("id", F.when(~F.col("moved"), F.col("into")).alias("into"))


def footprint(boxes: DataFrame) -> DataFrame:
    """(lat, lon): degree cells that closed boxes (min_lat, min_lon, max_lat, max_lon) touch, each once."""
    lats = boxes.select(F.explode(F.sequence(F.floor("min_lat"), F.ceil("max_lat") - 1)).alias("lat"), "min_lon", "max_lon")
    return lats.select("lat", F.explode(F.sequence(F.floor("min_lon"), F.ceil("max_lon") - 1)).alias("lon")).distinct()


def rectangles(cells: DataFrame) -> DataFrame:
    """(min_lat, max_lat, min_lon, max_lon): cells (lat, lon) in runs along a row, equal runs of neighbouring rows stacked."""
    row = Window.partitionBy("lat").orderBy("lon")
    runs = cells.distinct().withColumn("g", F.col("lon") - F.row_number().over(row)).groupBy("lat", "g").agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    stack = Window.partitionBy("min_lon", "max_lon").orderBy("lat")
    return runs.withColumn("s", F.col("lat") - F.row_number().over(stack)).groupBy("min_lon", "max_lon", "s").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat")).select("min_lat", "max_lat", "min_lon", "max_lon")


def coverage_holes(frame: tuple[int, int, int, int], step: int, tiles: DataFrame) -> DataFrame:
    """(lat, lon): points of a grid, half a step off the frame's edge, that no tile holds; files tiles by grid cell."""
    spark, (lo_y, lo_x, hi_y, hi_x) = tiles.sparkSession, frame
    ys = spark.range(lo_y + step // 2, hi_y, step).select(F.col("id").alias("lat"))
    xs = spark.range(lo_x + step // 2, hi_x, step).select(F.col("id").alias("lon"))
    points = ys.crossJoin(F.broadcast(xs)).withColumn("cy", F.floor(F.col("lat") / step)).withColumn("cx", F.floor(F.col("lon") / step))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step)))
    filed = tiles.withColumn("cy", span("min_lat", "max_lat")).withColumn("cx", span("min_lon", "max_lon"))
    inside = (F.col("lat") >= F.col("min_lat")) & (F.col("lat") < F.col("max_lat")) & (F.col("lon") >= F.col("min_lon")) & (F.col("lon") < F.col("max_lon"))
    held = points.join(filed, ["cy", "cx"]).where(inside).select("lat", "lon").distinct()
    return points.select("lat", "lon").join(held, ["lat", "lon"], "left_anti")


def first_source(cells: DataFrame, offers: DataFrame) -> DataFrame:
    """Each cell with the first source, by priority, that offers it; cells without an offer have a null source."""
    best = offers.groupBy("cell").agg(F.min_by("source", F.struct("priority", "source")).alias("source"))
    return cells.join(best, "cell", "left")


def next_fit(items: DataFrame, group: str, order: list[str], weight: Column, limit: int) -> DataFrame:
    """``items`` with a column bin: in order, an item that no longer fits starts the next bin of its group.

    A group is packed by one task, item by item, as its meaning is; groups are independent.
    """
    out = items.withColumn("_w", weight.cast("double"))
    schema = T.StructType([*out.drop("_w").schema.fields, T.StructField("bin", T.IntegerType())])

    def pack(rows):  # noqa: ANN001, ANN202
        rows = rows.sort_values(order, kind="stable")
        bins, now, full = [], 0, 0.0
        for w in rows.pop("_w"):
            if full and full + w > limit:
                now, full = now + 1, 0.0
            full += w
            bins.append(now)
        return rows.assign(bin=bins)

    return out.groupBy(group).applyInPandas(pack, schema)
