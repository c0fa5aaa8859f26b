"""Contours of height rasters as lines with points, put together without a task ever holding a raster's level.

A raster's squares are crossed by levels (marching squares); tasks join the segments of one block of squares, bounded in
size, into pieces; pieces are put in order by pointer doubling; points are then rows of their own, numbered along
their line.  A crossing is named by the sample that its edge starts at and by whether the edge runs east or south.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogena.operators import ranking
from orogena.operators.places import line_cells
from orogena.storage import written

#: Squares a side of a block.
BLOCK = 64
#: Fixed value: how far off a line, in degrees, a point may be to lie on it.
FLATNESS = 1e-8


def squares(raster: DataFrame) -> DataFrame:
    """(cell, row, col, nw, ne, se, sw) of each four neighbours that all have a height; rasters are (cell, row, col, height)."""
    line = Window.partitionBy("cell", "row").orderBy("col")
    east = raster.where("height IS NOT NULL").select("cell", "row", "col", F.col("height").alias("nw"), F.when(F.lead("col").over(line) == F.col("col") + 1, F.lead("height").over(line)).alias("ne"))
    column = Window.partitionBy("cell", "col").orderBy("row")
    south = lambda c: F.when(F.lead("row").over(column) == F.col("row") + 1, F.lead(c).over(column))
    return east.select("*", south("nw").alias("sw"), south("ne").alias("se")).where("ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL")


def crossing_key(row: Column, col: Column, south: Column | int) -> Column:
    return F.shiftleft(F.shiftleft(row.cast("long"), 20) + col, 1) + south


def segments(raster: DataFrame, step: int) -> DataFrame:
    """(cell, level, row, col, a, b, a_at, b_at): the crossings of a square that a level joins, and how far along its edge each is.

    A corner is above a level if strictly so; of a saddle the mean of its corners tells which belong together.  A step that
    isn't positive has no levels.
    """
    if step <= 0:
        return raster.sparkSession.createDataFrame([], "cell int, level int, row int, col int, a long, b long, a_at double, b_at double")
    s = squares(raster)
    low, high = F.least("nw", "ne", "se", "sw"), F.greatest("nw", "ne", "se", "sw")
    first, last = F.ceil(low / step), F.ceil(high / step) - 1
    s = s.where(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", (F.col("level") * step).cast("int"))
    level = F.col("level")
    above = lambda c: F.col(c) > level
    cut = lambda p, q: (level - F.col(p)) / (F.col(q) - F.col(p))
    row, col = F.col("row"), F.col("col")
    ends = {
        "top": F.struct(crossing_key(row, col, 0).alias("key"), cut("nw", "ne").alias("at")),
        "bottom": F.struct(crossing_key(row + 1, col, 0).alias("key"), cut("sw", "se").alias("at")),
        "left": F.struct(crossing_key(row, col, 1).alias("key"), cut("nw", "sw").alias("at")),
        "right": F.struct(crossing_key(row, col + 1, 1).alias("key"), cut("ne", "se").alias("at")),
    }
    corners = {"top": ("nw", "ne"), "bottom": ("sw", "se"), "left": ("nw", "sw"), "right": ("ne", "se")}
    crossed = F.array_compact(F.array(*[F.when(above(corners[e][0]) != above(corners[e][1]), ends[e]) for e in ends]))
    pair = lambda p, q: F.struct(ends[p].alias("p"), ends[q].alias("q"))
    pockets = (F.col("nw") + F.col("ne") + F.col("se") + F.col("sw") > level * 4) == above("nw")
    saddle = F.when(pockets, F.array(pair("top", "right"), pair("left", "bottom"))).otherwise(F.array(pair("top", "left"), pair("right", "bottom")))
    found = F.when(F.size(crossed) == 4, saddle).otherwise(F.array(F.struct(F.get(crossed, F.lit(0)).alias("p"), F.get(crossed, F.lit(1)).alias("q"))))
    return s.withColumn("x", F.explode(found)).select("cell", "level", "row", "col", F.col("x.p.key").alias("a"), F.col("x.q.key").alias("b"), F.col("x.p.at").alias("a_at"), F.col("x.q.at").alias("b_at"))


_PIECES = "cell int, level int, piece long, a long, b long, a_side long, b_side long, n long, least long, keys array<long>, ats array<double>"


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The segments of a block joined into pieces; a ring within the block is one piece that ends where it begins."""
    cell, level = int(rows["cell"].iloc[0]), int(rows["level"].iloc[0])
    side = ((rows["row"].to_numpy(np.int64) << 20) + rows["col"].to_numpy(np.int64)).tolist()
    pairs = list(zip(rows["a"].tolist(), rows["b"].tolist()))
    at = dict(zip(rows["a"].tolist(), rows["a_at"].tolist())) | dict(zip(rows["b"].tolist(), rows["b_at"].tolist()))
    ends: dict[int, list[int]] = {}
    for i in sorted(range(len(pairs)), key=side.__getitem__):
        for key in pairs[i]:
            ends.setdefault(key, []).append(i)
    used, out = [False] * len(pairs), []
    for start in [*(k for k in sorted(ends) if len(ends[k]) == 1), *sorted(ends)]:
        keys, sides = [start], []
        while nxt := [i for i in ends[keys[-1]] if not used[i]]:
            a, b = pairs[nxt[0]]
            used[nxt[0]] = True
            sides.append(side[nxt[0]])
            keys.append(b if a == keys[-1] else a)
        if sides:
            out.append((cell, level, 0, keys[0], keys[-1], sides[0], sides[-1], len(sides), min(keys), keys, [at[k] for k in keys]))
    return pd.DataFrame(out, columns=["cell", "level", "piece", "a", "b", "a_side", "b_side", "n", "least", "keys", "ats"])


def pieces(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Segments joined within blocks of squares: (cell, level, piece, a, b, a_side, b_side, n, least, keys, ats).

    A block's level has at most two segments a square, so a task's share doesn't grow with the raster.
    """
    by = [F.floor(F.col("row") / block).alias("_y"), F.floor(F.col("col") / block).alias("_x")]
    joined = found.withColumn("_y", by[0]).withColumn("_x", by[1]).groupBy("cell", "level", "_y", "_x").applyInPandas(_joined, _PIECES)
    return joined.withColumn("piece", F.monotonically_increasing_id())


def _split(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Pieces of rings, each that holds its ring's least place cut in two there."""
    told = rows.join(low, ["cell", "level", "piece"])
    at = F.array_position("keys", F.col("low")).cast("int")  # from 1
    size = F.size("keys")
    inner = (at > 1) & (at < size)
    part = lambda k, lo, hi: F.struct((F.col("piece") * 2 + k).alias("piece"), F.slice("keys", lo, hi - lo + 1).alias("keys"), F.slice("ats", lo, hi - lo + 1).alias("ats"))
    whole = F.array(part(0, F.lit(1), size))
    return told.withColumn("x", F.explode(F.when(inner, F.array(part(0, F.lit(1), at), part(1, at, size))).otherwise(whole))).select("cell", "level", "low", "x.piece", "x.keys", "x.ats")


def _sided(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Pieces with the squares of their first and last steps, which tell the two ways round a ring apart."""
    first, last = F.get("keys", F.lit(0)), F.get("keys", F.size("keys") - 1)
    second, before = F.get("keys", F.lit(1)), F.get("keys", F.size("keys") - 2)
    square = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    side = of.select("cell", "level", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), (F.shiftleft(F.col("row").cast("long"), 20) + F.col("col")).alias("side"))
    told = rows.withColumn("f", square(first, second)).withColumn("l", square(before, last))
    for name in ("f", "l"):
        told = told.join(side.select("cell", "level", "p", "q", F.col("side").alias(f"{name}_side")), (told["cell"] == side["cell"]) & (told["level"] == side["level"]) & (told[f"{name}.p"] == side["p"]) & (told[f"{name}.q"] == side["q"])).select(*[told[c] for c in told.columns], f"{name}_side")
    return told.select("cell", "level", "piece", first.alias("a"), last.alias("b"), F.col("f_side").alias("a_side"), F.col("l_side").alias("b_side"), (F.size("keys") - 1).cast("long").alias("n"), F.array_min("keys").alias("least"), "keys", "ats", "low")


def line_points(raster: DataFrame, step: int, block: int = BLOCK) -> DataFrame:
    """(cell, level, line, pos, key, y, x, closed): the points of every contour, ``pos`` counting from 0 along the line.

    A line is named by the crossing that it begins at: an open one at its end with the lesser key, a ring at its least key, which
    comes at its end again.  A ring goes first where the upper, or else the left, of the two squares leads.  y and x are in samples.
    """
    found = written(segments(raster, step), "segments")
    every = written(pieces(found, block), "pieces")
    group = F.struct("cell", "level").alias("group")
    placed, rings = ranking.chained(every.select(group, "piece", "a", "b", "a_side", "b_side", "n", "least"))
    placed = placed.select("group.cell", "group.level", "piece", "line", "offset", "reversed", "closed")
    out = every.join(placed, ["cell", "level", "piece"]).select("cell", "level", "line", "offset", "reversed", "closed", "n", "keys", "ats")
    low = rings.select("group.cell", "group.level", "piece", "low")
    if not rings.isEmpty():
        cut = written(_sided(_split(every.select("cell", "level", "piece", "keys", "ats"), low), found), "cut")
        at = cut.select(group, F.col("low").alias("place")).distinct()
        round_ = ranking.opened(cut.select(group, "piece", "a", "b", "a_side", "b_side", "n", "least"), at).select("group.cell", "group.level", "piece", "line", "offset", "reversed", "closed")
        out = out.unionByName(cut.join(round_, ["cell", "level", "piece"]).select(*out.columns))
    place = F.when(F.col("reversed"), F.col("offset") + F.col("n") - F.col("i")).otherwise(F.col("offset") + F.col("i"))
    # pieces of a line share the place where they meet: the later one gives it, or the line's end
    last = F.when(F.col("reversed"), F.col("i") == 0).otherwise(F.col("i") == F.col("n"))
    total = F.max(F.col("offset") + F.col("n")).over(Window.partitionBy("cell", "level", "line", "closed"))
    sized = out.select("*", total.alias("total"))
    points = sized.select("*", F.posexplode(F.arrays_zip("keys", "ats")).alias("i", "k")).withColumn("pos", place).where(~last | (F.col("pos") == F.col("total")))
    key = F.col("k.keys")
    south, corner = key % 2 == 1, F.shiftright(key, 1)
    row, col = F.shiftright(corner, 20), corner % (1 << 20)
    y, x = F.when(south, row + F.col("k.ats")).otherwise(row.cast("double")), F.when(south, col.cast("double")).otherwise(col + F.col("k.ats"))
    return points.select("cell", "level", "line", F.col("pos").cast("long").alias("pos"), key.alias("key"), y.alias("y"), x.alias("x"), "closed")


def on_ground(points: DataFrame, side: int, corners: DataFrame) -> DataFrame:
    """Points with lat and lon: row 0 of a raster of ``side`` samples a side is its north edge; corners are (cell, lat, lon) of the south-west."""
    span = side - 1
    return points.join(corners.select("cell", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "cell").select(*points.columns, (F.col("_lat") + 1 - F.col("y") / span).alias("lat"), (F.col("_lon") + F.col("x") / span).alias("lon"))


def _on_the_way(a: complex, b: complex, c: complex, flatness: float) -> bool:
    """Whether b lies on the straight way from a to c, at most ``flatness`` beside it and neither before a nor beyond c."""
    way = c - a
    if not way:
        return False
    turned = (b - a) * way.conjugate() / abs(way)  # along the way, and beside it
    return turned.real > 0 and abs(turned.imag) <= flatness and abs(b - a) <= abs(way)


def tidied(lats: list[float], lons: list[float], flatness: float = FLATNESS) -> list[int]:
    """The points of a line that stay: neither repeated in place nor between others on a straight run.

    A point is left out if it lies on the way from the last one kept before it to the next, which is asked again for all points kept
    before as long as it holds; a spike that doubles back keeps its tip.
    """
    places = [complex(x, y) for y, x in zip(lats, lons)]
    kept: list[int] = []
    for i, place in enumerate(places):
        if i and place == places[i - 1]:
            continue
        while len(kept) > 1 and _on_the_way(places[kept[-2]], places[kept[-1]], place, flatness):
            del kept[-1]
        kept.append(i)
    return kept


def simplified_lines(points: DataFrame, most: int = 2000, flatness: float = FLATNESS) -> DataFrame:
    """(cell, level, line, part, closed, lats, lons): lines of points (cell, level, line, pos, lat, lon, closed) as they are drawn.

    Points that say nothing are left out (see :func:`tidied`) and a line of more than ``most`` points is cut into parts, each of
    which begins with the last point of the one before; a line that is left with a single point goes.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon")))
    lines = points.groupBy("cell", "level", "line", "closed").agg(ordered.alias("p")).select("cell", "level", "line", "closed", F.col("p.lat").alias("lats"), F.col("p.lon").alias("lons"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                kept = tidied(row["lats"], row["lons"], flatness)
                for part, at in enumerate(range(0, len(kept) - 1, most - 1)):
                    own = kept[at : at + most]
                    rows.append(row | {"part": part, "lats": [row["lats"][i] for i in own], "lons": [row["lons"][i] for i in own]})
            if rows:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("cell", "level", "line", "part", "closed", "lats", "lons")} for r in rows], schema=pa.schema([("cell", pa.int32()), ("level", pa.int32()), ("line", pa.int64()), ("part", pa.int32()), ("closed", pa.bool_()), ("lats", pa.list_(pa.float64())), ("lons", pa.list_(pa.float64()))]))

    return lines.mapInArrow(run, "cell int, level int, line long, part int, closed boolean, lats array<double>, lons array<double>")


#: Fixed values of shores: halvings of the way to one, and the length in cells of a piece between two that is kept.
HALVINGS, LEAST_CELLS, METRES_A_DEGREE = 6, 2, 111_320.0


def dry_pieces(points: DataFrame, water: DataFrame, scale: int) -> DataFrame:
    """(cell, level, line, piece, nth, lat, lon, closed): what lines of points have over dry ground, each piece ending on the shore.

    ``water`` has the wet cells (cy, cx) of 1/scale degrees.  Where a line crosses the shore, the point is found by halving the
    segment HALVINGS times and is the last dry one.  A piece of a single point goes, and one from shore to shore that is shorter than
    LEAST_CELLS cells; a ring that stays dry stays closed, one that is cut is open pieces.
    """
    line = ["cell", "level", "line", "closed"]
    lit = water.select(F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx")).distinct()
    at = lambda c: F.floor(F.col(c) * scale)
    told = points.select(*line, "pos", "lat", "lon", at("lat").alias("cy"), at("lon").alias("cx")).join(lit.withColumn("wet", F.lit(True)), ["cy", "cx"], "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
    along = Window.partitionBy(*line).orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    change = F.coalesce(before("wet") != F.col("wet"), F.lit(False))
    told = written(
        told.select(*line, "pos", "lat", "lon", "wet", change.alias("change"), before("lat").alias("p_lat"), before("lon").alias("p_lon"))
        .withColumn("piece", F.sum((F.col("change") & ~F.col("wet")).cast("int")).over(along))
        .withColumn("cut", F.bool_or("wet").over(Window.partitionBy(*line))),
        "told",
    )
    dry = told.where("NOT wet").select(*line, "piece", "cut", F.col("pos").cast("double").alias("nth"), "lat", "lon", F.lit(False).alias("shore"))

    crossing = told.where("change").select(*line, "pos", "piece", "cut", "wet", "lat", "lon", "p_lat", "p_lon", *[(F.col(c) * scale).alias(n) for c, n in (("lat", "y1"), ("lon", "x1"), ("p_lat", "y2"), ("p_lon", "x2"))])
    near = line_cells(crossing.select(*line, "pos", "y1", "x1", "y2", "x2"), ("y1", "x1", "y2", "x2"), 1).join(lit, ["cy", "cx"], "left_semi")
    cells = near.groupBy(*line, "pos").agg(F.collect_set(F.struct("cy", "cx")).alias("cells"))
    own, other = F.struct("lat", "lon"), F.struct(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    start = F.struct(F.when(F.col("wet"), other).otherwise(own).alias("dry"), F.when(F.col("wet"), own).otherwise(other).alias("sea"))

    def halved(s: Column, _: Column) -> Column:
        def at_middle(m: Column) -> Column:
            is_wet = F.array_contains("cells", F.struct(F.floor(m["lat"] * scale).alias("cy"), F.floor(m["lon"] * scale).alias("cx")))
            return F.struct(F.when(is_wet, s["dry"]).otherwise(m).alias("dry"), F.when(is_wet, m).otherwise(s["sea"]).alias("sea"))

        middle = F.struct(((s["dry"]["lat"] + s["sea"]["lat"]) / 2).alias("lat"), ((s["dry"]["lon"] + s["sea"]["lon"]) / 2).alias("lon"))
        return F.get(F.transform(F.array(middle), at_middle), F.lit(0))

    none = F.array().cast("array<struct<cy: bigint, cx: bigint>>")
    found = crossing.join(cells, [*line, "pos"], "left").withColumn("cells", F.coalesce("cells", none)).withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved))
    shores = found.select(*line, "piece", "cut", (F.col("pos") - 0.5).alias("nth"), F.col("s.dry.lat").alias("lat"), F.col("s.dry.lon").alias("lon"), F.lit(True).alias("shore"))

    every = dry.unionByName(shores)
    run = Window.partitionBy(*line, "piece").orderBy("nth")
    across = (F.col("lon") - F.lag("lon").over(run)) * F.cos(F.radians(F.lag("lat").over(run)))
    up = F.col("lat") - F.lag("lat").over(run)
    every = every.withColumn("step", F.coalesce(F.sqrt(across * across + up * up), F.lit(0.0)))
    whole = Window.partitionBy(*line, "piece")
    every = every.select("*", F.count("*").over(whole).alias("n"), F.sum("step").over(whole).alias("size"), F.count_if("shore").over(whole).alias("shores"))
    short = (F.col("shores") == 2) & (F.col("size") * METRES_A_DEGREE < LEAST_CELLS * METRES_A_DEGREE / scale)
    return every.where((F.col("n") >= 2) & ~short).select("cell", "level", "line", "piece", "nth", "lat", "lon", (F.col("closed") & ~F.col("cut")).alias("closed"))
