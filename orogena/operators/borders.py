"""Rasters side by side: samples of neighbours round each, and edges that are dead filled from over the border.

Rasters are rows (cell, row, col, height) of ``side`` samples a side, row 0 in the north; corners are (cell, lat, lon), whole degrees of
the south-west.  Neighbours share their border: a raster's last column is the first of the one to the east.  Only samples near a border are
exchanged, whatever a raster holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrapped(lon: Column) -> Column:
    """A whole degree of longitude from -180 to 179."""
    return (F.pmod(lon + 180, F.lit(360)) - 180).cast("int")


def _seen_by(samples: DataFrame, corners: DataFrame, side: int, low: int, high: int) -> DataFrame:
    """Samples as the eight neighbours count them: (cell, row, col, height), rows and columns from low to high and outside their own samples' order.

    A place that a neighbour has itself isn't given.
    """
    last = side - 1
    steps = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x]))
    at = corners.select("cell", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    moved = samples.join(at, "cell").withColumn("_s", steps).select(
        (F.col("_lat") + F.col("_s.y")).alias("lat"), _wrapped(F.col("_lon") + F.col("_s.x")).alias("lon"), (F.col("row") + F.col("_s.y") * last).alias("row"), (F.col("col") - F.col("_s.x") * last).alias("col"), "height"
    )
    near = moved.where(F.col("row").between(low, high) & F.col("col").between(low, high))
    to = corners.select(F.col("lat"), _wrapped(F.col("lon")).alias("lon"), F.col("cell").alias("cell"))
    return near.join(to, ["lat", "lon"]).select("cell", "row", "col", "height")


def _near_border(raster: DataFrame, side: int, reach: int) -> DataFrame:
    edge = lambda c: (F.col(c) <= reach) | (F.col(c) >= side - 1 - reach)
    return raster.where(edge("row") | edge("col"))


def with_halo(raster: DataFrame, corners: DataFrame, side: int, reach: int) -> DataFrame:
    """Rasters with the samples of their neighbours up to ``reach`` beyond each edge, as rows and columns below 0 and above side - 1.

    Windows over a raster then see over its borders.  Where several neighbours give a place the greatest height is taken.
    """
    beyond = _seen_by(_near_border(raster, side, reach), corners, side, -reach, side - 1 + reach)
    own = F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)
    halo = beyond.where(~own).groupBy("cell", "row", "col").agg(F.max("height").alias("height"))
    return raster.select("cell", "row", "col", "height").unionByName(halo)


def spilled(changes: DataFrame, corners: DataFrame, side: int) -> DataFrame:
    """Changed samples (cell, row, col, height) in every raster that has their place: those in a halo go home, those on a border to both sides.

    Where several give a place the greatest height is taken; places in no raster are left out.
    """
    inside = F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)
    edge = lambda c: (F.col(c) <= 0) | (F.col(c) >= side - 1)
    over = _seen_by(changes.where(edge("row") | edge("col")), corners, side, 0, side - 1)
    return changes.where(inside).select("cell", "row", "col", "height").unionByName(over).groupBy("cell", "row", "col").agg(F.max("height").alias("height"))


def burnt_over_borders(peaks: DataFrame, raster: DataFrame, corners: DataFrame, side: int, radius: int = 1, most: int = 60) -> DataFrame:
    """The samples that summits raise (see :func:`orogena.operators.rasters.burn_peaks`), in their own and in neighbouring rasters."""
    from orogena.operators.rasters import burn_peaks

    return spilled(burn_peaks(peaks, with_halo(raster, corners, side, max(1, radius)), radius, most), corners, side)


#: An edge, its line and the line inside (from 0, negative from the end), the neighbour's step north and east, and its edge there.
_EDGES = {"east": ("col", -1, -2, 0, 1, "west"), "west": ("col", 0, 1, 0, -1, "east"), "south": ("row", -1, -2, -1, 0, "north"), "north": ("row", 0, 1, 1, 0, "south")}


def repaired_edges(raster: DataFrame, corners: DataFrame, side: int) -> DataFrame:
    """(cell, row, col, height, edge): the samples of dead edges as they are to be.

    An edge is dead if all its samples are 0 and not all of the line inside it; all are judged before any is filled.  It takes the
    neighbour's opposite edge, if that is there and not all 0, else its own line inside.  East and west come first, and south
    and north, which see them, have the corners.
    """
    last = side - 1
    place = lambda k: k if k >= 0 else side + k
    lines = []
    for edge, (axis, outer, inner, *_rest) in _EDGES.items():
        for name, at in ((edge, outer), (f"{edge} inside", inner)):
            other = "row" if axis == "col" else "col"
            lines.append(F.when(F.col(axis) == place(at), F.struct(F.lit(name).alias("name"), F.col(other).alias("i"))))
    near = _near_border(raster, side, 1)
    told = near.withColumn("l", F.explode(F.array_compact(F.array(*lines)))).select("cell", "l.name", "l.i", "height")
    alive = told.groupBy("cell", "name").agg(F.bool_or(F.coalesce(F.col("height") != 0, F.lit(True))).alias("alive"))
    where = corners.select("cell", "lat", _wrapped(F.col("lon")).alias("lon"))
    own = alive.join(where, "cell")
    taken = []
    for edge, (axis, outer, _inner, north, east, opposite) in _EDGES.items():
        inside = alive.where((F.col("name") == f"{edge} inside") & F.col("alive")).select("cell")
        dead = own.where((F.col("name") == edge) & ~F.col("alive")).join(inside, "cell", "left_semi").select("cell", (F.col("lat") + north).alias("lat"), _wrapped(F.col("lon") + east).alias("lon"))
        beyond = own.where((F.col("name") == opposite) & F.col("alive")).select("lat", "lon", F.col("cell").alias("source"))
        met = dead.join(beyond, ["lat", "lon"], "left").select("cell", F.coalesce("source", "cell").alias("source"), F.when(F.col("source").isNull(), f"{edge} inside").otherwise(opposite).alias("name"))
        line = told.select(F.col("cell").alias("source"), "name", "i", "height")
        filled = met.join(line, ["source", "name"]).select("cell", "i", "height", (F.col("source") == F.col("cell")).alias("inside"))
        at = F.lit(place(outer))
        row, col = (F.col("i"), at) if axis == "col" else (at, F.col("i"))
        taken.append(filled.select("cell", row.cast("int").alias("row"), col.cast("int").alias("col"), "height", F.lit(edge).alias("edge"), "inside"))
    columns = taken[0].unionByName(taken[1])
    rows = taken[2].unionByName(taken[3])
    # a line inside may itself have been filled at its ends, one line in from the edge
    fill = columns.select("cell", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("height").alias("_h"))
    inner = F.when(F.col("row") == last, last - 1).otherwise(1)
    seen = rows.join(fill, (rows["cell"] == fill["cell"]) & rows["inside"] & (fill["_r"] == inner) & (fill["_c"] == rows["col"]), "left").select(*[rows[c] for c in ("cell", "row", "col", "edge")], F.when(F.col("_r").isNull(), rows["height"]).otherwise(F.col("_h")).alias("height"))
    first = columns.join(seen.select("cell", "row", "col"), ["cell", "row", "col"], "left_anti")
    return first.select("cell", "row", "col", "height", "edge").unionByName(seen.select("cell", "row", "col", "height", "edge"))
