"""Height rasters as rows (cell, row, col, height): focal windows, look-ups, repairs, contours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def focal_max(raster: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Centres (cell, row, col) with the greatest height within a square of the radius; null where all is void."""
    near = centres.withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("dx", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    at = near.select(*[F.col(c).alias(f"c_{c}") for c in centres.columns], F.col("cell"), (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"))
    return at.join(raster, ["cell", "row", "col"]).groupBy(*[F.col(f"c_{c}").alias(c) for c in centres.columns]).agg(F.max("height").alias("local_max"))


def steepest(raster: DataFrame) -> DataFrame:
    """(cell, row, col, rise): the greatest difference of height to one of the four neighbours, voids left out."""
    a = raster.where("height IS NOT NULL")
    steps = a.select("cell", "row", "col", "height", F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("s"))
    moved = steps.select("cell", (F.col("row") + F.col("s.dy")).alias("row"), (F.col("col") + F.col("s.dx")).alias("col"), F.col("height").alias("other"))
    return moved.join(a, ["cell", "row", "col"]).groupBy("cell", "row", "col").agg(F.max(F.abs(F.col("height") - F.col("other"))).alias("rise"))


def bilinear(points: DataFrame, raster: DataFrame, steps: int) -> DataFrame:
    """Points (id, cell, y, x in 1/steps of a sample) with their height times steps squared; null next to a void."""
    base = points.withColumn("row", F.floor(F.col("y") / steps)).withColumn("col", F.floor(F.col("x") / steps))
    fy, fx = F.col("y") % steps, F.col("x") % steps
    corner = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)]))
    weight = F.when(F.col("k.j") == 0, steps - fy).otherwise(fy) * F.when(F.col("k.i") == 0, steps - fx).otherwise(fx)
    corners = base.withColumn("k", corner).select("id", "cell", (F.col("row") + F.col("k.j")).cast("int").alias("row"), (F.col("col") + F.col("k.i")).cast("int").alias("col"), weight.alias("w"))
    met = corners.where("w > 0").join(raster, ["cell", "row", "col"], "left")
    return met.groupBy("id").agg(F.when(F.bool_or(F.col("height").isNull()), None).otherwise(F.sum(F.col("height") * F.col("w"))).alias("height"))


def burn_peaks(peaks: DataFrame, raster: DataFrame, radius: int = 1, most: int = 60) -> DataFrame:
    """The samples that summits (id, cell, row, col, ele) raise: cell, row, col, height.

    A summit counts if its own sample is neither void nor sea (0) and its height is within ``most`` of the local maximum.  It
    raises the samples round it, and only those that are lower and not sea.
    """
    own = peaks.join(raster, ["cell", "row", "col"]).where("height IS NOT NULL AND height <> 0").drop("height")
    good = focal_max(raster, own, radius).where(F.abs(F.col("ele") - F.col("local_max")) <= most)
    ring = good.withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    to = ring.groupBy("cell", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col")).agg(F.max("ele").alias("ele"))
    return to.join(raster, ["cell", "row", "col"]).where("height IS NOT NULL AND height <> 0 AND ele > height").select("cell", "row", "col", F.col("ele").alias("height"))


def mended_edges(raster: DataFrame, size: int) -> DataFrame:
    """Rows of the outer lines whose height is void, filled from the line inside where that has a height."""
    inner = lambda c: F.when(F.col(c) == 0, 1).when(F.col(c) == size - 1, size - 2).otherwise(F.col(c))
    edge = raster.where(F.col("height").isNull() & (F.col("row").isin(0, size - 1) | F.col("col").isin(0, size - 1)))
    asked = edge.select("cell", F.col("row").alias("r"), F.col("col").alias("c"), inner("row").alias("row"), inner("col").alias("col"))
    return asked.join(raster.where("height IS NOT NULL"), ["cell", "row", "col"]).select("cell", F.col("r").alias("row"), F.col("c").alias("col"), "height")


def contour_segments(raster: DataFrame, step: int) -> DataFrame:
    """Marching squares: (cell, level, row, col, a, b), the two edges of a sample square that a level's line joins.

    Edges are 0 top, 1 right, 2 bottom, 3 left.  A corner is above a level if strictly so; squares with a void are left
    out; of a saddle the mean of its corners tells which corners belong together.
    """
    square = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (0, 1) for x in (0, 1)])
    at = raster.where("height IS NOT NULL").withColumn("k", F.explode(square))
    pick = lambda y, x: F.max(F.when((F.col("k.y") == y) & (F.col("k.x") == x), F.col("height")))
    squares = at.groupBy("cell", (F.col("row") - F.col("k.y")).alias("row"), (F.col("col") - F.col("k.x")).alias("col")).agg(F.count("*").alias("n"), pick(0, 0).alias("nw"), pick(0, 1).alias("ne"), pick(1, 1).alias("se"), pick(1, 0).alias("sw")).where("n = 4")
    low, high = F.least("nw", "ne", "se", "sw"), F.greatest("nw", "ne", "se", "sw")
    first, last = F.ceil(low / step), F.ceil(high / step) - 1
    levels = squares.where(first <= last).withColumn("level", F.explode(F.sequence(first, last))).withColumn("level", F.col("level") * step)
    above = lambda c: (F.col(c) > F.col("level")).cast("int")
    kind = above("nw") * 8 + above("ne") * 4 + above("se") * 2 + above("sw")
    high_mean = F.col("nw") + F.col("ne") + F.col("se") + F.col("sw") > F.col("level") * 4
    seg = lambda *ab: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ab])
    # fixed values: the pairs of edges by the corners above, nw ne se sw from the high bit
    plain = {1: (2, 3), 2: (1, 2), 3: (1, 3), 4: (0, 1), 6: (0, 2), 7: (0, 3), 8: (0, 3), 9: (0, 2), 11: (0, 1), 12: (1, 3), 13: (1, 2), 14: (2, 3)}
    found = F.when(kind == 5, F.when(high_mean, seg((0, 3), (1, 2))).otherwise(seg((0, 1), (2, 3)))).when(kind == 10, F.when(high_mean, seg((0, 1), (2, 3))).otherwise(seg((0, 3), (1, 2))))
    for k, ab in plain.items():
        found = found.when(kind == k, seg(ab))
    return levels.withColumn("s", F.explode(found)).select("cell", F.col("level").cast("int").alias("level"), "row", "col", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


LINES = "cell int, level int, line int, points int, closed boolean, length long"


def contour_lines(segments: DataFrame) -> DataFrame:
    """Segments joined into lines: (cell, level, line, points, closed, length in segments); open lines first, by their first edge.

    A level of one raster cell is joined by one task; the raster's size bounds it.
    """

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple[int, int, int], list[int]] = {}
        pairs = []
        for i, (r, c, a, b) in enumerate(zip(rows["row"], rows["col"], rows["a"], rows["b"])):
            pair = tuple((r + (e == 2), c, 0) if e % 2 == 0 else (r, c + (e == 1), 1) for e in (a, b))
            pairs.append(pair)
            for p in pair:
                ends.setdefault(p, []).append(i)
        used, out = [False] * len(pairs), []
        starts = sorted(p for p, at in ends.items() if len(at) == 1)
        for start in [*starts, *sorted(ends)]:
            at, n = start, 0
            while nxt := [i for i in ends[at] if not used[i]]:
                used[nxt[0]] = True
                a, b = pairs[nxt[0]]
                at, n = (b if a == at else a), n + 1
            if n:
                out.append((*key, len(out), n + 1, at == start, n))
        return pd.DataFrame(out, columns=["cell", "level", "line", "points", "closed", "length"])

    return segments.groupBy("cell", "level").applyInPandas(join, LINES)


def simplified(points: Column) -> Column:
    """A chain of (y, x) without the inner points that lie on the straight line between their neighbours."""
    before = lambda i: F.get(points, i - 1)
    after = lambda i: F.get(points, i + 1)
    flat = lambda p, i: (p["y"] - before(i)["y"]) * (after(i)["x"] - p["x"]) == (p["x"] - before(i)["x"]) * (after(i)["y"] - p["y"])
    return F.filter(points, lambda p, i: (i == 0) | (i == F.size(points) - 1) | ~flat(p, i))


def resampled(raster: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample of each row and column: (cell, row, col, height), a void staying one."""
    return raster.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).select("cell", (F.col("row") / factor).cast("int").alias("row"), (F.col("col") / factor).cast("int").alias("col"), "height")


def hgt_rows(files: DataFrame) -> DataFrame:
    """(cell_lat, cell_lon, row, heights) of .hgt files read as (path, content); see sources.hgt."""
    from orogena.sources.hgt import parsed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                yield parsed(path, bytes(content))

    return files.select("path", "content").mapInPandas(run, "cell_lat int, cell_lon int, row int, heights array<smallint>")
