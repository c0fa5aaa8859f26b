"""Queries on height rasters made of the map's node density, and on outlines, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogena import views as v
from orogena.operators import areas, borders, contours, polygons, rasters, tiling
from orogena.plans.registry import Registry
from orogena.storage import written

R = Registry()

#: The levels of contours of node density.
STEP = 4

SQUARES = """squares AS (
  SELECT * FROM (
    SELECT cell, "row", col, nw, ne, CASE WHEN lead("row") OVER c = "row" + 1 THEN lead(nw) OVER c END AS sw, CASE WHEN lead("row") OVER c = "row" + 1 THEN lead(ne) OVER c END AS se
    FROM (SELECT cell, "row", col, height AS nw, CASE WHEN lead(col) OVER r = col + 1 THEN lead(height) OVER r END AS ne
          FROM raster WHERE height IS NOT NULL WINDOW r AS (PARTITION BY cell, "row" ORDER BY col)) WINDOW c AS (PARTITION BY cell, col ORDER BY "row"))
  WHERE ne IS NOT NULL AND sw IS NOT NULL AND se IS NOT NULL)"""

SEGMENTS = f"""crossed AS (
  SELECT *, CAST(k * {STEP} AS INTEGER) AS level FROM (
    SELECT *, unnest(range(CAST(ceil(least(nw, ne, sw, se) / {STEP}) AS INTEGER), CAST(ceil(greatest(nw, ne, sw, se) / {STEP}) AS INTEGER))) AS k FROM squares)),
edges AS (
  SELECT *, nw > level AS a, ne > level AS b, se > level AS c, sw > level AS d, nw + ne + se + sw > level * 4 AS mean,
         CAST("row" * 1048576 + col AS BIGINT) * 2 AS top, CAST(("row" + 1) * 1048576 + col AS BIGINT) * 2 AS bottom,
         CAST("row" * 1048576 + col AS BIGINT) * 2 + 1 AS "left", CAST("row" * 1048576 + col + 1 AS BIGINT) * 2 + 1 AS "right" FROM crossed),
segments AS MATERIALIZED (
  SELECT cell, level, "row", col, p[1] AS a, p[2] AS b FROM (
    SELECT cell, level, "row", col, unnest(CASE
      WHEN a <> b AND b <> c AND c <> d THEN CASE WHEN mean = a THEN [[top, "right"], ["left", bottom]] ELSE [[top, "left"], ["right", bottom]] END
      ELSE [list_filter([CASE WHEN a <> b THEN top END, CASE WHEN c <> d THEN bottom END, CASE WHEN a <> d THEN "left" END, CASE WHEN b <> c THEN "right" END], lambda x: x IS NOT NULL)] END) AS p
    FROM edges))"""


@R.add(v.with_(v.NODES, v.DENSITY_RASTER, SQUARES, SEGMENTS) + 'SELECT cell, level, "row", col, least(a, b) AS a, greatest(a, b) AS b FROM segments')
def density_segments(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of crossings that levels of node density join in each square."""
    found = contours.segments(v.density_raster(spark, d), STEP)
    return found.select("cell", "level", "row", "col", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@R.add(
    v.with_(v.NODES, v.DENSITY_RASTER, SQUARES, SEGMENTS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, links AS MATERIALIZED (SELECT cell, level, a, b FROM segments UNION ALL SELECT cell, level, b, a FROM segments),
    degree AS (SELECT cell, level, a AS node, count(*) AS n FROM links GROUP BY ALL),
    label(cell, level, node, label) USING KEY (cell, level, node) AS (
      SELECT cell, level, node, node FROM degree
      UNION
      SELECT k.cell, k.level, k.b, min(l.label) FROM label l JOIN links k ON k.cell = l.cell AND k.level = l.level AND k.a = l.node
      JOIN recurring.label o ON o.cell = k.cell AND o.level = k.level AND o.node = k.b WHERE l.label < o.label GROUP BY k.cell, k.level, k.b)
    SELECT cell, level, CASE WHEN min(n) = 2 THEN min(node) ELSE min(node) FILTER (n = 1) END AS line, min(n) = 2 AS closed, count(*) + CASE WHEN min(n) = 2 THEN 1 ELSE 0 END AS points
    FROM label JOIN degree USING (cell, level, node) GROUP BY cell, level, label"""
)
def density_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each contour of node density: the crossing that it begins at, whether it closes, its points."""
    points = contours.line_points(v.density_raster(spark, d), STEP)
    return points.groupBy("cell", "level", "line", "closed").agg(F.count("*").alias("points"))


@R.add(
    v.with_(v.NODES, v.DENSITY_RASTER, SQUARES, SEGMENTS)
    + """, ends AS (SELECT DISTINCT cell, level, key FROM (SELECT cell, level, unnest([a, b]) AS key FROM segments)),
    open_ends AS (SELECT cell, level, key FROM (SELECT cell, level, unnest([a, b]) AS key FROM segments) GROUP BY ALL HAVING count(*) = 1),
    placed AS (SELECT e.cell, level, key, p.height AS h, q.height AS g, key % 2 AS south, (key // 2) // 1048576 AS y, (key // 2) % 1048576 AS x
           FROM ends e JOIN raster p ON p.cell = e.cell AND p."row" = (key // 2) // 1048576 AND p.col = (key // 2) % 1048576
           JOIN raster q ON q.cell = e.cell AND q."row" = (key // 2) // 1048576 + key % 2 AND q.col = (key // 2) % 1048576 + 1 - key % 2)
    SELECT placed.cell, placed.level, key, CAST(floor((y + CASE WHEN south = 1 THEN (placed.level - h) / (g - h) ELSE 0 END) * 1000000) AS BIGINT) AS y,
           CAST(floor((x + CASE WHEN south = 1 THEN 0 ELSE (placed.level - h) / (g - h) END) * 1000000) AS BIGINT) AS x, o.key IS NOT NULL AS at_end
    FROM placed LEFT JOIN open_ends o USING (cell, level, key)"""
)
def density_points(spark: SparkSession, d: str) -> DataFrame:
    """Every crossing of a contour of node density with its interpolated place, in millionths of a sample, and whether a line ends there."""
    points = contours.line_points(v.density_raster(spark, d), STEP)
    last = F.max("pos").over(contours.Window.partitionBy("cell", "level", "line", "closed"))
    at_end = ~F.col("closed") & ((F.col("pos") == 0) | (F.col("pos") == last))
    million = lambda c: F.floor(F.col(c) * 1000000).cast("long").alias(c)
    return points.select("*", at_end.alias("at_end")).where("NOT closed OR pos > 0").select("cell", "level", "key", million("y"), million("x"), "at_end")


RIGHT = """(a_lat > lat_u) <> (b_lat > lat_u) AND CASE WHEN b_lat > a_lat THEN CAST(lon_u - a_lon AS BIGINT) * (b_lat - a_lat) < CAST(lat_u - a_lat AS BIGINT) * (b_lon - a_lon)
  ELSE CAST(lon_u - a_lon AS BIGINT) * (b_lat - a_lat) > CAST(lat_u - a_lat AS BIGINT) * (b_lon - a_lon) END"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return polygons.ring_edges(v.outlines(spark, d), ["region", "ring", "hole"])


@R.add(
    v.with_(v.NODES, v.OUTLINES)
    + f"""SELECT region, id AS node_id FROM (SELECT region, ring, hole, id FROM outline_edges, nodes WHERE {RIGHT} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY region, id HAVING NOT bool_or(hole)"""
)
def nodes_in_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that each nation's outline holds, its holes left out."""
    points = v.nodes(spark, d).select("id", "lat_u", "lon_u")
    return polygons.points_in_outlines(points, _edges(spark, d)).select("region", F.col("id").alias("node_id"))


CELLS = """cut AS (
  SELECT region, ring, hole, cy, a_lon + (b_lon - a_lon) * (cy * 256 + 128.0::DOUBLE - a_lat) / (b_lat - a_lat) AS x
  FROM (SELECT *, unnest(range(CAST(floor(least(a_lat, b_lat) / 256) - 1 AS BIGINT), CAST(floor(greatest(a_lat, b_lat) / 256) + 2 AS BIGINT))) AS cy FROM outline_edges)
  WHERE (a_lat > cy * 256 + 128) <> (b_lat > cy * 256 + 128)),
spans AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x1, row_number() OVER w % 2 AS odd FROM cut WINDOW w AS (PARTITION BY region, ring, hole, cy ORDER BY x)) WHERE odd = 1 AND x1 IS NOT NULL),
cells AS (SELECT region, cy, cx FROM (SELECT region, hole, cy, unnest(range(CAST(floor(x / 256) AS BIGINT), CAST(ceil(x1 / 256) + 1 AS BIGINT))) AS cx FROM spans) GROUP BY region, cy, cx HAVING NOT bool_or(hole))"""


@R.add(
    v.with_(v.OUTLINES, CELLS)
    + """, wide AS (SELECT DISTINCT cy, cx + g AS cx FROM cells, (VALUES (-1), (0), (1)) AS t(g))
         SELECT DISTINCT cy + g AS cy, cx FROM wide, (VALUES (-1), (0), (1)) AS t(g)"""
)
def outline_ground(spark: SparkSession, d: str) -> DataFrame:
    """The cells of 256 units that any nation's outline covers, without its own holes, grown by one cell."""
    return polygons.ground(_edges(spark, d), 256, reach=1)


TOUCH = """(a_lat >= min_lat OR b_lat >= min_lat) AND (a_lat < max_lat OR b_lat < max_lat) AND (a_lon >= min_lon OR b_lon >= min_lon) AND (a_lon < max_lon OR b_lon < max_lon)
  AND (a_lat >= min_lat AND a_lat < max_lat AND a_lon >= min_lon AND a_lon < max_lon OR b_lat >= min_lat AND b_lat < max_lat AND b_lon >= min_lon AND b_lon < max_lon OR NOT (
    least(s00, s01, s10, s11) > 0 OR greatest(s00, s01, s10, s11) < 0))"""
MET = """met AS (SELECT DISTINCT region, tile FROM (
  SELECT e.*, t.*, {sides} FROM outline_edges e, tiles t {where}) WHERE {touch})""".replace(
    "{sides}", ", ".join(f"sign(CAST(b_lon - a_lon AS BIGINT) * ({y} - a_lat) - CAST(b_lat - a_lat AS BIGINT) * ({x} - a_lon)) AS s{i}{j}" for i, y in enumerate(("min_lat", "max_lat")) for j, x in enumerate(("min_lon", "max_lon")))
).replace("{touch}", TOUCH)


@R.add(
    v.with_(v.OUTLINES, v.TILES, MET.replace("{where}", ""))
    + f"""SELECT region AS "group", tile FROM met UNION
         SELECT region, tile FROM (SELECT region, tile FROM outline_edges, (SELECT tile, CAST(floor((min_lat + max_lat) / 2) AS INTEGER) AS lat_u, CAST(floor((min_lon + max_lon) / 2) AS INTEGER) AS lon_u FROM tiles) WHERE {RIGHT} GROUP BY ALL HAVING count(*) % 2 = 1)"""
)
def claimed_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that an outline's rings cross or swallow; all rings of an outline count together."""
    return polygons.claimed_tiles(_edges(spark, d).withColumn("group", F.col("region")), v.tiles(spark))


@R.add(
    v.with_(v.OUTLINES, v.TILES, MET.replace("{where}", "WHERE NOT hole"))
    + f"""SELECT region, tile FROM met UNION
         SELECT region, tile FROM (SELECT region, ring, tile, lat_u, lon_u FROM outline_edges, (SELECT tile, unnest([min_lat, max_lat]) AS lat_u, min_lon, max_lon FROM tiles), LATERAL (SELECT unnest([min_lon, max_lon]) AS lon_u)
           WHERE NOT hole AND {RIGHT} GROUP BY ALL HAVING count(*) % 2 = 1)"""
)
def touched_cells(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that an outline touches with an edge or holds a corner of, holes left out of account."""
    return polygons.touched_cells(_edges(spark, d), v.tiles(spark))


SAMPLES = """samples AS MATERIALIZED (SELECT y, x, max(height) AS height FROM (SELECT (cell // 2) * 64 + "row" AS y, cell % 2 * 64 + col AS x, height FROM raster) GROUP BY y, x)"""


def _corners(spark: SparkSession, raster: DataFrame) -> DataFrame:
    """The rasters' places: the first two are north of the others."""
    return raster.select("cell").distinct().select("cell", (-F.floor(F.col("cell") / 2)).cast("int").alias("lat"), (F.col("cell") % 2).cast("int").alias("lon"))


@R.add(
    v.with_(v.NODES, v.DENSITY_RASTER, SAMPLES)
    + """SELECT cell, "row", col, max(s.height) AS local_max FROM raster c JOIN samples s ON s.y BETWEEN (cell // 2) * 64 + "row" - 3 AND (cell // 2) * 64 + "row" + 3 AND s.x BETWEEN cell % 2 * 64 + col - 3 AND cell % 2 * 64 + col + 3
         WHERE ("row" * 65 + col) % 7 = 0 GROUP BY cell, "row", col"""
)
def maxima_over_borders(spark: SparkSession, d: str) -> DataFrame:
    """The greatest node density within three samples, seen over the borders of rasters."""
    raster = written(v.density_raster(spark, d), "raster")
    centres = raster.where("(row * 65 + col) % 7 = 0").select("cell", "row", "col")
    return rasters.focal_max(borders.with_halo(raster, _corners(spark, raster), 65, 3), centres, 3)


@R.add(
    v.with_(v.NODES, v.DENSITY_RASTER)
    + """, dead AS (SELECT cell, "row", col, CASE WHEN cell = 0 AND col = 64 OR cell = 2 AND col = 64 OR cell = 3 AND (col = 0 OR "row" = 0) THEN 0 ELSE height + 1 END AS height FROM raster)
       SELECT 0 AS cell, "row", 64 AS col, height, 'east' AS edge FROM dead WHERE cell = 1 AND col = 0
       UNION ALL SELECT 2, "row", 64, height, 'east' FROM dead WHERE cell = 2 AND col = 63
       UNION ALL SELECT 3, "row", 0, height, 'west' FROM dead WHERE cell = 3 AND col = 1 AND "row" > 0
       UNION ALL SELECT 3, 0, col, height, 'north' FROM dead WHERE cell = 1 AND "row" = 64"""
)
def edges_over_borders(spark: SparkSession, d: str) -> DataFrame:
    """Dead edges of rasters of node density: two take their neighbours' edges, two that face each other their own lines inside."""
    raster = written(v.density_raster(spark, d), "raster")
    cell, row, col = F.col("cell"), F.col("row"), F.col("col")
    dead = ((cell == 0) & (col == 64)) | ((cell == 2) & (col == 64)) | ((cell == 3) & ((col == 0) | (row == 0)))
    told = raster.select("cell", "row", "col", F.when(dead, 0).otherwise(F.col("height") + 1).alias("height"))
    return borders.repaired_edges(told, _corners(spark, raster), 65)


LOADED = """loaded AS (SELECT t.*, count(id) AS n FROM tiles t LEFT JOIN nodes ON lat_u >= min_lat AND lat_u < max_lat AND lon_u >= min_lon AND lon_u < max_lon GROUP BY ALL),
failed AS (SELECT tile FROM loaded WHERE n > (SELECT avg(n) FROM loaded))"""


@R.add(
    v.with_(v.NODES, v.TILES, LOADED)
    + """SELECT tile, part, CAST(CASE WHEN part = 1 THEN min_lat + 4096 ELSE min_lat END AS INTEGER) AS min_lat, min_lon, CAST(CASE WHEN part = 0 AND halved THEN min_lat + 4096 ELSE max_lat END AS INTEGER) AS max_lat, max_lon
         FROM (SELECT *, tile IN (SELECT tile FROM failed) AS halved FROM tiles), (VALUES (0), (1)) AS p(part) WHERE part = 0 OR halved"""
)
def refined_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with more nodes than the mean cut in two."""
    tiles = v.tiles(spark)
    tile = (F.shiftright(F.col("lat_u") + 32768, 13) * 8 + F.shiftright(F.col("lon_u") + 32768, 13)).alias("tile")
    counts = tiles.select("tile").join(v.nodes(spark, d).select(tile).groupBy("tile").agg(F.count("*").alias("n")), "tile", "left").select("tile", F.coalesce("n", F.lit(0)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return areas.refined(tiles, counts.join(F.broadcast(mean), F.col("n") > F.col("mean")).select("tile"))  # the mean is one row


@R.add(
    v.with_(v.NODES)
    + """, c AS (SELECT DISTINCT floor(((lon_u * 64 + {shift} + 8388608) % 16777216 - 8388608) / 2048)::BIGINT AS cx, floor(lat_u / 2048)::BIGINT AS cy FROM nodes),
       b AS (SELECT min(cy) AS y0, max(cy) + 1 AS y1, min(cx) AS x0, max(cx) + 1 AS x1 FROM c),
       g AS (SELECT cx + 1 AS place, lead(cx) OVER (ORDER BY cx) - cx - 1 AS run FROM (SELECT DISTINCT cx FROM c)),
       w AS (SELECT * FROM g WHERE run > 0 ORDER BY run DESC, place LIMIT 1),
       t AS (SELECT *, 4096 - x1 + x0 + 4096 AS out FROM b LEFT JOIN w ON true)
       SELECT 0 AS part, y0::INTEGER AS min_cy, (CASE WHEN run > out AND out < 16 THEN -4096 ELSE x0 END)::INTEGER AS min_cx, y1::INTEGER AS max_cy, (CASE WHEN run > out THEN place ELSE x1 END)::INTEGER AS max_cx FROM t WHERE y0 IS NOT NULL
       UNION ALL SELECT 1, y0::INTEGER, (place + run)::INTEGER, y1::INTEGER, (CASE WHEN out < 16 THEN 4096 ELSE x1 END)::INTEGER FROM t WHERE run > out""".replace("{shift}", "8000000")
)
def seam_ground(spark: SparkSession, d: str) -> DataFrame:
    """Where cutting starts for nodes spread around 180 degrees: the two sides of it."""
    lon = F.pmod(F.col("lon_u") * 64 + 8000000 + 8388608, F.lit(16777216)) - 8388608
    cells = v.nodes(spark, d).select(F.floor(F.col("lat_u") / 2048).alias("cy"), F.floor(lon / 2048).alias("cx")).distinct()
    return areas.ground(cells)


@R.add(
    v.with_(v.NODES, v.TILES)
    + """, m AS (SELECT * REPLACE (CAST(CASE WHEN min_lat <> 0 AND min_lat % 16384 = 0 AND min_lat > -32768 THEN min_lat + 2048 ELSE min_lat END AS INTEGER) AS min_lat, CAST(CASE WHEN max_lat <> 0 AND max_lat % 16384 = 0 AND max_lat < 32768 THEN max_lat + 2048 ELSE max_lat END AS INTEGER) AS max_lat,
         CAST(CASE WHEN min_lon <> 0 AND min_lon % 16384 = 0 AND min_lon > -32768 THEN min_lon + 2048 ELSE min_lon END AS INTEGER) AS min_lon, CAST(CASE WHEN max_lon <> 0 AND max_lon % 16384 = 0 AND max_lon < 32768 THEN max_lon + 2048 ELSE max_lon END AS INTEGER) AS max_lon) FROM tiles)
       SELECT tile, count(id) AS nodes, min_lat, min_lon, max_lat, max_lon FROM m LEFT JOIN nodes ON lat_u >= min_lat AND lat_u < max_lat AND lon_u >= min_lon AND lon_u < max_lon GROUP BY ALL"""
)
def nudged_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles whose borders on multiples of 16,384 units moved by a cell, and the nodes that each has then."""
    moved = areas.nudged(v.tiles(spark), stride=16384)
    inside = (F.col("lat_u") < F.col("max_lat")) & (F.col("lon_u") < F.col("max_lon"))
    held = tiling.point_tiles(v.nodes(spark, d).select("id", "lat_u", "lon_u"), moved, bits=13).join(moved, "tile").where(inside).groupBy("tile").agg(F.count("*").alias("nodes"))
    return moved.join(held, "tile", "left").select("tile", F.coalesce("nodes", F.lit(0)).alias("nodes"), "min_lat", "min_lon", "max_lat", "max_lon")
