"""Queries on region trees, cells and rasters, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogena import views as v
from orogena.operators import rasters, regions
from orogena.plans.registry import Registry

R = Registry()


def _tree(spark: SparkSession, d: str) -> DataFrame:
    nation, region, customer = (v.table(spark, d, t) for t in ("nation", "region", "customer"))
    top = region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("url"))
    mid = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("url"))
    low = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("url"))
    return top.unionByName(mid).unionByName(low)


TREE = """tree AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent, NULL AS url FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END FROM customer)"""


@R.add(
    v.with_(TREE)
    + """SELECT id, name, CAST((CASE WHEN a > 0 THEN a - 1 ELSE b - 1 + 20 END) * 100 + length(name) + CASE WHEN url IS NULL THEN 5000 ELSE 0 END AS BIGINT) AS score
         FROM (SELECT *, instr(lower(name), '12') AS a, instr(lower(id), '12') AS b FROM tree) WHERE a > 0 OR b > 0 ORDER BY score, name, id LIMIT 300"""
)
def region_search(spark: SparkSession, d: str) -> DataFrame:
    return regions.search(_tree(spark, d), "12")


@R.add(v.with_(TREE) + "SELECT id, name FROM tree WHERE parent = 'n3'")
def region_listing(spark: SparkSession, d: str) -> DataFrame:
    return regions.listing(_tree(spark, d), "n3")


@R.add(
    "WITH RECURSIVE "
    + TREE
    + """, up AS (SELECT id, parent AS ancestor, 1 AS depth FROM tree WHERE parent IS NOT NULL
         UNION ALL SELECT up.id, t.parent, depth + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.parent IS NOT NULL AND depth < 12) SELECT * FROM up"""
)
def region_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return regions.ancestors(_tree(spark, d))


@R.add(
    "WITH RECURSIVE "
    + v.MEMBERS
    + """, bad AS (SELECT o_custkey + 1000 AS id FROM orders WHERE o_orderkey % 997 = 0
         UNION SELECT m.relation_id FROM bad JOIN members m ON m.kind = 2 AND m.ref = bad.id) SELECT DISTINCT id FROM bad"""
)
def incomplete_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that hold an incomplete one, at any remove."""
    m = v.members(spark, d)
    seeds = m.where("kind = 1 AND ref % 997 = 0").select(F.col("relation_id").alias("id"))
    return regions.reached(seeds, m.where("kind = 2").select(F.col("ref").alias("id"), F.col("relation_id").alias("holder")))


@R.add(
    "WITH RECURSIVE m AS (SELECT c_custkey AS id, c_custkey // 3 AS t FROM customer WHERE c_custkey // 3 <> c_custkey AND c_custkey % 5 <> 0),"
    + """ walk AS (SELECT id, t, 1 AS k FROM m UNION ALL SELECT walk.id, m.t, k + 1 FROM walk JOIN m ON m.id = walk.t)
         SELECT id, arg_max(t, k) AS into_id FROM walk GROUP BY id"""
)
def merge_chains(spark: SparkSession, d: str) -> DataFrame:
    m = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 3).alias("into")).where("id <> into AND id % 5 <> 0")
    return regions.chain_ends(m).select("id", F.col("into").alias("into_id"))


BOXES = """boxes AS (SELECT s_suppkey AS id, s_suppkey % 60 - 30 + (s_suppkey % 7) / 8.0 AS min_lat, s_suppkey * 3 % 100 - 50 + (s_suppkey % 3) / 4.0 AS min_lon,
  s_suppkey % 60 - 30 + 1 + s_suppkey % 4 AS max_lat, s_suppkey * 3 % 100 - 50 + 2 + s_suppkey % 3 AS max_lon FROM supplier)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return v.table(spark, d, "supplier").select(k.alias("id"), (k % 60 - 30 + (k % 7) / 8.0).alias("min_lat"), (k * 3 % 100 - 50 + (k % 3) / 4.0).alias("min_lon"), (k % 60 - 30 + 1 + k % 4).alias("max_lat"), (k * 3 % 100 - 50 + 2 + k % 3).alias("max_lon"))


FOOT = """foot AS (SELECT DISTINCT CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon FROM (
  SELECT lat, unnest(range(CAST(floor(min_lon) AS BIGINT), CAST(ceil(max_lon) AS BIGINT))) AS lon FROM (SELECT *, unnest(range(CAST(floor(min_lat) AS BIGINT), CAST(ceil(max_lat) AS BIGINT))) AS lat FROM boxes)))"""


@R.add(v.with_(BOXES, FOOT) + "SELECT * FROM foot")
def cell_footprint(spark: SparkSession, d: str) -> DataFrame:
    return regions.footprint(_boxes(spark, d))


@R.add(
    v.with_(BOXES, FOOT)
    + """, runs AS (SELECT lat, min(lon) AS min_lon, max(lon) AS max_lon FROM (SELECT *, lon - row_number() OVER (PARTITION BY lat ORDER BY lon) AS g FROM foot) GROUP BY lat, g)
         SELECT min(lat) AS min_lat, max(lat) AS max_lat, min_lon, max_lon FROM (SELECT *, lat - row_number() OVER (PARTITION BY min_lon, max_lon ORDER BY lat) AS s FROM runs) GROUP BY min_lon, max_lon, s"""
)
def open_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return regions.rectangles(regions.footprint(_boxes(spark, d)))


@R.add(
    v.with_(v.TILES)
    + """SELECT lat, lon FROM (SELECT CAST(-32768 + 250 + range * 500 AS BIGINT) AS lat FROM range(131)), (SELECT CAST(-32768 + 250 + range * 500 AS BIGINT) AS lon FROM range(131))
         WHERE lat < 32768 AND lon < 32768 AND NOT EXISTS (SELECT 1 FROM tiles WHERE tile % 5 <> 2 AND lat >= min_lat AND lat < max_lat AND lon >= min_lon AND lon < max_lon)"""
)
def coverage_holes(spark: SparkSession, d: str) -> DataFrame:
    """Places that no tile covers once every fifth is missing."""
    return regions.coverage_holes((-32768, -32768, 32768, 32768), 500, v.tiles(spark).where("tile % 5 <> 2"))


@R.add(
    """SELECT c_custkey AS cell, (SELECT arg_min(src, pri) FROM (VALUES ('local', 1, 2), ('fine', 2, 3), ('world', 3, 1)) t(src, pri, m) WHERE c_custkey % m = 0 AND NOT (src = 'world' AND c_custkey % 11 = 0)) AS source FROM customer"""
)
def elevation_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each cell's first source in the list that has it."""
    cells = v.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    lists = spark.createDataFrame([("local", 1, 2), ("fine", 2, 3), ("world", 3, 1)], "source string, priority int, m int")
    offers = cells.join(F.broadcast(lists), (F.col("cell") % F.col("m") == 0) & ~((F.col("source") == "world") & (F.col("cell") % 11 == 0)))
    return regions.first_source(cells, offers)


@R.add(
    """WITH RECURSIVE t AS (SELECT c_nationkey, c_custkey, CAST(abs(c_acctbal) AS DOUBLE) AS w, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
       p AS (SELECT c_nationkey, c_custkey, k, w AS s, 0 AS bin FROM t WHERE k = 1
         UNION ALL SELECT t.c_nationkey, t.c_custkey, t.k, CASE WHEN p.s > 0 AND p.s + t.w > 20000 THEN t.w ELSE p.s + t.w END, CASE WHEN p.s > 0 AND p.s + t.w > 20000 THEN p.bin + 1 ELSE p.bin END
         FROM p JOIN t ON t.c_nationkey = p.c_nationkey AND t.k = p.k + 1)
       SELECT c_custkey, c_nationkey, bin FROM p"""
)
def packed_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Customers packed into bins of their nation by balance, next fit."""
    c = v.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return regions.next_fit(c, "c_nationkey", ["c_custkey"], F.abs("c_acctbal"), 20_000).select("c_custkey", "c_nationkey", "bin")


@R.add(
    v.with_(TREE)
    + """, s AS (SELECT id, length(name) * 1000 + CAST(substr(id, 2) AS INTEGER) % 977 AS drawn, CAST(substr(id, 2) AS INTEGER) % 13 AS share FROM tree WHERE parent IS NOT NULL),
       tiers AS (SELECT *, 1 AS tier FROM s WHERE share >= 11 AND drawn % 50 = 0 UNION ALL SELECT *, 2 FROM s WHERE share >= 8 UNION ALL SELECT *, 3 FROM s),
       used AS (SELECT min(tier) AS t FROM (SELECT tier FROM tiers GROUP BY tier HAVING count(*) >= 4))
       SELECT id, share FROM tiers JOIN used ON tier = t ORDER BY share DESC, id LIMIT 12"""
)
def suggested_regions(spark: SparkSession, d: str) -> DataFrame:
    """The first tier of candidates that has four, by share."""
    n = F.substring("id", 2, 20).cast("int")
    s = _tree(spark, d).where("parent IS NOT NULL").select("id", (F.length("name") * 1000 + n % 977).alias("drawn"), (n % 13).alias("share"))
    tier = F.explode(F.filter(F.array(F.when((F.col("share") >= 11) & (F.col("drawn") % 50 == 0), 1), F.when(F.col("share") >= 8, 2), F.lit(3)), lambda x: x.isNotNull()))
    tiers = s.withColumn("tier", tier)
    used = tiers.groupBy("tier").agg(F.count("*").alias("n")).where("n >= 4").agg(F.min("tier").alias("tier"))
    return tiers.join(F.broadcast(used), "tier").select("id", "share").orderBy(F.desc("share"), "id").limit(12)


CENTRES = """centres AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey % 5 AS INTEGER) AS cell, CAST(s_suppkey * 37 % 128 AS INTEGER) AS "row", CAST(s_suppkey * 53 % 128 AS INTEGER) AS col, CAST(s_suppkey * 11 % 260 AS INTEGER) AS ele FROM supplier)"""


def _centres(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return v.table(spark, d, "supplier").select(k.alias("id"), (k % 5).cast("int").alias("cell"), (k * 37 % 128).cast("int").alias("row"), (k * 53 % 128).cast("int").alias("col"), (k * 11 % 260).cast("int").alias("ele"))


@R.add(v.with_(v.RASTER, CENTRES) + 'SELECT c.id, max(height) AS local_max FROM centres c JOIN raster r ON r.cell = c.cell AND abs(r."row" - c."row") <= 2 AND abs(r.col - c.col) <= 2 GROUP BY c.id')
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return rasters.focal_max(v.raster(spark, d), _centres(spark, d), 2).select("id", "local_max")


@R.add(
    v.with_(v.RASTER)
    + """SELECT a.cell, a."row", a.col, max(abs(a.height - b.height)) AS rise FROM raster a JOIN raster b ON a.cell = b.cell AND
         ((a."row" = b."row" AND (a.col = b.col + 1 OR a.col = b.col - 1)) OR (a.col = b.col AND (a."row" = b."row" + 1 OR a."row" = b."row" - 1)))
         WHERE a.height IS NOT NULL AND b.height IS NOT NULL GROUP BY ALL"""
)
def slopes(spark: SparkSession, d: str) -> DataFrame:
    return rasters.steepest(v.raster(spark, d))


@R.add(
    v.with_(v.RASTER)
    + """, p AS (SELECT c_custkey AS id, CAST(c_custkey % 5 AS INTEGER) AS cell, c_custkey * 29 % 1000 AS y, c_custkey * 41 % 1000 AS x FROM customer),
       k AS (SELECT id, p.cell, y // 8 + j AS r, x // 8 + i AS c, (CASE j WHEN 0 THEN 8 - y % 8 ELSE y % 8 END) * (CASE i WHEN 0 THEN 8 - x % 8 ELSE x % 8 END) AS w FROM p, (VALUES (0), (1)) a(j), (VALUES (0), (1)) b(i))
       SELECT id, CASE WHEN bool_or(height IS NULL) THEN NULL ELSE CAST(sum(height * w) AS BIGINT) END AS height FROM k LEFT JOIN raster ON raster.cell = k.cell AND "row" = r AND col = c WHERE w > 0 GROUP BY id"""
)
def bilinear_heights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    p = v.table(spark, d, "customer").select(k.alias("id"), (k % 5).cast("int").alias("cell"), (k * 29 % 1000).alias("y"), (k * 41 % 1000).alias("x"))
    return rasters.bilinear(p, v.raster(spark, d), 8)


@R.add(
    v.with_(v.RASTER, CENTRES)
    + """, good AS (SELECT c.* FROM centres c JOIN raster o ON o.cell = c.cell AND o."row" = c."row" AND o.col = c.col JOIN raster r ON r.cell = c.cell AND abs(r."row" - c."row") <= 1 AND abs(r.col - c.col) <= 1
         WHERE o.height <> 0 GROUP BY ALL HAVING abs(c.ele - max(r.height)) <= 60)
       SELECT r.cell, r."row", r.col, max(ele) AS height FROM good g JOIN raster r ON r.cell = g.cell AND abs(r."row" - g."row") <= 1 AND abs(r.col - g.col) <= 1 WHERE r.height <> 0 GROUP BY r.cell, r."row", r.col, r.height HAVING max(ele) > r.height"""
)
def burnt_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rasters.burn_peaks(_centres(spark, d), v.raster(spark, d))


@R.add(
    v.with_(v.RASTER)
    + """, v AS (SELECT *, CASE "row" WHEN 0 THEN lead(height) OVER c WHEN 127 THEN lag(height) OVER c ELSE height END AS inner_row FROM raster WINDOW c AS (PARTITION BY cell, col ORDER BY "row")),
       h AS (SELECT *, CASE col WHEN 0 THEN lead(inner_row) OVER r WHEN 127 THEN lag(inner_row) OVER r ELSE inner_row END AS inside FROM v WINDOW r AS (PARTITION BY cell, "row" ORDER BY col))
       SELECT cell, "row", col, inside AS height FROM h WHERE height IS NULL AND ("row" IN (0, 127) OR col IN (0, 127)) AND inside IS NOT NULL"""
)
def mended_edges(spark: SparkSession, d: str) -> DataFrame:
    return rasters.mended_edges(v.raster(spark, d), 128)


SQUARES = """q AS (SELECT * FROM (SELECT cell, "row", col, nw, ne, lead(ne) OVER c AS se, lead(nw) OVER c AS sw
      FROM (SELECT cell, "row", col, height AS nw, lead(height) OVER r AS ne FROM raster WINDOW r AS (PARTITION BY cell, "row" ORDER BY col)) WINDOW c AS (PARTITION BY cell, col ORDER BY "row"))
    WHERE nw IS NOT NULL AND ne IS NOT NULL AND se IS NOT NULL AND sw IS NOT NULL),
  l AS (SELECT *, CAST(range * 50 AS INTEGER) AS level FROM q, range(0, 8) WHERE least(nw, ne, se, sw) <= range * 50 AND greatest(nw, ne, se, sw) > range * 50),
  k AS (SELECT *, (nw > level)::INT * 8 + (ne > level)::INT * 4 + (se > level)::INT * 2 + (sw > level)::INT AS k, nw + ne + se + sw > 4 * level AS hm FROM l),
  t(k, hm, a, b) AS (VALUES (1, NULL, 2, 3), (2, NULL, 1, 2), (3, NULL, 1, 3), (4, NULL, 0, 1), (6, NULL, 0, 2), (7, NULL, 0, 3), (8, NULL, 0, 3), (9, NULL, 0, 2), (11, NULL, 0, 1), (12, NULL, 1, 3), (13, NULL, 1, 2), (14, NULL, 2, 3),
    (5, true, 0, 3), (5, true, 1, 2), (5, false, 0, 1), (5, false, 2, 3), (10, true, 0, 1), (10, true, 2, 3), (10, false, 0, 3), (10, false, 1, 2))"""


@R.add(v.with_(v.RASTER, SQUARES) + 'SELECT cell, level, "row", col, a, b FROM k JOIN t ON t.k = k.k AND (t.hm IS NULL OR t.hm = k.hm)')
def contour_segments(spark: SparkSession, d: str) -> DataFrame:
    return rasters.contour_segments(v.raster(spark, d), 50)


@R.add()
def contour_lines(spark: SparkSession, d: str) -> DataFrame:
    """Contours joined from their segments; every segment is in one line."""
    return rasters.contour_lines(rasters.contour_segments(v.raster(spark, d), 50))


@R.add(v.with_(v.RASTER) + 'SELECT cell, CAST("row" / 4 AS INTEGER) AS "row", CAST(col / 4 AS INTEGER) AS col, height FROM raster WHERE "row" % 4 = 0 AND col % 4 = 0')
def resampled(spark: SparkSession, d: str) -> DataFrame:
    return rasters.resampled(v.raster(spark, d), 4)


@R.add(
    """SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, g"""
)
def runs_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events without a gap of over six hours: islands, as along a line in and out of water."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = v.table(spark, d, "events").withColumn("brk", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS")).cast("int"), F.lit(0)))
    return e.withColumn("g", F.sum("brk").over(w)).groupBy("user_id", "g").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).select("user_id", "start_ts", "end_ts", "n")
