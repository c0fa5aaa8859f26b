"""Deterministic map data over the benchmark tables, as DataFrames and as the SQL that oracles start with.

Coordinates are whole map units, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat_u, lon_u, tags): the pairs of part and supplier that lineitem has."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    found = pairs.join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size"), part == F.col("p_partkey"))
    return found.select(
        (part * 100000 + supp).alias("id"),
        ((part * 7919 + supp * 104729) % 65536 - 32768).cast("int").alias("lat_u"),
        ((part * 15485 + supp * 32452) % 65536 - 32768).cast("int").alias("lon_u"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("tags"),
    )


NODES = """nodes AS (
  SELECT DISTINCT l_partkey * 100000 + l_suppkey AS id,
         CAST((l_partkey * 7919 + l_suppkey * 104729) % 65536 - 32768 AS INTEGER) AS lat_u,
         CAST((l_partkey * 15485 + l_suppkey * 32452) % 65536 - 32768 AS INTEGER) AS lon_u,
         p_type AS t_type, p_brand AS t_brand, CAST(p_size AS VARCHAR) AS t_size
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags): the orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")).alias("tags"),
    )


WAYS = """ways AS (SELECT o_orderkey AS id, o_orderpriority AS t_priority, o_orderstatus AS t_status FROM orders)"""


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, node_id): the lines of an order in a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("way_id"), (F.row_number().over(order) - 1).alias("pos"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("node_id")
    )


WAY_REFS = """way_refs AS (
  SELECT l_orderkey AS way_id, l_partkey * 100000 + l_suppkey AS node_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS pos
  FROM lineitem)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation_id, kind, ref, role): customers hold their orders (kind 1), nations customers and regions nations (kind 2)."""
    role = F.element_at(F.array(F.lit("outer"), F.lit("inner"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    held = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1000).alias("relation_id"), F.lit(1).alias("kind"), F.col("o_orderkey").alias("ref"), role.alias("role"))
    of_nation = customer.select((F.col("c_nationkey") + 100).cast("long").alias("relation_id"), F.lit(2).alias("kind"), (F.col("c_custkey") + 1000).alias("ref"), F.lit("").alias("role"))
    of_region = nation.select(F.col("n_regionkey").cast("long").alias("relation_id"), F.lit(2).alias("kind"), (F.col("n_nationkey") + 100).cast("long").alias("ref"), F.lit("").alias("role"))
    return held.unionByName(of_nation).unionByName(of_region)


MEMBERS = """members AS (
  SELECT o_custkey + 1000 AS relation_id, 1 AS kind, o_orderkey AS ref, ['outer', 'inner', ''][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS role FROM orders
  UNION ALL SELECT CAST(c_nationkey + 100 AS BIGINT), 2, c_custkey + 1000, '' FROM customer
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), 2, CAST(n_nationkey + 100 AS BIGINT), '' FROM nation)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, row, col, height): 128 x 128 heights a cell, one cell for each region; every 97th is void."""
    r, c, k = F.col("row"), F.col("col"), F.col("cell")
    grid = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("cell")).select("cell", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("col"))
    height = (r * r + 3 * c * c + r * c * (k + 2) + 17 * k) % 211 + F.floor((r + c) / 4)
    return grid.select("cell", "row", "col", F.when((r * 128 + c + k) % 97 != 0, height.cast("int")).alias("height"))


RASTER = """raster AS MATERIALIZED (
  SELECT cell, "row", col, CASE WHEN ("row" * 128 + col + cell) % 97 <> 0
           THEN CAST(("row" * "row" + 3 * col * col + "row" * col * (cell + 2) + 17 * cell) % 211 + floor(("row" + col) / 4) AS INTEGER) END AS height
  FROM (SELECT CAST(r_regionkey AS INTEGER) AS cell FROM region),
       (SELECT CAST(range AS INTEGER) AS "row" FROM range(128)), (SELECT CAST(range AS INTEGER) AS col FROM range(128)))"""


def tiles(spark: SparkSession, side: int = 8) -> DataFrame:
    """(tile, min_lat, min_lon, max_lat, max_lon): a grid of side x side half-open rectangles over all nodes."""
    step = 65536 // side
    i, j = F.floor(F.col("id") / side), F.col("id") % side
    return spark.range(side * side).select(
        F.col("id").cast("int").alias("tile"), (i * step - 32768).cast("int").alias("min_lat"), (j * step - 32768).cast("int").alias("min_lon"), ((i + 1) * step - 32768).cast("int").alias("max_lat"), ((j + 1) * step - 32768).cast("int").alias("max_lon")
    )


TILES = """tiles AS (
  SELECT CAST(range AS INTEGER) AS tile, CAST(floor(range / 8) * 8192 - 32768 AS INTEGER) AS min_lat, CAST(range % 8 * 8192 - 32768 AS INTEGER) AS min_lon,
         CAST((floor(range / 8) + 1) * 8192 - 32768 AS INTEGER) AS max_lat, CAST((range % 8 + 1) * 8192 - 32768 AS INTEGER) AS max_lon
  FROM range(64))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def density_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, row, col, height): nodes in each of 128 x 128 squares of the map, as four rasters that share their inner borders; every 97th is void."""
    nodes_of = nodes(spark, sf_dir).groupBy(F.shiftright(F.col("lat_u") + 32768, 9).alias("y"), F.shiftright(F.col("lon_u") + 32768, 9).alias("x")).agg(F.count("*").cast("int").alias("n"))
    grid = spark.range(128 * 128).select(F.floor(F.col("id") / 128).cast("int").alias("y"), (F.col("id") % 128).cast("int").alias("x"))
    y, x = F.col("y"), F.col("x")
    samples = grid.join(nodes_of, ["y", "x"], "left").select("y", "x", F.when((y * 128 + x) % 97 != 0, F.coalesce("n", F.lit(0))).alias("height"))
    two = lambda c: F.explode(F.array_compact(F.array(F.when(c <= 64, 0), F.when(c >= 64, 1))))
    at = samples.select("y", "x", "height", two(y).alias("cy")).select("*", two(x).alias("cx"))
    return at.select((F.col("cy") * 2 + F.col("cx")).alias("cell"), (y - F.col("cy") * 64).alias("row"), (x - F.col("cx") * 64).alias("col"), "height")


DENSITY_RASTER = """raster AS MATERIALIZED (
  WITH c AS (SELECT (lat_u + 32768) >> 9 AS y, (lon_u + 32768) >> 9 AS x, CAST(count(*) AS INTEGER) AS n FROM nodes GROUP BY ALL),
  g AS (SELECT CAST(range // 128 AS INTEGER) AS y, CAST(range % 128 AS INTEGER) AS x FROM range(16384)),
  s AS (SELECT g.y, g.x, CASE WHEN (g.y * 128 + g.x) % 97 <> 0 THEN coalesce(n, 0) END AS height FROM g LEFT JOIN c ON c.y = g.y AND c.x = g.x)
  SELECT CAST(cy * 2 + cx AS INTEGER) AS cell, CAST(y - cy * 64 AS INTEGER) AS "row", CAST(x - cx * 64 AS INTEGER) AS col, height
  FROM s, (VALUES (0), (1)) AS a(cy), (VALUES (0), (1)) AS b(cx)
  WHERE (cy = 0 AND y <= 64 OR cy = 1 AND y >= 64) AND (cx = 0 AND x <= 64 OR cx = 1 AND x >= 64))"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, lat, lon, refs, members, tags): nodes (a degree for 1,000 map units), ways and relations as a map file holds them."""
    none = lambda kind: F.lit(None).cast(kind)
    member = "array<struct<kind: byte, ref: long, role: string>>"
    found = nodes(spark, sf_dir).select(F.lit(0).cast("byte").alias("kind"), "id", (F.col("lat_u") / 1000).alias("lat"), (F.col("lon_u") / 1000).alias("lon"), none("array<long>").alias("refs"), none(member).alias("members"), "tags")
    refs = way_refs(spark, sf_dir).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("refs"))
    w = ways(spark, sf_dir)
    of_ways = w.join(refs, w["id"] == refs["way_id"], "left").select(F.lit(1).cast("byte").alias("kind"), "id", none("double").alias("lat"), none("double").alias("lon"), F.coalesce("refs", F.array().cast("array<long>")).alias("refs"), none(member).alias("members"), "tags")
    held = F.array_sort(F.collect_list(F.struct(F.col("kind").cast("byte").alias("kind"), F.col("ref").cast("long").alias("ref"), "role")))
    of_relations = members(spark, sf_dir).groupBy("relation_id").agg(held.alias("members"))
    return found.unionByName(of_ways).unionByName(of_relations.select(F.lit(2).cast("byte").alias("kind"), F.col("relation_id").alias("id"), none("double").alias("lat"), none("double").alias("lon"), none("array<long>").alias("refs"), F.col("members").cast(member).alias("members"), F.create_map().cast("map<string,string>").alias("tags")))


#: Sixteen directions round a place.
DIRECTIONS = [(0, 16), (6, 15), (11, 11), (15, 6), (16, 0), (15, -6), (11, -11), (6, -15), (0, -16), (-6, -15), (-11, -11), (-15, -6), (-16, 0), (-15, 6), (-11, 11), (-6, 15)]


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, ring, hole, pos, lat_u, lon_u): an outline for each nation, whose customers' keys say how far it goes in each direction.

    Every second nation has a hole, every third a second ring beside the first, which may overlap other nations.
    """
    far = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region"), (F.col("c_custkey") % 16).cast("int").alias("pos")).agg(F.sum("c_custkey").alias("s"))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("region")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(2))))
    r, ring = F.col("region"), F.col("ring")
    grid = grid.where((ring == 0) | ((ring == 1) & (r % 2 == 1)) | ((ring == 2) & (r % 3 == 0))).join(far, ["region", "pos"], "left")
    s = F.coalesce("s", F.lit(0))
    reach = F.when(ring == 1, 50 + s % 100).otherwise(200 + s % 400)
    turn = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in DIRECTIONS]), F.col("pos") + 1)
    lat = (r * 7919) % 40000 - 20000 + F.when(ring == 2, 9001).otherwise(0) + turn(0) * reach
    lon = (r * 10477) % 40000 - 20000 + F.when(ring == 2, 5003).otherwise(0) + turn(1) * reach
    return grid.select("region", "ring", (ring == 1).alias("hole"), "pos", lat.cast("int").alias("lat_u"), lon.cast("int").alias("lon_u"))


OUTLINES = f"""outlines AS (
  SELECT region, ring, ring = 1 AS hole, pos,
    CAST((region * 7919) % 40000 - 20000 + CASE WHEN ring = 2 THEN 9001 ELSE 0 END + {[y for y, _ in DIRECTIONS]}[pos + 1] * reach AS INTEGER) AS lat_u,
    CAST((region * 10477) % 40000 - 20000 + CASE WHEN ring = 2 THEN 5003 ELSE 0 END + {[x for _, x in DIRECTIONS]}[pos + 1] * reach AS INTEGER) AS lon_u
  FROM (SELECT g.*, CASE WHEN ring = 1 THEN 50 + coalesce(s, 0) % 100 ELSE 200 + coalesce(s, 0) % 400 END AS reach
        FROM (SELECT CAST(n_nationkey AS INTEGER) AS region, CAST(p.range AS INTEGER) AS pos, CAST(r.range AS INTEGER) AS ring FROM nation, range(16) p, range(3) r) g
        LEFT JOIN (SELECT c_nationkey, c_custkey % 16 AS k, sum(c_custkey) AS s FROM customer GROUP BY ALL) ON c_nationkey = region AND k = pos
        WHERE ring = 0 OR ring = 1 AND region % 2 = 1 OR ring = 2 AND region % 3 = 0)),
outline_edges AS MATERIALIZED (
  SELECT region, ring, hole, lat_u AS a_lat, lon_u AS a_lon, coalesce(lead(lat_u) OVER w, first(lat_u) OVER w) AS b_lat, coalesce(lead(lon_u) OVER w, first(lon_u) OVER w) AS b_lon
  FROM outlines WINDOW w AS (PARTITION BY region, ring ORDER BY pos))"""
