"""Queries on rewrites, venues, masks and choices among sources, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogena import views as v
from orogena.operators import rewriting
from orogena.plans.registry import Registry

R = Registry()


@R.add(
    v.with_(v.WAY_REFS)
    + """, own AS (SELECT way_id, pos, 0 AS nth, CASE WHEN way_id % 2 = 0 AND node_id % 3 = 0 THEN node_id // 1000 ELSE node_id END AS node_id FROM way_refs),
       ins AS (SELECT o_orderkey AS way_id, 0 AS pos, 1 AS nth, o_custkey AS node_id FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey IN (SELECT way_id FROM way_refs)),
       a AS (SELECT *, lag(node_id) OVER (PARTITION BY way_id ORDER BY pos, nth) AS last FROM (SELECT * FROM own UNION ALL SELECT * FROM ins))
       SELECT way_id, list(node_id ORDER BY pos, nth) AS refs FROM a WHERE last IS NULL OR last <> node_id GROUP BY way_id"""
)
def rewritten_ways(spark: SparkSession, d: str) -> DataFrame:
    refs = v.way_refs(spark, d)
    merges = refs.where("node_id % 3 = 0").select(F.col("node_id").alias("id"), F.floor(F.col("node_id") / 1000).alias("into")).distinct()
    inserts = v.table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("way_id"), F.lit(0).alias("after_pos"), F.col("o_custkey").alias("node_id")).join(refs.select("way_id").distinct(), "way_id", "left_semi")
    return rewriting.rewritten(refs, merges, inserts, refs.where("way_id % 2 = 0").select("way_id").distinct())


AREAS = """areas AS (SELECT o_orderkey AS id, o_orderpriority AS tag, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS name, CAST(o_orderkey * 7919 % 60000 - 30000 AS INTEGER) AS min_lat, CAST(o_orderkey * 104729 % 60000 - 30000 AS INTEGER) AS min_lon,
    CAST(o_orderkey * 7919 % 60000 - 30000 + 300 + o_orderkey % 11 * 250 AS INTEGER) AS max_lat, CAST(o_orderkey * 104729 % 60000 - 30000 + 300 + o_orderkey % 7 * 400 AS INTEGER) AS max_lon FROM orders),
  pts AS (SELECT o_orderpriority AS tag, CASE WHEN c_custkey % 3 <> 0 THEN o_orderstatus END AS name, CAST(c_custkey * 31 % 60000 - 30000 AS INTEGER) AS y, CAST(c_custkey * 3571 % 60000 - 30000 AS INTEGER) AS x FROM customer JOIN orders ON o_orderkey = c_custkey)"""


@R.add(
    v.with_(AREAS)
    + """SELECT DISTINCT id FROM (SELECT a.id FROM areas a JOIN pts p ON p.tag = a.tag AND y BETWEEN min_lat AND max_lat AND x BETWEEN min_lon AND max_lon WHERE a.name IS NULL OR p.name = a.name
         UNION ALL SELECT a.id FROM areas a JOIN areas i ON i.tag = a.tag AND i.id <> a.id AND i.min_lat >= a.min_lat AND i.max_lat <= a.max_lat AND i.min_lon >= a.min_lon AND i.max_lon <= a.max_lon
           AND CAST(i.max_lat - i.min_lat AS BIGINT) * (i.max_lon - i.min_lon) < CAST(a.max_lat - a.min_lat AS BIGINT) * (a.max_lon - a.min_lon) WHERE a.name IS NULL AND i.name IS NOT NULL)"""
)
def venue_marks(spark: SparkSession, d: str) -> DataFrame:
    """Areas that another venue, a point or a smaller area in them, already stands for."""
    orders, customer = v.table(spark, d, "orders"), v.table(spark, d, "customer")
    k = F.col("o_orderkey")
    lat, lon = k * 7919 % 60000 - 30000, k * 104729 % 60000 - 30000
    areas = orders.select(
        k.alias("id"), F.col("o_orderpriority").alias("tag"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("name"), lat.cast("int").alias("min_lat"), lon.cast("int").alias("min_lon"), (lat + 300 + k % 11 * 250).cast("int").alias("max_lat"), (lon + 300 + k % 7 * 400).cast("int").alias("max_lon")
    )
    c = F.col("c_custkey")
    points = customer.join(orders, k == c).select(F.col("o_orderpriority").alias("tag"), F.when(c % 3 != 0, F.col("o_orderstatus")).alias("name"), (c * 31 % 60000 - 30000).cast("int").alias("y"), (c * 3571 % 60000 - 30000).cast("int").alias("x"))
    return rewriting.venue_marks(areas, points)


@R.add("SELECT DISTINCT y + dy AS y, x + dx AS x FROM (SELECT s_suppkey * 7 % 100 AS y, s_suppkey * 13 % 100 AS x FROM supplier), (SELECT CAST(range AS BIGINT) - 2 AS dy FROM range(5)), (SELECT CAST(range AS BIGINT) - 2 AS dx FROM range(5))")
def dilated_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return rewriting.dilated(v.table(spark, d, "supplier").select((k * 7 % 100).alias("y"), (k * 13 % 100).alias("x")), 2)


@R.add(
    v.with_(v.WAY_REFS)
    + """, t AS (SELECT *, node_id % 3 = 0 AS wet, max(pos) OVER (PARTITION BY way_id) AS last FROM way_refs), g AS (SELECT *, pos - row_number() OVER (PARTITION BY way_id ORDER BY pos) AS g FROM t WHERE NOT wet),
       r AS (SELECT way_id AS line, min(pos) AS start, max(pos) AS "end", any_value(last) AS last FROM g GROUP BY way_id, g) SELECT line, start, "end" FROM r WHERE start = 0 OR "end" = last OR "end" - start + 1 >= 2"""
)
def dry_runs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of ways between their wet points."""
    return rewriting.dry_runs(v.way_refs(spark, d).select(F.col("way_id").alias("line"), "pos", (F.col("node_id") % 3 == 0).alias("wet")))


@R.add(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND NOT regexp_matches(c_name, '[5-9]') THEN c_name WHEN NOT regexp_matches(c_mktsegment, '[5-9]') THEN c_mktsegment END AS label FROM customer"""
)
def readable_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.create_map(F.lit("name:en"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise(""), F.lit("name"), F.col("c_mktsegment"))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), rewriting.readable_name(t, ["name:en", "name"], "5-9").alias("label"))


@R.add(
    """SELECT CAST(p_size AS INTEGER) AS cell, CAST(p_partkey * 20 AS BIGINT) AS level, 0 AS line, 4398046511104 + p_size * 1048576 + row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS way_id,
         CASE WHEN p_partkey * 20 % 200 = 0 THEN 'elevation_major' WHEN p_partkey * 20 % 100 = 0 THEN 'elevation_medium' ELSE 'elevation_minor' END AS contour_ext FROM part"""
)
def contours_as_ways(spark: SparkSession, d: str) -> DataFrame:
    return rewriting.as_ways(v.table(spark, d, "part").select(F.col("p_size").alias("cell"), (F.col("p_partkey") * 20).alias("level"), F.lit(0).alias("line")))


@R.add(
    """SELECT file, row_number() OVER (PARTITION BY file ORDER BY k, ord) - 1 AS line, text FROM (SELECT p_brand AS file, p_partkey AS k, -1 AS ord, p_name AS text FROM part UNION ALL SELECT p_brand, p_partkey, CAST(p_partkey % 3 AS INTEGER), 'added' FROM part WHERE p_size = 7)"""
)
def spliced_rules(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    added = p.where("p_size = 7").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("after"), (F.col("p_partkey") % 3).cast("int").alias("ord"), F.lit("added").alias("text"))
    return rewriting.spliced(p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_name").alias("text")), added)


@R.add(
    v.with_(v.RASTER)
    + """, p AS (SELECT CAST(c_custkey * 3 % 128 AS INTEGER) AS r, CAST(c_custkey * 5 % 128 AS INTEGER) AS c, c_custkey AS id FROM customer)
       SELECT id, arg_min(height, cell) AS height, min(cell) AS source FROM p LEFT JOIN raster ON "row" = r AND col = c AND height IS NOT NULL GROUP BY id"""
)
def mosaic_heights(spark: SparkSession, d: str) -> DataFrame:
    """The height of each point from the first raster, in their order, that has one there."""
    k = F.col("c_custkey")
    p = v.table(spark, d, "customer").select(k.alias("id"), (k * 3 % 128).cast("int").alias("row"), (k * 5 % 128).cast("int").alias("col"))
    return p.join(v.raster(spark, d).where("height IS NOT NULL"), ["row", "col"], "left").groupBy("id").agg(F.min_by("height", "cell").alias("height"), F.min("cell").alias("source"))


@R.add(
    """SELECT c_nationkey AS region, arg_min(c_custkey, age) FILTER (ok) AS found, bool_and(gone) AS all_gone, bool_or(NOT ok AND NOT gone) AS throttled
       FROM (SELECT *, c_custkey % 100 * 10000 + c_custkey AS age, c_custkey % 6 = 1 AS ok, c_custkey % 6 IN (2, 3) AS gone FROM customer) GROUP BY c_nationkey"""
)
def newest_extracts(spark: SparkSession, d: str) -> DataFrame:
    """The newest candidate that answers, whether all are gone, and whether one was refused for now."""
    k = F.col("c_custkey")
    c = v.table(spark, d, "customer").select("c_nationkey", k, (k % 100 * 10000 + k).alias("age"), (k % 6 == 1).alias("ok"), (k % 6).isin(2, 3).alias("gone"))
    return c.groupBy(F.col("c_nationkey").alias("region")).agg(F.min_by(F.when(F.col("ok"), k), F.when(F.col("ok"), F.col("age"))).alias("found"), F.bool_and("gone").alias("all_gone"), F.bool_or(~F.col("ok") & ~F.col("gone")).alias("throttled"))


@R.add(
    """SELECT arg_min(c_custkey, w * 100000 + c_custkey) FILTER (drawn >= 5000) AS light, arg_max(c_custkey, drawn * 100000 - c_custkey) AS most FROM (SELECT c_custkey, c_custkey * 37 % 1009 AS w, c_custkey * 91 % 6007 AS drawn FROM customer)"""
)
def worth_downloading(spark: SparkSession, d: str) -> DataFrame:
    """The lightest candidate that has enough, and the one that has the most."""
    k = F.col("c_custkey")
    c = v.table(spark, d, "customer").select(k, (k * 37 % 1009).alias("w"), (k * 91 % 6007).alias("drawn"))
    enough = F.col("drawn") >= 5000
    return c.agg(F.min_by(F.when(enough, k), F.when(enough, F.struct("w", "c_custkey"))).alias("light"), F.max_by(k, F.struct(F.col("drawn"), -k)).alias("most"))


@R.add(
    """SELECT level, count(*) AS lines, CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (closed) AS closed FROM (SELECT l_orderkey, CAST(l_orderkey % 9 * 50 AS BIGINT) AS level, count(*) AS n, min(l_suppkey) % 2 = 0 AS closed FROM lineitem GROUP BY l_orderkey) GROUP BY level"""
)
def contour_statistics(spark: SparkSession, d: str) -> DataFrame:
    lines = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.min("l_suppkey") % 2 == 0).alias("closed"))
    return lines.groupBy((F.col("l_orderkey") % 9 * 50).alias("level")).agg(F.count("*").alias("lines"), F.sum("n").alias("points"), F.count_if("closed").alias("closed"))


@R.add(
    """SELECT file, cond, "order" FROM (SELECT p_type AS file, string_agg('brand=' || p_brand, ' | ' ORDER BY ord) AS cond, CAST(p_size AS INTEGER) AS "order" FROM (SELECT p_type, p_size, p_brand, min(p_partkey) AS ord FROM part GROUP BY ALL) GROUP BY p_type, p_size)"""
)
def hide_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rules grouped by category and value, in the order they first come."""
    p = v.table(spark, d, "part").groupBy("p_type", "p_size", "p_brand").agg(F.min("p_partkey").alias("ord"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p_brand"))), lambda x: F.concat(F.lit("brand="), x["p_brand"])), " | ")
    return p.groupBy("p_type", "p_size").agg(joined.alias("cond")).select(F.col("p_type").alias("file"), "cond", F.col("p_size").alias("order"))


@R.add(v.with_(v.RASTER) + """SELECT cell, CAST("row" // 32 AS INTEGER) AS y, CAST(col // 32 AS INTEGER) AS x, count(height) AS known, min(height) AS lowest, max(height) AS highest, CAST(sum(height) AS BIGINT) AS total FROM raster GROUP BY ALL""")
def raster_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Heights in blocks of 32 samples a side."""
    r = v.raster(spark, d)
    y, x = F.floor(F.col("row") / 32).cast("int").alias("y"), F.floor(F.col("col") / 32).cast("int").alias("x")
    return r.groupBy("cell", y, x).agg(F.count("height").alias("known"), F.min("height").alias("lowest"), F.max("height").alias("highest"), F.sum("height").alias("total"))


@R.add("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events) WHERE place <= 3""")
def latest_by_user(spark: SparkSession, d: str) -> DataFrame:
    """The three latest events of each user: rank and take."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return v.table(spark, d, "events").select("user_id", "event_id", place.alias("place")).where("place <= 3")
