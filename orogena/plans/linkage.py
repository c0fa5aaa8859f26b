"""Queries on linkage, evidence, rules and drawings, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orogena import views as v
from orogena.functions import units
from orogena.operators import linkage, style, tags
from orogena.plans.registry import Registry

R = Registry()

CHAINS = """chains AS (SELECT l_orderkey AS id, list(l_suppkey % 40 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS chain FROM lineitem GROUP BY l_orderkey),
  g AS (SELECT DISTINCT id, least([a, b, c], [c, b, a]) AS gram FROM (SELECT id, chain[i] AS a, chain[i + 1] AS b, chain[i + 2] AS c FROM (SELECT *, unnest(range(1, len(chain) - 1)) AS i FROM chains WHERE len(chain) >= 3)))"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_suppkey"] % 40).alias("chain"))


VOTES = """, p AS (SELECT gram, id AS way FROM g WHERE id % 3 <> 0 AND gram IN (SELECT gram FROM g WHERE id % 3 <> 0 GROUP BY gram HAVING count(*) <= 16)),
  e AS (SELECT * FROM g WHERE id % 3 = 0), f AS (SELECT id, greatest(1, least(count(*) // 4, 2)) AS least_n FROM e GROUP BY id),
  v AS (SELECT e.id AS element, way, count(*) AS votes FROM e JOIN p USING (gram) GROUP BY ALL),
  votes AS (SELECT element, way, votes FROM v JOIN f ON f.id = element WHERE votes >= least_n)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    chains = _chains(spark, d)
    return linkage.votes(chains.where("id % 3 = 0"), chains.where("id % 3 <> 0"))


@R.add(v.with_(CHAINS) + VOTES + " SELECT * FROM votes")
def gram_votes(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d)


@R.add(
    v.with_(CHAINS)
    + VOTES
    + """, b AS (SELECT * FROM (SELECT *, max(votes) OVER (PARTITION BY element) AS top FROM votes) WHERE votes = top),
       m AS (SELECT element, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS meaning FROM b JOIN orders ON o_orderkey = way GROUP BY element)
       SELECT element, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN meaning END AS meaning FROM m"""
)
def settled_candidates(spark: SparkSession, d: str) -> DataFrame:
    return linkage.settled(_votes(spark, d), v.ways(spark, d).select("id", F.col("tags")["priority"].alias("meaning")))


CELLED = """n AS (SELECT id, CAST(floor(lat_u / 256) AS INTEGER) AS y, CAST(floor(lon_u / 256) AS INTEGER) AS x, t_type AS meaning FROM nodes),
  p AS (SELECT c_custkey AS id, CAST(c_custkey * 31 % 256 - 128 AS INTEGER) AS y, CAST(c_custkey * 57 % 256 - 128 AS INTEGER) AS x FROM customer)"""


def _celled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    n = v.nodes(spark, d).select("id", F.shiftright("lat_u", 8).alias("y"), F.shiftright("lon_u", 8).alias("x"), F.col("tags")["type"].alias("meaning"))
    return v.table(spark, d, "customer").select(k.alias("id"), (k * 31 % 256 - 128).cast("int").alias("y"), (k * 57 % 256 - 128).cast("int").alias("x")), n


@R.add(
    v.with_(v.NODES, CELLED)
    + """SELECT p.id AS element, CASE WHEN c = 1 THEN node END AS node, CASE WHEN c IS NULL THEN 'unmatched' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome
         FROM p LEFT JOIN (SELECT y, x, count(*) AS c, min(id) AS node FROM n GROUP BY y, x) USING (y, x)"""
)
def points_by_cell(spark: SparkSession, d: str) -> DataFrame:
    return linkage.by_cell(*_celled(spark, d))


@R.add(
    v.with_(v.NODES, CELLED)
    + """SELECT p.id AS element, min(meaning) AS meaning FROM p JOIN n ON abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1 GROUP BY p.id HAVING count(DISTINCT meaning) = 1"""
)
def rescued_points(spark: SparkSession, d: str) -> DataFrame:
    points, n = _celled(spark, d)
    return linkage.rescued(points, n)


@R.add(
    """WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 40 AS y, l_suppkey % 40 AS x FROM lineitem),
         w AS (SELECT DISTINCT p_partkey % 40 AS y, s_suppkey % 40 AS x, p_type AS meaning FROM part JOIN supplier ON (p_partkey + s_suppkey) % 199 = 0),
         m AS (SELECT id, meaning, count(*) AS n FROM e JOIN w USING (y, x) GROUP BY ALL),
         r AS (SELECT *, row_number() OVER o AS r, coalesce(lead(n) OVER o, 0) AS nx FROM m WINDOW o AS (PARTITION BY id ORDER BY n DESC, meaning))
       SELECT id AS element, meaning FROM r JOIN (SELECT id, greatest(2, count(*) // 3) AS wanted FROM e GROUP BY id) USING (id) WHERE r = 1 AND n >= wanted AND n >= 2 * nx"""
)
def coarse_matches(spark: SparkSession, d: str) -> DataFrame:
    lines = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_suppkey") % 40).alias("x"))
    part, supp = v.table(spark, d, "part"), v.table(spark, d, "supplier")
    # (p + s) % 199 = 0 as an equality of remainders
    p = part.select((F.col("p_partkey") % 199).alias("k"), (F.col("p_partkey") % 40).alias("y"), F.col("p_type").alias("meaning")).distinct()
    s = supp.select(((199 - F.col("s_suppkey") % 199) % 199).alias("k"), (F.col("s_suppkey") % 40).alias("x")).distinct()
    return linkage.coarse(lines, p.join(s, "k").select("y", "x", "meaning"), least=2)


@R.add(
    v.with_(v.MEMBERS)
    + """SELECT ref AS way, min(c_mktsegment) AS meaning FROM members JOIN customer ON c_custkey + 1000 = relation_id JOIN orders ON o_orderkey = ref
         WHERE kind = 1 AND role = 'outer' AND o_orderstatus <> 'F' GROUP BY ref HAVING count(DISTINCT c_mktsegment) = 1"""
)
def lifted_meanings(spark: SparkSession, d: str) -> DataFrame:
    ways = v.ways(spark, d).select("id", (F.col("tags")["status"] != "F").alias("bare"))
    relations = v.table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.col("c_mktsegment").alias("meaning"))
    return linkage.lifted(ways, v.members(spark, d), relations)


@R.add(
    """WITH w AS (SELECT event_type AS kind, CAST(event_id % 7 AS INTEGER) AS type, user_id AS source, CAST(10 + event_id % 9 AS INTEGER) AS zoom FROM events)
       SELECT a.*, string_agg(zoom || ':' || n, ',' ORDER BY zoom) AS zooms FROM (SELECT kind, type, count(DISTINCT source) AS sources, count(*) AS rows, min(zoom) AS least_zoom FROM w GROUP BY kind, type) a
       JOIN (SELECT kind, type, zoom, count(*) AS n FROM w GROUP BY ALL) h USING (kind, type) GROUP BY ALL"""
)
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    told = linkage.evidence(e.select(F.col("event_type").alias("kind"), (F.col("event_id") % 7).cast("int").alias("type"), F.col("user_id").alias("source"), (F.col("event_id") % 9 + 10).cast("int").alias("zoom")))
    return told.withColumn("zooms", F.array_join(F.transform("zooms", lambda z: F.concat_ws(":", z["zoom"], z["n"])), ","))


@R.add(
    """WITH r AS (SELECT p_size AS code, p_brand AS meaning, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY code) AS total, CAST(row_number() OVER (PARTITION BY code ORDER BY n DESC, meaning) AS INTEGER) AS place FROM r)
       SELECT code, meaning, n, place, n >= total * 0.05 AS pure FROM t WHERE n >= total * 0.02 AND n >= 3"""
)
def code_leaders(spark: SparkSession, d: str) -> DataFrame:
    readings = v.table(spark, d, "part").groupBy(F.col("p_size").alias("code"), F.col("p_brand").alias("meaning")).agg(F.count("*").alias("n"))
    return linkage.leaders(readings, purity=0.05, noise=0.02, witnesses=3)


@R.add("SELECT p_brand, p_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def modal_resolution(spark: SparkSession, d: str) -> DataFrame:
    return linkage.modal(v.table(spark, d, "part"), "p_brand", "p_size")


@R.add(
    """WITH b AS (SELECT DISTINCT l_suppkey AS s, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey), c AS (SELECT s, count(*) AS n FROM b GROUP BY s)
       SELECT x.s AS a, y.s AS b, count(*) AS shared FROM b x JOIN b y ON x.b = y.b AND x.s < y.s JOIN c cx ON cx.s = x.s JOIN c cy ON cy.s = y.s GROUP BY x.s, y.s, cx.n, cy.n HAVING 2 * count(*) >= least(cx.n, cy.n)"""
)
def layers_alike(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of layers that share half of the smaller one's drawings; found by what they share."""
    line, part = v.table(spark, d, "lineitem"), v.table(spark, d, "part")
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s"), F.col("p_brand").alias("k")).distinct()
    return linkage.alike(own)


@R.add(
    """WITH o AS (SELECT p_type AS meaning, p_size AS ours, row_number() OVER (PARTITION BY p_type ORDER BY p_size) AS place FROM (SELECT DISTINCT p_type, p_size FROM part WHERE p_partkey % 3 = 0)),
       t AS (SELECT p_type AS meaning, code AS theirs, row_number() OVER (PARTITION BY p_type ORDER BY code) AS at, count(*) OVER (PARTITION BY p_type) AS n FROM (SELECT DISTINCT p_type, p_size + 100 AS code FROM part WHERE p_partkey % 3 <> 0))
       SELECT o.meaning, CAST(place AS INTEGER) AS place, ours, theirs FROM o JOIN t ON t.meaning = o.meaning AND t.at = least(place, n)"""
)
def ported_ladders(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    ours = p.where("p_partkey % 3 = 0").select(F.col("p_type").alias("meaning"), F.col("p_size").alias("code")).distinct()
    theirs = p.where("p_partkey % 3 <> 0").select(F.col("p_type").alias("meaning"), (F.col("p_size") + 100).alias("code")).distinct()
    return style.ported(ours, theirs)


@R.add(
    """WITH o AS (SELECT p_type AS kind, p_size AS ours, p_partkey % 5 AS agreement, p_partkey % 3 AS stray, p_partkey % 11 AS weight, p_partkey AS code FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY kind, ours ORDER BY agreement DESC, stray, weight DESC, code) AS r, count(*) OVER (PARTITION BY kind, ours) - 1 AS rivals FROM o) SELECT * EXCLUDE (r) FROM r WHERE r = 1"""
)
def claimed_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return style.claimed(v.table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_size").alias("ours"), (k % 5).alias("agreement"), (k % 3).alias("stray"), (k % 11).alias("weight"), k.alias("code")))


@R.add("SELECT min(range) AS lowest, max(range) AS highest FROM range(0, 1501) WHERE range NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 3 OR c_custkey < 100)")
def free_numbers(spark: SparkSession, d: str) -> DataFrame:
    return style.free_number(v.table(spark, d, "customer").where("c_custkey % 7 <> 3 OR c_custkey < 100").select(F.col("c_custkey").alias("code")), 0, 1500)


@R.add(
    """SELECT coalesce(a.code, b.code) AS code, coalesce(rules, 0) AS rules, coalesce(drawings, 0) AS drawings FROM (SELECT p_size AS code, count(*) AS rules FROM part WHERE p_size < 40 GROUP BY ALL) a
       FULL JOIN (SELECT CAST(s_suppkey % 60 AS INTEGER) AS code, count(*) AS drawings FROM supplier GROUP BY ALL) b ON a.code = b.code"""
)
def rules_and_drawings(spark: SparkSession, d: str) -> DataFrame:
    return style.drawn_and_emitted(v.table(spark, d, "part").where("p_size < 40").select(F.col("p_size").alias("code")), v.table(spark, d, "supplier").select((F.col("s_suppkey") % 60).cast("int").alias("code")))


@R.add(
    """WITH a AS (SELECT p_type AS tag, p_size AS code, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_type AS tag, p_size AS code, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
       SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.code, b.code) AS code, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b ON a.tag = b.tag AND a.code = b.code WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def compared_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("tag"), F.col("p_size").alias("code"))
    return style.compared(rows.where("p_partkey % 2 = 0").drop("p_partkey"), rows.where("p_partkey % 2 = 1").drop("p_partkey"))


@R.add(
    """WITH r AS (SELECT p_partkey AS rule, p_brand AS family, CAST(14 + p_size % 10 AS INTEGER) AS was FROM part), w AS (SELECT p_brand AS family, arg_min(CAST(12 + s_suppkey % 9 AS INTEGER), s_suppkey) AS upper FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 2 = 0 GROUP BY p_brand),
       c AS (SELECT family, min(was) AS coarsest FROM r GROUP BY family)
       SELECT rule, was, coalesce(CASE WHEN upper IS NOT NULL THEN least(24, greatest(10, was + upper - coarsest)) END, was) AS moved FROM r JOIN c USING (family) LEFT JOIN w USING (family)"""
)
def shifted_zooms(spark: SparkSession, d: str) -> DataFrame:
    p, s = v.table(spark, d, "part"), v.table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    rules = p.select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("family"), (F.col("p_size") % 10 + 14).cast("int").alias("was"))
    windows = s.join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("p_brand").alias("family"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 9 + 12).cast("int").alias("upper"))
    return style.shifted(rules, windows)


@R.add(
    """SELECT p_partkey AS id, (SELECT arg_min(r, abs(r - p_size) * 1000 + r) FROM (VALUES (10), (16), (20), (30), (48)) t(r)) AS lo, (SELECT arg_min(r, abs(r - p_size - 7) * 1000 + r) FROM (VALUES (10), (16), (20), (30), (48)) t(r)) AS hi FROM part"""
)
def fitted_bands(spark: SparkSession, d: str) -> DataFrame:
    return style.fitted(v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lo"), (F.col("p_size") + 7).alias("hi")), [10, 16, 20, 30, 48])


@R.add("SELECT p_partkey AS rule, p_type AS kind, p_size AS code FROM part WHERE p_type <> 'PROMO' AND (p_type, p_size) NOT IN (SELECT p_type, p_size FROM part WHERE p_partkey % 10 = 0)")
def silenced_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = v.table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_type").alias("kind"), F.col("p_size").alias("code"))
    return style.silenced(rules, rules.where("rule % 10 = 0").select("kind", "code").distinct(), ["PROMO"])


@R.add(
    """WITH n AS (SELECT DISTINCT 'Brand#' || (11 + s_suppkey % 30) AS feature FROM supplier WHERE s_suppkey < 12)
       SELECT p_brand AS feature, count(*) FILTER (p_brand IN (FROM n)) AS hidden, false AS missed FROM part GROUP BY p_brand UNION ALL SELECT feature, 0, true FROM n WHERE feature NOT IN (SELECT p_brand FROM part)"""
)
def hidden_features(spark: SparkSession, d: str) -> DataFrame:
    names = v.table(spark, d, "supplier").where("s_suppkey < 12").select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30 + 11).alias("feature"))
    rules, missed = style.hidden(v.table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_brand").alias("feature")), names)
    told = rules.groupBy("feature").agg(F.count_if("hide").alias("hidden"), F.lit(False).alias("missed"))
    return told.unionByName(missed.select("feature", F.lit(0).cast("long").alias("hidden"), F.lit(True).alias("missed")))


@R.add(
    """WITH l AS (SELECT o_custkey AS tile, o_orderkey AS level, CAST(o_orderkey % 3 AS INTEGER) AS zoom FROM orders), t AS (SELECT tile, list(zoom ORDER BY level) AS ladder FROM l GROUP BY tile) SELECT ladder, list(tile ORDER BY tile) AS tiles FROM t GROUP BY ladder"""
)
def zoom_ladders(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("tile"), F.col("o_orderkey").alias("level"), (F.col("o_orderkey") % 3).cast("int").alias("zoom"))
    return style.ladders(o)


@R.add(
    """WITH t AS (SELECT o_custkey AS tile, ['TRE', 'RGN', 'LBL', 'NET', 'NOD', 'DEM'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS ext FROM orders), h AS (SELECT tile, list(DISTINCT ext) AS have FROM t GROUP BY tile)
       SELECT tile, list_sort(list_filter(['TRE', 'RGN', 'LBL'], lambda x: NOT list_contains(have, x))) AS missing, list_contains(have, 'NET') AND list_contains(have, 'NOD') AS routable FROM h"""
)
def map_findings(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["TRE", "RGN", "LBL", "NET", "NOD", "DEM"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return style.findings(v.table(spark, d, "orders").select(F.col("o_custkey").alias("tile"), ext.alias("ext")), ["TRE", "RGN", "LBL"])


@R.add("SELECT p_partkey AS rule, p_partkey * 2 + t AS ord, p_size + t * 256 AS code FROM part, (VALUES (0), (1)) x(t) WHERE t = 0 OR p_type = 'PROMO'")
def road_twins(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("rule"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("code"), (F.col("p_type") == "PROMO").alias("road"))
    return style.twins(p, 256)


@R.add(
    """WITH l AS (SELECT p_brand AS file, p_partkey AS line, p_type || p_size AS text FROM part), s AS (SELECT DISTINCT p_brand AS file, p_type || p_size AS old, 'new ' || p_size AS new FROM part WHERE p_size % 4 = 0)
       SELECT l.file, line, coalesce(new, text) AS text FROM l LEFT JOIN (SELECT s.* FROM s JOIN (SELECT file, text FROM l GROUP BY ALL HAVING count(*) = 1) o ON o.file = s.file AND o.text = s.old) g ON g.file = l.file AND g.old = l.text"""
)
def substituted_lines(spark: SparkSession, d: str) -> DataFrame:
    p = v.table(spark, d, "part")
    text = F.concat("p_type", "p_size")
    sheet = p.where("p_size % 4 = 0").select(F.col("p_brand").alias("file"), text.alias("old"), F.concat(F.lit("new "), F.col("p_size")).alias("new")).distinct()
    return style.substituted(p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), text.alias("text")), sheet)


@R.add(
    """SELECT p_brand AS meaning, p_size AS code, count(*) AS n, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS area FROM part GROUP BY ALL"""
)
def ledger(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").groupBy(F.col("p_brand").alias("meaning"), F.col("p_size").alias("code")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("area"))


@R.add("SELECT p_size AS code, max(CASE p_type WHEN 'PROMO' THEN 5 WHEN 'ECONOMY' THEN 4 WHEN 'SMALL' THEN 2 ELSE 1 END) AS rank, count(DISTINCT p_brand) AS families, min(p_partkey) AS first_rule FROM part GROUP BY p_size")
def draw_order(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    rank = F.when(t == "PROMO", 5).when(t == "ECONOMY", 4).when(t == "SMALL", 2).otherwise(1)
    return v.table(spark, d, "part").groupBy(F.col("p_size").alias("code")).agg(F.max(rank).alias("rank"), F.count_distinct("p_brand").alias("families"), F.min("p_partkey").alias("first_rule"))


@R.add("SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS links, md5(html) AS md5, sha256(html) AS sha FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page, and checksums of its text."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return v.table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.md5("html").alias("md5"), F.sha2("html", 256).alias("sha"))


@R.add(
    """SELECT url, list(page_id ORDER BY page_id) AS pages FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url, page_id FROM pages) GROUP BY url"""
)
def archive_postings(spark: SparkSession, d: str) -> DataFrame:
    """An inverted index: the pages that claim each address, in order."""
    found = v.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")).distinct()
    return found.groupBy("url").agg(F.array_sort(F.collect_list("page_id")).alias("pages"))


@R.add(
    v.with_(v.WAY_REFS)
    + """(SELECT node_id, 'shared' AS side FROM way_refs WHERE way_id % 4 = 0 INTERSECT SELECT node_id, 'shared' FROM way_refs WHERE way_id % 4 <> 0)
         UNION ALL (SELECT node_id, 'only' FROM way_refs WHERE way_id % 4 = 0 EXCEPT SELECT node_id, 'only' FROM way_refs WHERE way_id % 4 <> 0)
         UNION ALL SELECT node_id, 'either' FROM (SELECT node_id FROM way_refs WHERE way_id % 4 = 0 UNION SELECT node_id FROM way_refs WHERE way_id % 4 <> 0)"""
)
def node_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the nodes of two halves of the ways."""
    refs = v.way_refs(spark, d)
    a, b = refs.where("way_id % 4 = 0").select("node_id"), refs.where("way_id % 4 <> 0").select("node_id")
    told = lambda df, side: df.withColumn("side", F.lit(side))
    return told(a.intersect(b), "shared").unionByName(told(a.subtract(b), "only")).unionByName(told(a.union(b).distinct(), "either"))


@R.add(
    """SELECT id, ele, CAST(CASE WHEN m BETWEEN -500 AND 9000 THEN m END AS DOUBLE) AS metres FROM (
         SELECT id, ele, CASE k WHEN 0 THEN x WHEN 1 THEN x + 0.5::DOUBLE WHEN 2 THEN 1000 + x % 1000 WHEN 3 THEN x * 0.3048::DOUBLE WHEN 5 THEN (9001 + x) * 0.3048::DOUBLE
           WHEN 6 THEN 1000 + x % 1000 + 0.5::DOUBLE WHEN 7 THEN x WHEN 8 THEN x WHEN 9 THEN x * 0.3048::DOUBLE WHEN 10 THEN x * 0.3048::DOUBLE WHEN 11 THEN x * 0.3048::DOUBLE WHEN 12 THEN 1000 + x % 1000 WHEN 13 THEN -x END AS m
         FROM (SELECT c_custkey AS id, c_custkey % 15 AS k, (c_custkey % 8000)::DOUBLE AS x,
           CASE c_custkey % 15 WHEN 0 THEN v || ' m' WHEN 1 THEN v || ',5' WHEN 2 THEN '1,' || w WHEN 3 THEN v || ' ft' WHEN 4 THEN 'high' WHEN 5 THEN CAST(9001 + c_custkey % 8000 AS VARCHAR) WHEN 6 THEN '1,' || w || '.5'
             WHEN 7 THEN v || ' metres' WHEN 8 THEN v || ' Meters' WHEN 9 THEN v || '′' WHEN 10 THEN v || '''' WHEN 11 THEN v || ' feet' WHEN 12 THEN '1 ' || w WHEN 13 THEN '-' || v ELSE '1,52,' || v || '7' END AS ele
           FROM (SELECT c_custkey, CAST(c_custkey % 8000 AS VARCHAR) AS v, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS w FROM customer)))"""
)
def elevations(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of a height and what they read as."""
    c = F.col("c_custkey")
    v_, w = (c % 8000).cast("string"), F.lpad((c % 1000).cast("string"), 3, "0")
    ends = {0: " m", 1: ",5", 3: " ft", 7: " metres", 8: " Meters", 9: "′", 10: "'", 11: " feet"}
    spelt = {k: F.concat(v_, F.lit(x)) for k, x in ends.items()}
    spelt |= {2: F.concat(F.lit("1,"), w), 4: F.lit("high"), 5: (c % 8000 + 9001).cast("string"), 6: F.concat(F.lit("1,"), w, F.lit(".5")), 12: F.concat(F.lit("1 "), w), 13: F.concat(F.lit("-"), v_), 14: F.concat(F.lit("1,52,"), v_, F.lit("7"))}
    text = F.coalesce(*[F.when(c % 15 == k, x) for k, x in sorted(spelt.items())])
    return v.table(spark, d, "customer").select(c.alias("id"), text.alias("ele")).select("id", "ele", units.elevation(F.col("ele")).alias("metres"))


@R.add(
    """SELECT p_partkey, CAST(CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size * 10 WHEN p_size % 4 = 2 THEN (1000 + p_size) * 0.3048::DOUBLE ELSE p_size * 0.3048::DOUBLE END AS DOUBLE) AS metres FROM part"""
)
def summit_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights of peaks from ele, else from ele:ft, which is in feet whatever unit stands behind it; other points have none."""
    size = F.col("p_size")
    t = F.create_map(
        F.lit("natural"), F.when(size % 4 == 0, "tree").when(size % 2 == 1, "peak").otherwise("volcano"),
        F.lit("ele"), F.when(size % 4 == 1, (size * 10).cast("string")).otherwise("unknown"),
        F.lit("ele:ft"), F.when(size % 4 == 2, F.concat(F.lit("1,0"), F.lpad(size.cast("string"), 2, "0"), F.lit(" ft"))).otherwise(F.concat(size, F.lit(" m"))),
    )
    return v.table(spark, d, "part").select("p_partkey", tags.summit_height(t).alias("metres"))


@R.add("SELECT item_id, n FROM (SELECT item_id, length(trim(regexp_replace(regexp_replace(replace(replace('<b>' || text || '</b> &lt;x&gt;', '&lt;', '<'), '&gt;', '>'), '<b>|</b>', '', 'g'), '\\s+', ' ', 'g'))) AS n FROM benchmark)")
def plain_names(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<b>"), F.col("text"), F.lit("</b> &lt;x&gt;"))
    return v.table(spark, d, "benchmark").select("item_id", F.length(units.plain_name(html)).cast("long").alias("n"))


@R.add(
    """SELECT d.doc_id, contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ', ' ' || array_to_string(list_filter(regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ') AS repeats
       FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40"""
)
def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document holds the words of a passage one after another."""
    docs, b = v.table(spark, d, "documents"), v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("name"))
    return docs.join(b, F.col("item_id") == F.col("doc_id") % 40).select("doc_id", tags.repeats_name(F.col("text"), F.col("name")).alias("repeats"))


@R.add(
    """SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY hour_ts) AS BIGINT) AS running FROM (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts, count(*) AS n FROM events GROUP BY ALL)"""
)
def hourly_running(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour with a running count: the cumulative share that cuts are made at. An extra, plain Spark."""
    e = v.table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour_ts")).agg(F.count("*").alias("n"))
    return e.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("hour_ts")))


@R.add(
    v.with_(v.WAY_REFS)
    + """, sized AS (SELECT way_id, pos, count(*) OVER (PARTITION BY way_id) AS n, CASE WHEN pos % 5 = 3 THEN -node_id ELSE node_id END AS changed, node_id FROM way_refs),
       own AS (SELECT way_id, changed AS point, b AS backward, CAST(CASE WHEN (way_id % 2 = 1) <> b THEN n - 1 - pos ELSE pos END AS INTEGER) AS i FROM sized, (VALUES (false), (true)) AS t(b)),
       met AS (SELECT own.way_id, backward, i, s.pos - i AS d FROM own JOIN sized s ON s.way_id = own.way_id AND s.node_id = own.point),
       told AS (SELECT *, i - row_number() OVER (PARTITION BY way_id, backward, d ORDER BY i) AS stretch FROM met)
       SELECT way_id AS element, backward, i, CAST(max(n) AS INTEGER) AS n FROM (SELECT *, max(i) OVER (PARTITION BY way_id, backward, d, stretch) - i + 1 AS n FROM told) GROUP BY way_id, backward, i"""
)
def aligned_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run from each place of an element that its way has too: elements are ways with points exchanged, every second in reverse."""
    refs = v.way_refs(spark, d)
    chain = F.transform(F.array_sort(F.collect_list(F.struct("pos", "point"))), lambda x: x["point"])
    ways = refs.withColumn("point", F.col("node_id")).groupBy(F.col("way_id").alias("id")).agg(chain.alias("chain"))
    changed = refs.withColumn("point", F.when(F.col("pos") % 5 == 3, -F.col("node_id")).otherwise(F.col("node_id"))).groupBy(F.col("way_id").alias("id")).agg(chain.alias("chain"))
    elements = changed.select("id", F.when(F.col("id") % 2 == 1, F.reverse("chain")).otherwise(F.col("chain")).alias("chain"))
    pairs = ways.select(F.col("id").alias("element"), F.col("id").alias("way"))
    return linkage.run_lengths(pairs, elements, ways).select("element", "backward", "i", F.col("n").cast("int").alias("n"))


@R.add(
    """SELECT p_partkey AS id, p_size % 3 = 0 AS routable, p_size % 4 = 1 AS contour, p_size % 2 = 0 AND p_size % 5 < 3 AS described,
         CAST(greatest(-1000, least(1000, CASE WHEN p_size % 7 = 0 THEN 0 ELSE (p_size % 5) * 700 - 1400 END)) * 4 + CASE WHEN p_size % 6 = 2 THEN 2 ELSE 0 END + CASE WHEN p_size % 8 = 3 THEN 1 ELSE 0 END AS INTEGER) AS level,
         CAST(CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size + 0.5 END AS DOUBLE) AS metres, CAST(floor((p_size * 37 + 4) / 8) * 8 AS INTEGER) AS snapped
       FROM part"""
)
def point_filters(spark: SparkSession, d: str) -> DataFrame:
    """Whether each part's tags make a road, a contour or a point worth carrying; its drawn level, height and place on a lattice."""
    n = F.col("p_size")
    t = F.create_map(
        F.lit("highway"), F.when(n % 3 == 0, "track").otherwise("proposed"),
        F.lit("contour"), F.when(n % 4 == 1, "elevation").otherwise("depth"),
        F.when(n % 2 == 0, "tourism").otherwise("note"), F.lit("yes"),
        F.when(n % 5 < 3, "description").otherwise("remark"), F.col("p_type"),
    )
    layer = F.when(n % 7 == 0, "none").otherwise(((n % 5) * 700 - 1400).cast("string"))
    bridge, tunnel = F.when(n % 6 == 2, "yes").when(n % 6 == 3, "no"), F.when(n % 8 == 3, "yes").when(n % 8 == 4, "building_passage")
    height = F.when(n % 9 == 0, "tall").otherwise(F.concat(n, F.lit(",5 m")))
    p = v.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), tags.routable(t).alias("routable"), tags.contour(t).alias("contour"), tags.described_point(t).alias("described"),
        units.drawn_level(layer, bridge, tunnel).cast("int").alias("level"), units.metres(height).alias("metres"), units.on_lattice((n * 37).cast("int"), 3).alias("snapped"),
    )


@R.add(
    """SELECT p_type AS file, p_partkey AS line, CASE p_size % 3 WHEN 0 THEN 'amenity' WHEN 1 THEN 'tourism' ELSE 'shop' END AS key, 'kind_' || p_size AS value FROM part
       WHERE p_size % 10 NOT IN (2, 4, 6, 8) AND p_size % 3 <> 2"""
)
def hideable_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that can be hidden by themselves, among lines with other conditions, actions that set tags, comments and protected keys."""
    n = F.col("p_size")
    key = F.when(n % 3 == 0, "amenity").when(n % 3 == 1, "tourism").otherwise("shop")
    rule = F.concat(key, F.lit(" = kind_"), n)
    ends = {2: " & name=* [0x2a resolution 24] |", 4: " {set mark=yes} [0x2a00]", 6: " [0xzz]", 8: ""}
    text = F.coalesce(*[F.when(n % 10 == k, F.concat(rule, F.lit(x))) for k, x in ends.items()], F.concat(F.lit("  "), rule, F.lit(" {name '${name}'} [0x2a00 resolution 24]")))
    lines = v.table(spark, d, "part").select(F.col("p_type").alias("file"), F.col("p_partkey").alias("line"), text.alias("text"))
    return style.hideable(lines, ["amenity", "tourism", "shop"], ["shop"])


@R.add("SELECT p_type AS family, min(rung) AS finest, max(rung) AS coarsest, count(*) AS rules FROM (SELECT p_type, CASE WHEN p_size % 7 <> 0 THEN p_size % 24 END AS rung FROM part) WHERE rung IS NOT NULL GROUP BY p_type")
def rung_spreads(spark: SparkSession, d: str) -> DataFrame:
    """The finest and the coarsest rung of each family's rules, and how many there are."""
    return style.rung_spread(v.table(spark, d, "part").select(F.col("p_type").alias("family"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 24).alias("rung")))


@R.add(
    """SELECT kind, ['unmatched', 'ambiguous', 'matched'][r] AS outcome, count(*) AS n FROM (
         SELECT l_returnflag AS kind, l_partkey, max(CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END ELSE CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 1 END END) AS r FROM lineitem GROUP BY ALL) GROUP BY ALL"""
)
def best_of_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Elements by the best outcome of matching that any of their extracts gives."""
    line, supp = F.col("l_linenumber") % 3, F.col("l_suppkey")
    told = F.when((line == 1) & (supp % 2 != 0), "ambiguous").when((line == 2) & (supp % 5 == 0), "matched").otherwise("unmatched")
    return style.best_outcomes(v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("element"), supp.alias("extract"), told.alias("outcome")))


@R.add(
    """SELECT tag, coalesce(b, 0) >= 20 AND coalesce(b, 0) >= 0.25 * coalesce(o, 0) AS built, coalesce(o, 0) >= 20 AND coalesce(o, 0) >= 0.25 * coalesce(b, 0) AS open FROM (
         SELECT p_brand AS tag, max(n) FILTER (built) AS b, max(n) FILTER (NOT built) AS o FROM (SELECT p_brand, p_type, p_size % 4 = 0 AS built, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand)"""
)
def classes_of_tags(spark: SparkSession, d: str) -> DataFrame:
    """Whether buildings and open ground are real shares of each tag."""
    counts = v.table(spark, d, "part").groupBy(F.col("p_brand").alias("tag"), "p_type", (F.col("p_size") % 4 == 0).alias("built")).agg(F.count("*").alias("n"))
    return style.classed_tags(counts, 20, 0.25)
