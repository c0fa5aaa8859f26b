"""Operators on small hand-made tables, and those without an oracle against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orogena import views as v
from orogena.functions import units
from orogena.operators import linkage, places, rasters, regions, style, tags, tiling
from orogena.plans import places as place_plans
from orogena.plans import regions as region_plans
from orogena.sources import hgt

DATA = "/root/testdata/sf0.001"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_map_units(spark):
    nan = float("nan")
    got = values(spark, [(0.0,), (180.0,), (90.0,), (1e9,), (-1e9,), (nan,), (None,)], "d double", units.map_units(F.col("d")))
    assert [x for (x,) in got] == [0, 1 << 23, 1 << 22, 1 << 23, -(1 << 23), 1 << 23, None]


def test_elevations(spark):
    want = {
        "1527": 1527, "1527.4": 1527.4, "1527 m": 1527, "1527m": 1527, "1 527": 1527, "1 527": 1527, "1527 metres": 1527, "1527 Meters": 1527, "1527,4": 1527.4, "1,527": 1527,
        "1,527.4": 1527.4, "1,5": 1.5, "-1,5": -1.5, "5000 ft": 1524, "5000'": 1524, "5000′": 1524, "5000 feet": 1524, "5000ft": 1524, "14,505 ft": 4421.124, "14,505": 4421.124, "12000": 3657.6,
        "-430": -430, "-3": -3, "1,52,7": None, "": None, "   ": None, "high": None, "99999": None, "29600": None, "-9999": None, "NaN": None, "1d": None, "ft": None, None: None,
    }
    got = [x for (x,) in values(spark, [(t,) for t in want], "e string", units.elevation(F.col("e")))]
    assert [g is None for g in got] == [w is None for w in want.values()]
    assert all(w is None or abs(g - w) < 1e-9 for g, w in zip(got, want.values()))
    feet = {"14505": 4421.124, "14,505": 4421.124, "5000 ft": 1524, "5000 m": 1524, "high": None, None: None}
    got = [x for (x,) in values(spark, [(t,) for t in feet], "e string", units.elevation(F.col("e"), in_feet=True))]
    assert all((g is None) == (w is None) and (w is None or abs(g - w) < 1e-9) for g, w in zip(got, feet.values()))


def test_small_readings(spark):
    got = values(
        spark,
        [("75000 (2010)", "3,5 m", -34, -71, "picnic_site", 1), ("~75000", "x", 44, 33, "peak", 300)],
        "n string, h string, lat int, lon int, k string, c int",
        units.leading_number(F.col("n")), units.metres(F.col("h")), units.tile_name(F.col("lat"), F.col("lon")), units.humanised(F.col("k")), units.type_code(F.col("c")), units.on_lattice(F.col("lat"), 3),
    )
    assert got == [(75000.0, 3.5, "S34W071", "Picnic site", "0x01", -32), (75000.0, None, "N44E033", "Peak", "0x012c", 48)]
    corners = values(spark, [("N44E033",), ("s34w071",), ("x",)], "t string", units.tile_corner(F.col("t")))
    assert [tuple(c) if c else None for (c,) in corners] == [(44, 33), (-34, -71), None]


def test_levels(spark):
    rows = [("1", None, None), ("-1", None, "yes"), (None, "yes", "no"), ("9999", None, "building_passage"), ("x", "no", None)]
    assert [x for (x,) in values(spark, rows, "l string, b string, t string", units.drawn_level(F.col("l"), F.col("b"), F.col("t")))] == [4, -3, 2, 4000, 0]


def test_terms_stop_at_the_first_untold(spark):
    T = tags.Term
    tag = F.create_map(F.lit("a"), F.col("a"))
    t, f, u = T("a", "=", "1"), T("a", "=", "2"), T("a", "~", "1")
    cases = [tags.all_hold(x, tag) for x in ([t, t], [t, f, u], [t, u, f], [T("a", "<", "1")], [T("b", "<", "1")], [])]
    assert values(spark, [("1",)], "a string", *cases) == [(True, False, None, False, False, True)]


def test_descriptions(spark):
    rows = [("Viewpoint", "x"), ("Old mill by the river", "Mill"), ("The Mill", "mill"), ("", "x"), (None, "x"), ("a fine place", None)]
    got = values(spark, rows, "d string, n string", tags.worth_carrying(F.col("d"), F.col("n")), tags.repeats_name(F.col("d"), F.col("n")))
    assert got == [(False, False), (True, True), (False, True), (False, False), (False, False), (True, False)]


def test_tile_edges_and_corners(spark):
    tiles = v.tiles(spark)
    points = spark.createDataFrame([(1, 0, 0), (2, 0, 5), (3, 5, 5)], "id int, lat_u int, lon_u int")
    got = Counter(r.id for r in tiling.point_tiles(points, tiles).collect())
    assert got == {1: 4, 2: 2, 3: 1}


def test_cut_holds_all_cells_and_the_cap():
    rng = np.random.default_rng(5)
    cells = [(int(y), int(x), int(n)) for (y, x), n in Counter((int(a), int(b)) for a, b in rng.integers(-40, 40, (5_000, 2))).items()]
    boxes = tiling.cut(cells, 200)
    at = [[i for i, (a, b, c, d) in enumerate(boxes) if a <= y << 11 < c and b <= x << 11 < d] for y, x, _ in cells]
    assert all(len(i) == 1 for i in at)
    load = Counter()
    for (i,), (_, _, n) in zip(at, cells):
        load[i] += n
    assert max(load.values()) <= 200 and len(boxes) < 2 * 5_000 / 200 * 2
    assert tiling.cut([], 5) == [] and tiling.node_cap(1_000, 500, 10, 4) == 250
    far = tiling.cut([(0, 0, 3), (100, 0, 3)], 4)
    assert far == [(0, 0, 2048, 2048), (204800, 0, 206848, 2048)]


def test_balanced_areas_count_every_node(spark):
    got = place_plans.balanced_areas(spark, DATA).collect()
    assert sum(r.n for r in got) == v.nodes(spark, DATA).count()


def test_contour_lines_use_every_segment_once(spark):
    raster = v.raster(spark, DATA).where("cell = 1 AND row < 40 AND col < 40")
    segments = rasters.contour_segments(raster, 50)
    per = {(r.cell, r.level): r.n for r in segments.groupBy("cell", "level").agg(F.count("*").alias("n")).collect()}
    lines = rasters.contour_lines(segments).collect()
    assert per == {k: sum(r.length for r in lines if (r.cell, r.level) == k) for k in per}
    ring = spark.createDataFrame([(0, y, x, 100 if (y, x) == (1, 1) else 0) for y in range(3) for x in range(3)], "cell int, row int, col int, height int")
    found = rasters.contour_lines(rasters.contour_segments(ring, 60)).collect()
    assert sorted((r.level, r.closed, r.length) for r in found) == [(0, True, 4), (60, True, 4)]
    assert region_plans.contour_lines.__name__ in region_plans.R.queries


def test_simplified_chain(spark):
    rows = [([(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)],)]
    got = spark.createDataFrame(rows, "p array<struct<y:int,x:int>>").select(rasters.simplified(F.col("p")).alias("p")).first().p
    assert [tuple(x) for x in got] == [(0, 0), (2, 2), (4, 2)]


def test_hgt_round_trip(spark, tmp_path):
    grid = np.arange(9, dtype=float).reshape(3, 3) - 4
    grid[0, 1] = -32768
    (tmp_path / "S01E002.hgt").write_bytes(hgt.encoded(grid))
    got = hgt.read_hgt(spark, f"file://{tmp_path}").orderBy("row").collect()
    assert [(r.cell_lat, r.cell_lon, r.row) for r in got] == [(-1, 2, 0), (-1, 2, 1), (-1, 2, 2)]
    assert got[0].heights == [-4, None, -2] and got[2].heights == [2, 3, 4]
    assert np.frombuffer(hgt.encoded(np.array([[0.5, -0.5, float("nan")]])), ">i2").tolist() == [1, -1, 0]


def test_alignment(spark):
    rows = [([1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5]), ([3, 2, 1], [1, 2, 3]), ([1, 5, 2], [2, 9, 1]), ([4, 4], [8, 8])]
    assert [x for (x,) in values(spark, rows, "a array<int>, b array<int>", linkage.aligned(F.col("a"), F.col("b")))] == [5, 3, 0, 0]


def test_chains_and_reach(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "id long, into long")
    assert {r.id: r.into for r in regions.chain_ends(m).collect()} == {1: 4, 2: 4, 3: 4, 9: 8}
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (7, 8)], "id long, holder long")
    assert {r.id for r in regions.reached(spark.createDataFrame([(1,)], "id long"), e).collect()} == {1, 2, 3}


def test_rings(spark):
    square = [(0, 0), (0, 4), (4, 4), (4, 0)]
    rows = [(2, 2, square), (5, 2, square), (1, 3, square)]
    got = values(spark, rows, "y int, x int, r array<struct<lat_u:int,lon_u:int>>", places.in_ring(F.col("y"), F.col("x"), F.col("r")), places.ring_area2(F.col("r")))
    assert got == [(True, 32), (False, 32), (True, 32)]


def test_empty_tables(spark):
    nodes = v.nodes(spark, DATA).limit(0)
    refs = v.way_refs(spark, DATA).limit(0)
    assert tiling.density(nodes).count() == 0 and tiling.areas(nodes, 5).count() == 0
    assert places.way_shapes(refs, nodes).count() == 0 and places.route_ends(refs).count() == 0
    assert style.ladders(spark.createDataFrame([], "tile int, level int, zoom int")).count() == 0


def test_tiles_are_written_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [1, 2]), (2, 1, [2])], "id long, kind int, tiles array<int>")
    tiling.write_tiles(rows.select("id", "kind", F.col("tiles").alias("t")), F.col("t"), f"file://{tmp_path}/out", ["kind", "id"])
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert {(r.tile, r.id) for r in back.collect()} == {(1, 1), (2, 1), (2, 2)}


def test_entry_is_the_census(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_an_id_match_ranks_behind_names(spark):
    from orogena.operators import regions

    tree = spark.createDataFrame([("xalps", "Some", None, "u"), ("b", "The long name before the alps", None, "u"), ("c", "Alps", None, None)], "id string, name string, parent string, url string")
    assert [(r.id, r.score) for r in regions.search(tree, " alps ").collect()] == [("xalps", 2104), ("b", 2529), ("c", 5004)]
    assert regions.search(tree, "  ").count() == 0


def test_tag_filters(spark):
    rows = [
        ({"highway": "steps"},),
        ({"highway": "proposed", "contour": "elevation"},),
        ({"natural": "peak", "ele": "1527 m"},),
        ({"natural": "volcano", "ele": "high", "ele:ft": "5000"},),
        ({"natural": "tree", "ele": "12", "description": ""},),
        ({"description": "alone"},),
        ({},),
        (None,),
    ]
    t = F.col("t")
    got = values(spark, rows, "t map<string, string>", tags.routable(t), tags.contour(t), F.round(tags.summit_height(t), 1), tags.described_point(t))
    none = (False, False, None, False)
    assert got == [(True, False, None, False), (False, True, None, False), (False, False, 1527.0, False), (False, False, 1524.0, False), (False, False, None, True), none, none, none]
