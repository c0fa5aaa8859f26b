"""File sources by round trips and refusals; work on groups against hand-made cases."""

from __future__ import annotations

import random

import pytest

from orogena.operators import graphs
from orogena.sources import osm_pbf, outlines

ROWS = [
    (0, 5, 44.5, -33.25, None, None, {"natural": "peak", "ele": "1527"}),
    (0, 9, -1e-7, 180.0, None, None, {}),
    (1, 7, None, None, [5, 9, 5], None, {"highway": "track"}),
    (2, 3, None, None, None, [(0, 5, "label"), (1, 7, "outer")], {"type": "multipolygon"}),
]


def test_pbf_round_trip(spark, tmp_path):
    path = tmp_path / "a.osm.pbf"
    path.write_bytes(osm_pbf.encoded_header() + osm_pbf.encoded_block(ROWS) + osm_pbf.encoded_block(ROWS[:2]))
    osm_pbf.register(spark)
    got = spark.read.format("osm_pbf").option("blobs", "1").load(str(path))
    assert got.rdd.getNumPartitions() == 2
    back = [(r.kind, r.id, r.lat, r.lon, r.refs, [tuple(m) for m in r.members] if r.members else None, r.tags) for r in got.orderBy("blob", "kind", "id").collect()]
    assert back == ROWS + ROWS[:2]


@pytest.mark.parametrize("bad", [osm_pbf.encoded_header(("HistoricalInformation",)), b"\0\0", osm_pbf.encoded_block(ROWS)[:-3], b"\xff\xff\xff\xff"])
def test_pbf_refusals(tmp_path, bad):
    path = tmp_path / "b.osm.pbf"
    path.write_bytes(bad)
    with pytest.raises((ValueError, KeyError)):
        osm_pbf.PbfReader({"path": str(path)}).partitions()


def test_poly(spark, tmp_path):
    (tmp_path / "x.poly").write_text("name\n1\n 1.0 2.0\n 3E0 4.0\nEND\n!2\n 5 6\nEND\nEND\n")
    got = outlines.read_poly(spark, f"file://{tmp_path}/x.poly").orderBy("section", "pos").collect()
    assert [(r.section, r.hole, r.pos, r.lon, r.lat) for r in got] == [(1, False, 0, 1.0, 2.0), (1, False, 1, 3.0, 4.0), (2, True, 0, 5.0, 6.0)]


def test_region_index(spark, tmp_path):
    (tmp_path / "i.json").write_text(
        '{"features":[{"properties":{"id":"a","name":"A","urls":{"pbf":"u"}},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,3]]]}},'
        '{"properties":{"id":"b","name":"B","parent":"a"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,1]]],[[[5,5],[6,7]]]]}}]}'
    )
    regions, boxes = outlines.read_region_index(spark, f"file://{tmp_path}/i.json")
    assert {(r.id, r.parent, r.url, tuple(r.children)) for r in regions.collect()} == {("a", None, "u", ("b",)), ("b", "a", None, ())}
    assert {(r.id, r.ring, r.min_lat, r.max_lon) for r in boxes.collect()} == {("a", 0, 0.0, 2.0), ("b", 0, 0.0, 1.0), ("b", 1, 5.0, 6.0)}


def test_rings_from_shuffled_pieces(spark):
    random.seed(20)
    rows, sizes = [], {}
    for rel in range(12):
        ring = [rel * 1000 + i for i in range(random.randint(3, 40))]
        sizes[rel] = len(ring)
        ring.append(ring[0])
        cuts = sorted({0, len(ring) - 1, *random.sample(range(1, len(ring) - 1), min(3, len(ring) - 2))})
        pieces = [ring[a : b + 1] for a, b in zip(cuts, cuts[1:])]
        pieces = [p[::-1] if random.random() < 0.5 else p for p in pieces]
        random.shuffle(pieces)
        rows += [(rel, i, p) for i, p in enumerate(pieces)]
    rows.append((99, 0, [1, 2, 3]))
    got = graphs.rings(spark.createDataFrame(rows, "relation_id long, piece int, nodes array<long>")).collect()
    assert {r.relation_id: (r.closed, len(set(r.nodes))) for r in got} == {k: (True, n) for k, n in sizes.items()} | {99: (False, 3)}


def test_repairs_see_those_before_them(spark):
    edges = spark.createDataFrame([(1, 1, 2, 50.0), (1, 2, 3, 50.0), (1, 10, 11, 30.0)], "grp long, src long, dst long, metres double")
    cands = spark.createDataFrame(
        [(1, 1, 3, 10, 11, 5.0, False), (1, 2, 1, 10, 11, 40.0, False), (1, 3, 2, 2, 3, 1.0, False), (1, 4, 1, 20, 21, 9.0, True), (1, 5, 1, 3, 3, 10.0, False)],
        "grp long, cand long, node long, to_a long, to_b long, metres double, blocked boolean",
    )
    got = {r.cand: (r.verdict, r.detour) for r in graphs.repaired(edges, cands).collect()}
    assert got[1] == ("attached", None)
    assert got[2] == ("already joined", 105.0)
    assert got[3][0] == "same node" and got[4][0] == "blocked"
    assert got[5] == ("attached", 100.0)


def test_inner_point_of_a_crescent(spark):
    ys, xs = [0.0, 0.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0], [0.0, 3.0, 3.0, 0.0, 0.0, 2.5, 2.5, 0.0]
    (r,) = graphs.inner_point(spark.createDataFrame([(1, ys, xs)], "id long, ys array<double>, xs array<double>")).collect()
    assert abs(r.lat - 1.5) < 1e-9 and 2.5 <= r.lon <= 3.0


def test_smallest_region(spark):
    boxes = spark.createDataFrame([("big", 0.0, 0.0, 10.0, 10.0), ("small", 1.0, 1.0, 3.0, 3.0)], "region string, min_lat double, min_lon double, max_lat double, max_lon double")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 50.0, 5.0)], "id long, lat double, lon double")
    assert {r.id: r.region for r in graphs.region_of(points, boxes).collect()} == {1: "small", 2: "big"}
