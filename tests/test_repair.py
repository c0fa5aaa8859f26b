"""Decisions on gaps: each kind, the same whatever the blocks, as one walk over all gaps makes them."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from orogena.operators import regions, repair
from orogena.operators.repair import CANDIDATE, Limits

NAMES = [c.split()[0] for c in CANDIDATE.split(", ")]
ROADS = "src long, dst long, y1 double, x1 double, y2 double, x2 double"


def gap(cand, node, at, a, a_at, b, b_at, **more):
    """A candidate from a place to a segment, with its nearest place there."""
    (y, x), (ay, ax), (by, bx) = at, a_at, b_at
    dy, dx = by - ay, bx - ax
    t = max(0.0, min(1.0, ((y - ay) * dy + (x - ax) * dx) / (dy * dy + dx * dx)))
    row = dict.fromkeys(NAMES) | {"cand": cand, "way": 10 + cand, "node": node, "y": float(y), "x": float(x), "own": 3, "at_end": True, "other_way": 500, "seg": 0, "along": t}
    row |= {"distance": math.hypot(ay + t * dy - y, ax + t * dx - x), "a": a, "a_y": float(ay), "a_x": float(ax), "a_loose": False, "b": b, "b_y": float(by), "b_x": float(bx), "b_loose": False}
    return row | more


def plan(spark, gaps, roads=(), **limits):
    frame = spark.createDataFrame([tuple(g[c] for c in NAMES) for g in gaps], CANDIDATE)
    return repair.planned(frame, spark.createDataFrame(list(roads), ROADS), Limits(**limits))


def decided(spark, gaps, roads=(), **limits):
    return {r.cand: (r.verdict, [(a.what, a.node, a.other) for a in r.actions if a.what not in ("link", "placed")]) for r in plan(spark, gaps, roads, **limits).collect()}


LINE = {"a": 1, "a_at": (0, 0), "b": 2, "b_at": (0, 100)}


def test_each_verdict(spark):
    far = lambda k: {"a": 100 * k + 1, "a_at": (9000 * k, 0), "b": 100 * k + 2, "b_at": (9000 * k, 100)}
    gaps = [
        gap(0, 7, (10, 50), **far(0)),
        gap(1, 102, (9010, 50), **far(1) | {"a": 102}),
        gap(2, 8, (18010, 50), **far(2), stopped="stopped by fence"),
        gap(3, 9, (27010, 50), **far(3), over="cliff"),
        gap(4, 10, (36010, 50), **far(4), held="kerb"),
        gap(5, 11, (45010, -3), **far(5), held="kerb"),
        gap(6, 12, (54003, 2), **far(6), a_loose=True),
        gap(7, 13, (63010, 50), **far(7)),
        gap(8, 14, (72000.5, 50), **far(8)),
        gap(9, 15, (81000, 50), **far(9)),
        gap(10, 16, (90010, 50), **far(10), over=""),
    ]
    roads = [(13, 701, 63010.0, 50.0, 63000.0, 0.0), (14, 801, 72000.5, 50.0, 72000.0, 0.0)]
    got = decided(spark, gaps, roads)
    new = Limits().new_ids
    assert got[0] == ("joined", [("move", 7, None), ("insert", 7, 1)])
    assert got[1] == ("already the same node", [])
    assert got[2] == ("stopped by fence", [])
    assert got[3] == ("bridged over cliff", [("bridge", new + 3, 9), ("insert", new + 3, 301)])
    assert got[4] == ("extended off the kerb", [("insert", new + 4, 10), ("node", new + 4, None), ("insert", new + 4, 401)])
    assert got[5] == ("extended off the kerb", [("insert", 501, 11)]), "landing on a node of the line takes it"
    assert got[6] == ("joined", [("move", 12, None), ("merge", 601, 12)])
    assert got[7] == ("already joined nearby", [])
    assert got[8] == ("joined", [("move", 14, None), ("insert", 14, 801)]), "a gap too narrow to matter is closed even with a way round"
    assert got[9] == ("joined", [("insert", 15, 901)]), "what touches isn't moved"
    assert got[10][0] == "bridged over an obstacle"
    counts = {r.verdict: r.n for r in repair.verdict_counts(plan(spark, gaps, roads)).collect()}
    assert sum(counts.values()) == len(gaps) and counts["joined"] == 4


def test_later_gaps_see_earlier_repairs(spark):
    gaps = [gap(0, 7, (10, 50), **LINE), gap(1, 7, (10, 50), **LINE), gap(2, 8, (10, 60), **LINE), gap(3, 9, (10, 52), **LINE)]
    roads = [(7, 9, 10.0, 50.0, 10.0, 52.0)]
    got = decided(spark, gaps, roads)
    assert [got[k][0] for k in range(4)] == ["joined", "already the same node", "joined", "already joined nearby"]
    # without the first, the other end of its road is joined itself
    assert decided(spark, gaps[3:], roads)[3][0] == "joined"


def test_an_end_that_was_moved_is_not_dragged(spark):
    third = {"a": 21, "a_at": (20, 0), "b": 22, "b_at": (20, 100)}
    gaps = [gap(0, 7, (10, 50), **LINE), gap(1, 7, (10, 50), **third, other_way=501)]
    assert decided(spark, gaps)[1] == ("would pull another line off course", [])
    crossing = {"a": 31, "a_at": (-50, 50), "b": 32, "b_at": (50, 50)}
    assert decided(spark, [gap(0, 7, (10, 50), **LINE), gap(1, 7, (10, 50), **crossing, other_way=502)])[1] == ("joined", [("insert", 7, 31)])


def test_merged_ends_stand_for_one_another(spark):
    gaps = [gap(k, k + 1, (0, 0), k, (0, 0), 900 + k, (-60, 10 * k), a_loose=True, other_way=600 + k) for k in range(1, 5)]
    decisions = plan(spark, gaps)
    assert {(r.id, r.into) for r in repair.merges(decisions).collect()} == {(1, 2), (2, 3), (3, 4), (4, 5)}
    assert {r.id: r.into for r in regions.chain_ends(repair.merges(decisions)).collect()} == {1: 5, 2: 5, 3: 5, 4: 5}


def network(seed, n=140, size=3000.0):
    """Roads over a plane and gaps between their ends and others' segments, in an order of their own."""
    rng = random.Random(seed)
    lines = []
    for w in range(n):
        y, x, turn = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(0, 6.28)
        line = [(y, x)]
        for _ in range(rng.randint(1, 5)):
            turn += rng.uniform(-0.5, 0.5)
            line.append((line[-1][0] + math.sin(turn) * rng.uniform(20, 120), line[-1][1] + math.cos(turn) * rng.uniform(20, 120)))
        lines.append(line)
    node = lambda w, k: w * 100 + k
    roads = [(node(w, k), node(w, k + 1), *line[k], *line[k + 1]) for w, line in enumerate(lines) for k in range(len(line) - 1)]
    gaps = []
    for w, line in enumerate(lines):
        for end in (0, len(line) - 1):
            for o, other in enumerate(lines):
                for k in range(len(other) - 1):
                    g = gap(0, node(w, end), line[end], node(o, k), other[k], node(o, k + 1), other[k + 1], way=w, other_way=o, seg=k, own=len(line) - 1 if end else 0, at_end=end > 0)
                    if o != w and g["distance"] <= 60:
                        g |= {"a_loose": k == 0, "b_loose": k == len(other) - 2, "over": "wall" if rng.random() < 0.1 else None, "held": "kerb" if rng.random() < 0.1 else None, "stopped": "stopped by fence" if rng.random() < 0.1 else None}
                        gaps.append(g)
    rng.shuffle(gaps)
    return [g | {"cand": i} for i, g in enumerate(gaps)], roads


def walked(gaps, roads, limits):
    """All gaps one by one over the whole map."""
    m = repair._Map()
    for a, b, y1, x1, y2, x2 in roads:
        m.link(a, b, math.hypot(y1 - y2, x1 - x2))
    out = {}
    for g in gaps:
        out[g["cand"]], acts = repair.decide(g, m, limits)
        for act in acts:
            m.apply(act)
    return out


@pytest.mark.parametrize("block", [300.0, 1000.0, 1e6])
def test_blocks_decide_as_one_walk_does(spark, block):
    gaps, roads = network(4)
    limits = {"gap": 60.0, "detour": 150.0, "block": block}
    want = walked(gaps, roads, Limits(**limits))
    assert len(set(want.values())) >= 6 and len(want) > 100
    assert {r.cand: r.verdict for r in plan(spark, gaps, roads, **limits).collect()} == want


def test_nothing_to_repair(spark):
    assert plan(spark, []).count() == 0


def test_obstacles_through_a_corner(spark):
    wall = lambda o, word, *places: [(o, word, k, len(places) - 1, y, x) for k, (y, x) in enumerate(places)]
    vertices = wall(1, "fence", (0, 0), (0, 5), (0, 9)) + wall(2, "wall", (0, 0), (3, 3)) + wall(3, "fence", (7, 7), (8, 8), (9, 7), (7, 7)) + wall(4, "wall", (3, 3), (4, 4)) + wall(5, "kerb", (3, 3), (4, 5))
    frame = spark.createDataFrame(vertices, "obstacle int, word string, pos int, last int, lat_u int, lon_u int")
    points = spark.createDataFrame([(1, 0, 0), (2, 0, 5), (3, 7, 7), (4, 3, 3), (5, 1, 1)], "id int, lat_u int, lon_u int")
    ask = lambda closing: sorted((r.id, r.obstacle) for r in repair.obstacles_through(points, frame, closing).collect())
    assert ask(False) == [(2, 1), (3, 3)]
    assert ask(True) == [(2, 1), (3, 3), (4, 2), (4, 4)], "two walls that meet are one; a single end is none"


def test_gates_and_dead_ends_of_roads(spark):
    nodes = spark.createDataFrame([(1, {"barrier": "gate"}), (2, {"noexit": "yes"}), (3, {}), (4, {"barrier": "gate"})], "id int, tags map<string, string>")
    refs = spark.createDataFrame([(1,), (2,), (3,), (1,)], "node_id int")
    got = repair.road_marks(nodes, refs, F.col("tags")["barrier"] == "gate", F.col("tags")["noexit"] == "yes")
    assert sorted(map(tuple, got.collect())) == [(1, True, False), (2, False, True)]


def test_chains_that_come_back_end_nowhere(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (9, 1), (5, 6), (6, 7), (8, 8)]
    got = {r.id: r.into for r in regions.chain_ends(spark.createDataFrame(pairs, "id int, into int")).collect()}
    assert got == {1: None, 2: None, 3: None, 9: None, 5: 7, 6: 7, 8: None}
