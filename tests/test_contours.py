"""Contours against a plain walk over the whole raster, and the tidying of lines."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from orogena.operators import contours

RASTER = "cell int, row int, col int, height int"
SHIFT = 1 << 20


def key(row, col, south):
    return (row * SHIFT + col) * 2 + south


def plain_lines(grid, step):
    """(level, start, closed) -> points, by marching squares and one walk over the raster; grid is row -> column -> height."""
    out = {}
    cells = {(r, c): h for r, row in enumerate(grid) for c, h in enumerate(row) if h is not None}
    levels = range((min(cells.values(), default=0) // step - 1) * step, max(cells.values(), default=0) + step, step)
    for level in levels:
        links, at = defaultdict(list), {}
        for (r, c), nw in sorted(cells.items()):
            around = [cells.get(k) for k in ((r, c + 1), (r + 1, c), (r + 1, c + 1))]
            if None in around:
                continue
            ne, sw, se = around
            edges = {}
            for name, a, b, k in (("top", nw, ne, key(r, c, 0)), ("bottom", sw, se, key(r + 1, c, 0)), ("left", nw, sw, key(r, c, 1)), ("right", ne, se, key(r, c + 1, 1))):
                if (a > level) != (b > level):
                    edges[name] = k
                    at[k] = (level - a) / (b - a)
            pairs = []
            if len(edges) == 2:
                pairs = [tuple(edges.values())]
            elif edges:
                high = (nw + ne + sw + se) / 4 > level
                pairs = [(edges["top"], edges["right"]), (edges["left"], edges["bottom"])] if high == (nw > level) else [(edges["top"], edges["left"]), (edges["right"], edges["bottom"])]
            for a, b in pairs:
                links[a].append(b)
                links[b].append(a)
        for start in [*sorted(k for k in links if len(links[k]) == 1), *sorted(links)]:
            path = [start]
            while links[path[-1]]:
                nxt = links[path[-1]].pop(0)
                links[nxt].remove(path[-1])
                path.append(nxt)
            if len(path) > 1:
                points = []
                for k in path:
                    row, col, south = k // 2 // SHIFT, k // 2 % SHIFT, k % 2
                    points.append((k, row + at[k] if south else float(row), float(col) if south else col + at[k]))
                out[level, start, path[0] == path[-1]] = points
    return out


def frame(spark, grids):
    rows = [(g, r, c, h) for g, grid in enumerate(grids) for r, row in enumerate(grid) for c, h in enumerate(row)]
    return spark.createDataFrame(rows, RASTER)


def traced(spark, grids, step, block):
    found = defaultdict(list)
    for r in contours.line_points(frame(spark, grids), step, block).collect():
        found[r.cell, r.level, r.line, r.closed].append((r.pos, (r.key, r.y, r.x)))
    out = {}
    for k, points in found.items():
        points.sort()
        assert [p for p, _ in points] == list(range(len(points)))
        out[k] = [x for _, x in points]
    return out


def hills(seed, n, voids=0.03, rough=12):
    rng = random.Random(seed)
    tops = [(rng.uniform(0, n), rng.uniform(0, n), rng.uniform(20, 90), rng.uniform(1, n / 2)) for _ in range(5)]
    grid = []
    for r in range(n):
        grid.append([None if rng.random() < voids else int(sum(h / (1 + ((r - y) ** 2 + (c - x) ** 2) / w**2) for y, x, h, w in tops)) + rng.randint(0, rough) for c in range(n)])
    return grid


@pytest.mark.parametrize(("block", "rough"), [(3, 12), (5, 0), (64, 3)])
def test_lines_are_those_of_a_plain_walk(spark, block, rough):
    grids = [hills(1, 18, rough=rough), hills(2, 21, voids=0, rough=rough)]
    got = traced(spark, grids, 7, block)
    want = {(g, *k): v for g, grid in enumerate(grids) for k, v in plain_lines(grid, 7).items()}
    assert len({k[3] for k in want}) == 2
    assert got == want


def test_long_lines_over_many_blocks(spark):
    n = 24
    comb = [[0 if (c % 2 == 1 and not (r == n - 1 if c % 4 == 1 else r == 0)) else 10 for c in range(n)] for r in range(n)]
    ring = [[10 if 0 < r < n - 1 and 0 < c < n - 1 and not (3 < r < 20 and 3 < c < 20) else 0 for c in range(n)] for r in range(n)]
    got = traced(spark, [comb, ring], 20, 2)
    want = {(g, *k): v for g, grid in enumerate([comb, ring]) for k, v in plain_lines(grid, 20).items()}
    assert got == want
    assert max(map(len, got.values())) > 80, "over many blocks of two squares"
    assert sum(k[0] == 1 and k[3] for k in got) == 2


def levels_of(spark, grid, step=10):
    return [(k[1], k[3]) for k in traced(spark, [grid], step, 64)]


def test_levels_and_shapes(spark):
    assert levels_of(spark, [[10, 10], [10, 10]]) == []
    assert levels_of(spark, [[5, 15], [5, 15]]) == [(10, False)]
    assert sorted({x for x, _ in levels_of(spark, [[0, 15, 45]] * 3)}) == [0, 10, 20, 30, 40]
    assert levels_of(spark, [[12, 18], [12, 18]]) == []
    assert levels_of(spark, [[0, 20], [None, 20]]) == []
    hill = [[0] * 5, [0, 5, 5, 5, 0], [0, 5, 30, 5, 0], [0, 5, 5, 5, 0], [0] * 5]
    assert all(closed for _, closed in levels_of(spark, hill)) and levels_of(spark, hill)
    assert contours.line_points(frame(spark, [hill]), 0).count() == 0
    assert contours.line_points(frame(spark, []), 10).count() == 0


def test_tidied_lines():
    assert contours.tidied([0, 1, 2, 3], [0, 0, 0, 0]) == [0, 3]
    assert contours.tidied([0, 1, 1, 2], [0, 1, 1, 2]) == [0, 3]
    assert contours.tidied([0, 1, 0, 1], [0, 0, 0, 1]) == [0, 1, 2, 3], "a spike keeps its tip"
    assert contours.tidied([0, 1, 2], [0, 1e-10, 0]) == [0, 2]
    assert contours.tidied([0, 1, 2], [0, 1e-6, 0]) == [0, 1, 2]
    assert contours.tidied([0, 0, 1, 1, 0], [0, 1, 1, 0, 0]) == [0, 1, 2, 3, 4]


def test_lines_are_cut_where_they_are_long(spark):
    rows = [(0, 10, 5, i, float(i), float(i * i), False) for i in range(11)] + [(0, 10, 9, i, 1.0, 2.0, False) for i in range(3)]
    points = spark.createDataFrame(rows, "cell int, level int, line long, pos long, lat double, lon double, closed boolean")
    got = {(r.line, r.part): r.lats for r in contours.simplified_lines(points, most=4).collect()}
    assert got == {(5, 0): [0, 1, 2, 3], (5, 1): [3, 4, 5, 6], (5, 2): [6, 7, 8, 9], (5, 3): [9, 10]}


def test_points_on_the_ground(spark):
    points = contours.line_points(frame(spark, [[[5, 15], [5, 15]]]), 10)
    got = sorted((r.lat, r.lon) for r in contours.on_ground(points, 2, spark.createDataFrame([(0, 44, 33)], "cell int, lat int, lon int")).collect())
    assert got == [(44.0, 33.5), (45.0, 33.5)]
