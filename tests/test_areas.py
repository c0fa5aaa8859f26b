"""Tiles halved, moved off round borders and divided at 180 degrees, with the ground they cover counted."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orogena.operators import areas, tiling

GRAIN = areas.GRAIN
COLUMNS = "tile int, min_lat int, min_lon int, max_lat int, max_lon int"


def frame(spark, boxes):
    return spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], COLUMNS)


def boxes_of(df):
    return [tuple(r)[1:] for r in df.orderBy("tile").collect()]


def cover(boxes):
    """Cells of the grid by how many boxes hold them."""
    out = {}
    for y0, x0, y1, x1 in boxes:
        assert y0 < y1 and x0 < x1
        for y in range(y0 // GRAIN, y1 // GRAIN):
            for x in range(x0 // GRAIN, x1 // GRAIN):
                out[y, x] = out.get((y, x), 0) + 1
    return out


def test_failed_areas_are_halved(spark):
    boxes = [(0, 0, 4 * GRAIN, 2 * GRAIN), (0, 2 * GRAIN, 4 * GRAIN, 7 * GRAIN), (4 * GRAIN, 0, 5 * GRAIN, GRAIN), (-3 * GRAIN, 0, 0, 7 * GRAIN)]
    got = areas.refined(frame(spark, boxes), spark.createDataFrame([(0,), (1,), (2,), (9,)], "tile int")).orderBy("tile", "part").collect()
    assert [tuple(r) for r in got] == [
        (0, 0, 0, 0, 2 * GRAIN, 2 * GRAIN), (0, 1, 2 * GRAIN, 0, 4 * GRAIN, 2 * GRAIN),
        (1, 0, 0, 2 * GRAIN, 4 * GRAIN, 4 * GRAIN), (1, 1, 0, 4 * GRAIN, 4 * GRAIN, 7 * GRAIN),
        (2, 0, 4 * GRAIN, 0, 5 * GRAIN, GRAIN), (3, 0, -3 * GRAIN, 0, 0, 7 * GRAIN),
    ]
    assert cover([tuple(r)[2:] for r in got]) == cover(boxes)


def cut(rng, box, depth):
    """A random partition of a box on the grid, of which some parts are left out."""
    y0, x0, y1, x1 = box
    tall = rng.random() < 0.5
    lo, hi = (y0, y1) if tall else (x0, x1)
    if depth == 0 or hi - lo < 2 * GRAIN:
        return [box] if rng.random() < 0.8 else []
    at = rng.choice([k for k in range(lo // GRAIN + 1, hi // GRAIN)]) * GRAIN
    a, b = ((y0, x0, at, x1), (at, x0, y1, x1)) if tall else ((y0, x0, y1, at), (y0, at, y1, x1))
    return cut(rng, a, depth - 1) + cut(rng, b, depth - 1)


@pytest.mark.parametrize("seed", range(4))
def test_moved_borders_lose_no_ground(spark, seed):
    rng = random.Random(seed)
    boxes = cut(rng, (-8 * GRAIN, -8 * GRAIN, 8 * GRAIN, 8 * GRAIN), 6)
    before, moved = cover(boxes), boxes_of(areas.nudged(frame(spark, boxes), 4 * GRAIN))
    after = cover(moved)
    assert max(after.values(), default=1) == 1, "no ground is held twice"
    # what every node stood on is still in some tile
    assert set(before) <= set(after)
    assert len(moved) == len(boxes)


def test_borders_move_up_down_or_not(spark):
    g = GRAIN
    up = [(0, 0, 32 * g, 8 * g), (32 * g, 0, 40 * g, 8 * g)]
    assert boxes_of(areas.nudged(frame(spark, up))) == [(0, 0, 33 * g, 8 * g), (33 * g, 0, 40 * g, 8 * g)]
    flat = [(0, 0, 32 * g, 8 * g), (32 * g, 0, 33 * g, 8 * g)]
    assert boxes_of(areas.nudged(frame(spark, flat))) == [(0, 0, 31 * g, 8 * g), (31 * g, 0, 33 * g, 8 * g)]
    # one that starts where nothing ends would leave a row in no area
    bare = [(0, 0, 32 * g, 8 * g), (32 * g, 0, 40 * g, 9 * g)]
    assert boxes_of(areas.nudged(frame(spark, bare))) == [(0, 0, 31 * g, 8 * g), (31 * g, 0, 40 * g, 9 * g)]
    stuck = [(0, 0, 32 * g, 8 * g), (0, 9 * g, 32 * g, 10 * g), (32 * g, 0, 40 * g, 9 * g)]
    assert boxes_of(areas.nudged(frame(spark, stuck))) == stuck
    zero = [(-g * 4, 0, 0, 8 * g), (0, 0, 4 * g, 8 * g)]
    assert boxes_of(areas.nudged(frame(spark, zero))) == zero


def plain_ground(cells, gap=16):
    if not cells:
        return []
    seam = 4096
    ys, xs = [y for y, _ in cells], {x for _, x in cells}
    box = [min(ys), min(xs), max(ys) + 1, max(xs) + 1]
    best, run = (0, 0), 0
    for x in range(box[1], box[3]):
        run = 0 if x in xs else run + 1
        if run > best[1]:
            best = (x - run + 1, run)
    outside = (seam - box[3]) + (box[1] + seam)
    if best[1] <= outside:
        return [(0, *box)]
    west, east = [box[0], box[1], box[2], best[0]], [box[0], sum(best), box[2], box[3]]
    if outside < gap:
        west[1], east[3] = -seam, seam
    return [(0, *west), (1, *east)]


@pytest.mark.parametrize("seed", range(6))
def test_ground_across_the_seam(spark, seed):
    rng = random.Random(seed)
    cells = {(rng.randint(-50, 50), x) for lo, hi in [((-4096, -4000), (3900, 4095)), ((-4000, -3900), (3950, 4060)), ((-10, 500), (600, 700)), ((-4096, -4090), (4080, 4095)), ((0, 0), (0, 0)), ((-4090, -3000), (-4090, -100))][seed : seed + 1] for x in [rng.randint(*lo) for _ in range(40)] + [rng.randint(*hi) for _ in range(40)]}
    got = [tuple(r) for r in areas.ground(spark.createDataFrame(sorted(cells), "cy int, cx int")).orderBy("part").collect()]
    assert got == plain_ground(cells)
    assert len(got) == (1 if seed in (2, 4, 5) else 2)


def test_no_cells_have_no_ground(spark):
    assert areas.ground(spark.createDataFrame([], "cy int, cx int")).count() == 0


def test_near_side(spark):
    rows = spark.createDataFrame([(-179.5, 179.0), (179.5, -179.0), (10.0, 20.0)], "lon double, centre double")
    assert [r[0] for r in rows.select(areas.near_side(F.col("lon"), F.col("centre"))).collect()] == [180.5, -180.5, 10.0]


def test_sums_over_many_blocks(spark):
    rng = random.Random(12)
    cells = {(rng.randint(-200, 200), rng.randint(-200, 200)): rng.randint(1, 9) for _ in range(700)} | {(-64, -64): 3, (63, 64): 2, (64, 63): 5, (0, 0): 1}
    frame = spark.createDataFrame([(*k, n) for k, n in cells.items()], "cy int, cx int, n long")
    totals = tiling.summed_area(frame)
    got = {(r.cy, r.cx): r.total for r in totals.collect()}
    assert got == {(y, x): sum(n for (b, a), n in cells.items() if b <= y and a <= x) for y, x in cells}
    assert tiling.summed_area(frame.limit(0)).count() == 0
    # every corner of a rectangle that is asked for has a total
    full = spark.createDataFrame([(y, x, 1) for y in range(70) for x in range(70)], "cy int, cx int, n long")
    rects = spark.createDataFrame([(1, 0, 0, 70, 70), (2, 10, 20, 30, 25), (3, 5, 5, 6, 6)], "rect int, min_cy int, min_cx int, max_cy int, max_cx int")
    assert {r.rect: r.n for r in tiling.rectangle_counts(tiling.summed_area(full), rects).collect()} == {1: 4900, 2: 100, 3: 1}
