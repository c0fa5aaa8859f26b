"""Windows, summits and dead edges over the borders of rasters; lines cut at the shore."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from orogena.operators import borders, contours, rasters

SIDE = 9
RASTER, CORNERS = "cell int, row int, col int, height int", "cell int, lat int, lon int"
#: Four rasters on both sides of 180 degrees, the north-east one absent.
PLACES = {0: (10, 178), 1: (10, 179), 2: (10, -180), 3: (9, 178), 4: (9, 179)}


def world(seed):
    """Heights by place of the whole lattice, and the rasters cut from it."""
    rng = random.Random(seed)
    at = {}

    def height(cell, r, c):
        lat, lon = PLACES[cell]
        place = ((lat + 1) * 8 - r, (lon % 360) * 8 + c)
        return at.setdefault(place, rng.randint(1, 500))

    grids = {k: [[height(k, r, c) for c in range(SIDE)] for r in range(SIDE)] for k in PLACES}
    return at, grids


def frames(spark, grids):
    rows = [(k, r, c, h) for k, grid in grids.items() for r, line in enumerate(grid) for c, h in enumerate(line)]
    return spark.createDataFrame(rows, RASTER), spark.createDataFrame([(k, *p) for k, p in PLACES.items()], CORNERS)


def place_of(cell, r, c):
    lat, lon = PLACES[cell]
    return (lat + 1) * 8 - r, (lon % 360) * 8 + c


def test_a_halo_has_what_lies_beyond(spark):
    at, grids = world(1)
    raster, corners = frames(spark, grids)
    got = {(r.cell, r.row, r.col): r.height for r in borders.with_halo(raster, corners, SIDE, 2).collect()}
    want = {(k, r, c): at[place_of(k, r, c)] for k in PLACES for r in range(-2, SIDE + 2) for c in range(-2, SIDE + 2) if place_of(k, r, c) in at}
    # a place beyond two rasters that aren't neighbours of this one isn't seen
    assert got == {p: h for p, h in want.items() if p in got} and len(got) > 5 * SIDE * SIDE + 100
    assert {p for p in want if 0 <= p[1] < SIDE and 0 <= p[2] < SIDE} <= set(got)
    centres = spark.createDataFrame([(0, 4, 8), (1, 0, 0), (4, 0, 4), (2, 4, 0)], "cell int, row int, col int")
    seen = {(r.cell, r.row, r.col): r.local_max for r in rasters.focal_max(borders.with_halo(raster, corners, SIDE, 2), centres, 2).collect()}
    for (k, r, c), most in seen.items():
        assert most == max(h for (kk, rr, cc), h in got.items() if kk == k and abs(rr - r) <= 2 and abs(cc - c) <= 2)


def test_summits_are_burnt_on_both_sides(spark):
    _, grids = world(2)
    grids = {k: [[100] * SIDE for _ in range(SIDE)] for k in grids}
    raster, corners = frames(spark, grids)
    peaks = spark.createDataFrame([(1, 0, 4, 8, 150), (2, 3, 0, 0, 140)], "id int, cell int, row int, col int, ele int")
    got = {(r.cell, r.row, r.col): r.height for r in borders.burnt_over_borders(peaks, raster, corners, SIDE).collect()}
    assert got[0, 4, 8] == got[1, 4, 0] == got[0, 3, 7] == got[1, 3, 1] == 150
    assert got[3, 0, 0] == got[0, 8, 0] == got[0, 7, 1] == got[3, 1, 1] == 140
    assert not any(k[1] < 0 or k[2] < 0 or k[1] >= SIDE or k[2] >= SIDE for k in got)


def plainly_repaired(grids):
    """Each raster by itself, edge by edge."""
    by_place = {p: k for k, p in PLACES.items()}
    last, out = SIDE - 1, {}
    for k, grid in grids.items():
        new = [line[:] for line in grid]
        lat, lon = PLACES[k]
        column, row = lambda g, c: [line[c] for line in g], lambda g, r: g[r]
        dead = lambda line: all(h == 0 for h in line)
        edges = [("east", column, last, last - 1, 0, 1, 0), ("west", column, 0, 1, 0, -1, last), ("south", row, last, last - 1, -1, 0, 0), ("north", row, 0, 1, 1, 0, last)]
        judged = [e for e in edges if dead(e[1](grid, e[2])) and not dead(e[1](grid, e[3]))]
        for name, line, outer, inner, dy, dx, theirs in judged:
            other = by_place.get((lat + dy, (lon + dx + 180) % 360 - 180))
            source = line(grids[other], theirs) if other is not None and not dead(line(grids[other], theirs)) else line(new, inner)
            for i, h in enumerate(list(source)):
                r, c = (i, outer) if line is column else (outer, i)
                new[r][c] = h
                out[k, r, c] = h
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dead_edges_are_filled_from_over_the_border(spark, seed):
    rng = random.Random(seed)
    _, grids = world(seed)
    for grid in grids.values():
        for name in ("east", "west", "south", "north"):
            if rng.random() < 0.5:
                for i in range(SIDE):
                    r, c = {"east": (i, SIDE - 1), "west": (i, 0), "south": (SIDE - 1, i), "north": (0, i)}[name]
                    grid[r][c] = 0
    raster, corners = frames(spark, grids)
    found = borders.repaired_edges(raster, corners, SIDE).collect()
    got = {(r.cell, r.row, r.col): r.height for r in found}
    assert len(got) == len(found)
    assert got == plainly_repaired(grids) and got


def plain_pieces(points, wet, scale):
    """Pieces of one line (lat, lon), point by point."""
    sea = lambda p: (math.floor(p[0] * scale), math.floor(p[1] * scale)) in wet

    def shore(dry, deep):
        for _ in range(6):
            m = ((dry[0] + deep[0]) / 2, (dry[1] + deep[1]) / 2)
            dry, deep = (dry, m) if sea(m) else (m, deep)
        return dry

    out, run, from_shore, before = [], [], False, None

    def close(at_shore):
        size = sum(math.hypot((b[1] - a[1]) * math.cos(math.radians(a[0])), b[0] - a[0]) for a, b in zip(run, run[1:]))
        if len(run) >= 2 and not (at_shore and from_shore and size < 2 / scale):
            out.append(list(run))
        run.clear()

    for p in points:
        w = sea(p)
        if before is not None and before[1] != w:
            run.append(shore(before[0] if w else p, p if w else before[0]))
            if w:
                close(True)
            else:
                from_shore = True
        if not w:
            run.append(p)
        before = (p, w)
    close(False)
    return out


def test_lines_end_on_the_shore(spark):
    rng = random.Random(9)
    scale, lines = 100, {}
    wet = {(rng.randint(4400, 4420), rng.randint(3300, 3320)) for _ in range(150)}
    for k in range(30):
        y, x = 44 + rng.random() * 0.2, 33 + rng.random() * 0.2
        points = []
        for _ in range(rng.randint(2, 25)):
            points.append((y, x))
            y, x = y + rng.uniform(-0.02, 0.02), x + rng.uniform(-0.02, 0.02)
        lines[k] = (points + points[:1], True) if k % 3 == 0 else (points, False)
    lines[99] = ([(10.0, 10.0), (10.1, 10.1), (10.0, 10.0)], True)
    rows = [(0, 10, k, i, *p, closed) for k, (points, closed) in lines.items() for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "cell int, level int, line long, pos long, lat double, lon double, closed boolean")
    found = defaultdict(list)
    told = {}
    for r in contours.dry_pieces(frame, spark.createDataFrame(sorted(wet), "cy int, cx int"), scale).collect():
        found[r.line, r.piece].append((r.nth, (r.lat, r.lon)))
        told[r.line, r.piece] = r.closed
    for k, (points, closed) in lines.items():
        got = [[p for _, p in sorted(found[key])] for key in sorted(found) if key[0] == k]
        want = plain_pieces(points, wet, scale)
        assert len(got) == len(want) and all(len(a) == len(b) and all(math.dist(p, q) < 1e-12 for p, q in zip(a, b)) for a, b in zip(got, want)), k
        dry = not any((math.floor(y * scale), math.floor(x * scale)) in wet for y, x in points)
        assert all(told[key] == (closed and dry) for key in found if key[0] == k)
    assert any(key[1] > 1 for key in found) and told[99, 0]
