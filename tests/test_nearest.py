"""The nearest segment of each place in a square, against all pairs, and what that costs as the map gets denser."""

from __future__ import annotations

import numpy as np
import pytest

from orogena.operators.nearest import Nearest


def square(seed, places, lines, reach, side=2000):
    rng = np.random.default_rng(seed)
    y, x = (rng.integers(0, side, places) for _ in range(2))
    a = rng.integers(0, side, (2, lines))
    b = a + rng.integers(-reach, reach + 1, (2, lines))
    segs = {"way_id": rng.integers(0, lines // 3, lines), "seg": np.arange(lines) % 3, "a": np.arange(lines) * 2, "b": np.arange(lines) * 2 + 1}
    return y, x, np.arange(places) * 6, rng.integers(0, lines // 3, places), segs | {"a_lat": a[0], "a_lon": a[1], "b_lat": b[0], "b_lon": b[1]}


def nearest_of_all(y, x, node, way, s, limit):
    out = []
    ay, ax, by, bx = (s[c].astype(object) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))
    for k in range(len(y)):
        best = (np.inf, 0, 0, -1)
        for i in range(len(ay)):
            if s["way_id"][i] == way[k] or node[k] in (s["a"][i], s["b"][i]):
                continue
            dy, dx, py, px = by[i] - ay[i], bx[i] - ax[i], int(y[k]) - ay[i], int(x[k]) - ax[i]
            n, t = dy * dy + dx * dx, py * dy + px * dx
            d = py * py + px * px if t <= 0 else (py - dy) ** 2 + (px - dx) ** 2 if t >= n else (py * dx - px * dy) ** 2 / n
            if d <= limit * limit:
                best = min(best, (d, s["way_id"][i], s["seg"][i], i))
        out.append(best[:3])
    return out


@pytest.mark.parametrize(("reach", "start"), [(0, 3), (40, 1), (40, 500), (3000, 1), (3000, 90)])
def test_nearest_of_all_pairs(reach, start):
    y, x, node, way, segs = square(reach + start, 150, 120, reach)
    y[:20], x[:20] = segs["a_lat"][:20], segs["a_lon"][:20]  # some on a segment's end, and equal distances
    segs["b_lon"][::5] = segs["a_lon"][::5]
    found = Nearest(y, x, node, way)
    at = found.found(segs, start, 90)
    want = nearest_of_all(y, x, node, way, segs, 90)
    assert [(b, w, g) if i >= 0 else (np.inf, 0, 0) for b, w, g, i in zip(found.best, found.way, found.seg, at)] == want
    assert any(w[0] < np.inf for w in want)


def test_what_is_looked_at_grows_less_than_the_pairs():
    cost = []
    for n in (3000, 48_000):
        y, x, node, way, segs = square(5, n, n, 300)
        found = Nearest(y, x, node, way)
        assert (found.found(segs, 20 if n == 3000 else 2, 200) >= 0).all()
        cost.append(found.looked)
    assert cost[1] < 16**1.6 * cost[0], "sixteen times the places and segments are 256 times the pairs"
