"""The nearest segment of each place in one square of the map, on arrays; :func:`orogena.operators.places.nearest_segments` deals the squares.

Places lie in rows and, sorted, in columns of a grid as fine as their number asks for.  A segment is followed along its longer axis, row by
row, and meets in each row the places of the columns that it passes there, so that what it costs grows with its length and with the
places close to its line.  Whole numbers up to 2^24 make all products here exact in doubles, and a ratio of them is that of SQL.
"""

from __future__ import annotations

import numpy as np

#: Rows of segments that are looked at together; a row's height and a column's width, in mean distances of places.
VISITS, HEIGHT, WIDTH = 1 << 20, 1.2, 0.3


class Nearest:
    """What is known of each place: the squared distance, the way and number of the nearest segment, and its row; -1 where none is.

    ``looked`` counts the rows in which segments were followed and the pairs that were measured.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, node: np.ndarray, way: np.ndarray) -> None:
        self.y, self.x, self.node, self.own = y.astype(float), x.astype(float), node, way
        self.best, self.looked = np.full(len(y), np.inf), 0
        self.way, self.seg, self.at = (np.full(len(y), -1, np.int64) for _ in range(3))

    def found(self, segs: dict[str, np.ndarray], reach: float, limit: float) -> np.ndarray:
        """Rows of the segments, one for each place, -1 where none is within the limit.

        A place that has a segment closer than some reach needs no farther one looked at; the others are met again four times as far.
        """
        ends = [segs[c].astype(float) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
        steep = np.abs(ends[2] - ends[0]) >= np.abs(ends[3] - ends[1])
        left, reach = np.arange(len(self.y)), min(reach, limit)
        while len(left):
            for rows, (a, b, c, d), u, v in ((np.flatnonzero(steep), (0, 1, 2, 3), self.y, self.x), (np.flatnonzero(~steep), (1, 0, 3, 2), self.x, self.y)):
                self._follow(left, u[left], v[left], rows, [ends[k][rows] for k in (a, b, c, d)], segs, reach)
            if reach >= limit:
                break
            left = left[self.best[left] >= reach * reach]  # one as far as the reach may have an equal beyond it
            reach = min(limit, 4 * reach)
        return self.at

    def _follow(self, left: np.ndarray, u: np.ndarray, v: np.ndarray, rows: np.ndarray, ends: list[np.ndarray], segs: dict[str, np.ndarray], reach: float) -> None:
        if not len(rows):
            return
        u0, v0, top, right = u.min(), v.min(), u.max(), v.max()
        mean = np.sqrt((top - u0 + 1) * (right - v0 + 1) / len(u))
        h, w = max(1.0, HEIGHT * mean), max(1.0, WIDTH * mean)
        n_rows, n_cols = int((top - u0) / h) + 1, int((right - v0) / w) + 1
        cell = ((u - u0) / h).astype(np.int64) * n_cols + ((v - v0) / w).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=n_rows * n_cols)))).astype(np.int32)
        u, v, left = u[order], v[order], left[order]

        a_u, a_v, b_u, b_v = ends
        down = a_u > b_u
        u1, v1, u2, v2 = np.where(down, b_u, a_u), np.where(down, b_v, a_v), np.where(down, a_u, b_u), np.where(down, a_v, b_v)
        du, dv = u2 - u1, v2 - v1
        length = du * du + dv * dv
        slope = np.divide(dv, du, out=np.zeros_like(du), where=du > 0)
        pad = reach * np.sqrt(1 + slope * slope) + 0.01
        # the part of the line from which a place can be reached at all
        low, high = v0 - pad - v1, right + pad - v1
        flat = slope == 0
        one, other = (np.divide(k, slope, out=np.zeros_like(k), where=~flat) for k in (low, high))
        first = np.maximum(np.maximum(u1 - reach, u0), np.where(flat, -np.inf, u1 + np.minimum(one, other)))
        last = np.minimum(np.minimum(u2 + reach, top), np.where(flat, np.inf, u1 + np.maximum(one, other)))
        within = (first <= last) & ~(flat & ((low > 0) | (high < 0)))
        r0 = np.clip(np.floor((first - u0) / h - 1e-9), 0, n_rows - 1)
        r1 = np.clip(np.floor((last - u0) / h + 1e-9), 0, n_rows - 1)
        kept = np.flatnonzero(within)
        r0 = r0[kept].astype(np.int64)
        count = r1[kept].astype(np.int64) - r0 + 1
        step = slope[kept] * (h / w)
        column = (v1[kept] + (u0 - u1[kept]) * slope[kept] - v0 - pad[kept]) / w + np.minimum(step, 0)
        width = np.abs(step) + 2 * pad[kept] / w
        ahead = np.concatenate(([0], np.cumsum(count)))
        at = 0
        while at < len(kept):
            to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + VISITS)) - 1)
            n, base = count[at:to], ahead[at:to] - ahead[at]
            row = np.arange(n.sum()) + np.repeat(r0[at:to] - base, n)
            c = np.repeat(column[at:to], n) + row * np.repeat(step[at:to], n)
            row *= n_cols
            c0 = row + np.clip(c, 0, n_cols).astype(np.int64)
            c1 = row + np.clip(c + np.repeat(width[at:to] + 1, n), 0, n_cols).astype(np.int64)
            i = start[c0]
            met = start[c1] - i
            some = np.flatnonzero(met > 0)
            met = met[some].astype(np.int64)
            self.looked += len(row) + int(met.sum())
            if len(some):
                s = kept[at:to][np.repeat(np.arange(to - at), n)[some]]
                p = np.arange(met.sum()) + np.repeat(i[some] - (np.cumsum(met) - met), met)
                bound = np.minimum(self.best[left], reach * reach)
                s = np.repeat(s, met)
                cross = (u[p] - u1[s]) * dv[s] - (v[p] - v1[s]) * du[s]
                # nearer to the line than what the place has; one on a line without length is told below
                near = np.flatnonzero(cross * cross <= bound[p] * length[s] * (1 + 1e-9))
                self._take(left[p[near]], s[near], u[p[near]], v[p[near]], cross[near], (u1, v1, u2, v2, du, dv, length), rows, segs, reach)
            at = to

    def _take(self, e: np.ndarray, s: np.ndarray, u: np.ndarray, v: np.ndarray, cross: np.ndarray, line: tuple[np.ndarray, ...], rows: np.ndarray, segs: dict[str, np.ndarray], reach: float) -> None:
        u1, v1, u2, v2, du, dv, length = (x[s] for x in line)
        along = (u - u1) * du + (v - v1) * dv
        ratio = np.divide(cross * cross, length, out=np.zeros_like(length), where=length > 0)
        ratio = np.where(along <= 0, (u - u1) ** 2 + (v - v1) ** 2, np.where(along >= length, (u - u2) ** 2 + (v - v2) ** 2, ratio))
        row = rows[s]
        way, seg = segs["way_id"][row], segs["seg"][row]
        ok = (ratio <= np.minimum(self.best[e], reach * reach)) & (way != self.own[e]) & (segs["a"][row] != self.node[e]) & (segs["b"][row] != self.node[e])
        e, ratio, way, seg, row = e[ok], ratio[ok], way[ok], seg[ok], row[ok]
        order = np.lexsort((seg, way, ratio, e))
        order = order[np.flatnonzero(np.diff(e[order], prepend=-1))]
        e, ratio, way, seg, row = e[order], ratio[order], way[order], seg[order], row[order]
        first = (ratio < self.best[e]) | (way < self.way[e]) | ((way == self.way[e]) & (seg < self.seg[e]))
        e = e[first]
        self.best[e], self.way[e], self.seg[e], self.at[e] = ratio[first], way[first], seg[first], row[first]
