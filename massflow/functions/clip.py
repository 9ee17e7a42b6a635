"""Many convex polygons at once as numpy arrays: cut, measured, and laid over a raster.

What tasks do for a batch of cells: a polygon is a row of ``xy`` (rows x corners x 2) of which the
first ``n`` corners count, and ``tags`` name what lies across the edge that follows each corner.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Parts of polygons that are cut to pixels at a time.
PARTS = 100_000


@dataclass
class Polygons:
    xy: np.ndarray
    tags: np.ndarray
    n: np.ndarray

    @classmethod
    def copies(cls, corners: list[tuple[float, float]], rows: int) -> Polygons:
        """``rows`` times the same polygon, its edges tagged -1, -2, ..."""
        k = len(corners)
        out = cls(np.zeros((rows, k + 6, 2)), np.zeros((rows, k + 6), dtype=np.int64), np.full(rows, k))
        out.xy[:, :k], out.tags[:, :k] = np.array(corners, dtype=float).reshape(k, 2), -1 - np.arange(k)
        return out

    def __len__(self) -> int:
        return len(self.n)

    def take(self, rows: np.ndarray) -> Polygons:
        return Polygons(self.xy[rows], self.tags[rows], self.n[rows])

    def counted(self) -> np.ndarray:
        return np.arange(self.xy.shape[1]) < self.n[:, None]

    def row(self, i: int) -> tuple[list[tuple[float, float]], list[int]]:
        k = int(self.n[i])
        return [tuple(p) for p in self.xy[i, :k].tolist()], self.tags[i, :k].tolist()

    def cut(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, tag: np.ndarray) -> None:
        """The polygons at ``rows`` (each once) where a * x + b * y <= c; new edges get ``tag``."""
        eps = 1e-12 * (np.abs(c) + np.hypot(a, b))
        n = self.n[rows]
        k = np.arange(self.xy.shape[1])
        gaps = np.where(k < n[:, None], c[:, None] - a[:, None] * self.xy[rows, :, 0] - b[:, None] * self.xy[rows, :, 1], np.inf)
        hit = gaps.min(axis=1) < -eps
        if not hit.any():
            return
        rows, gaps, n, eps, tag = rows[hit], gaps[hit], n[hit], eps[hit], tag[hit]
        inside = (gaps > eps[:, None]) & (k < n[:, None])
        before = np.take_along_axis(inside, (k - 1) % n[:, None], axis=1)
        begins = inside & ~before
        left, first = inside.sum(axis=1), begins.argmax(axis=1)
        width = int(left.max()) + 2
        if width > self.xy.shape[1]:
            more = width + 4 - self.xy.shape[1]
            self.xy = np.pad(self.xy, ((0, 0), (0, more), (0, 0)))
            self.tags = np.pad(self.tags, ((0, 0), (0, more)))
        at = (first[:, None] - 1 + np.arange(width)) % n[:, None]
        xy, tags = self.xy[rows[:, None], at], self.tags[rows[:, None], at]
        each = np.arange(len(rows))

        def crossing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            g, h = gaps[each, p], gaps[each, q]
            with np.errstate(all="ignore"):  # of polygons with nothing left
                t = (g / (g - h))[:, None]
                return self.xy[rows, p] + t * (self.xy[rows, q] - self.xy[rows, p])

        entry, leave = (first - 1) % n, (first + left - 1) % n
        end = np.minimum(left + 1, width - 1)
        into, out = crossing(entry, first), crossing(leave, (leave + 1) % n)
        xy[:, 0], xy[each, end], tags[each, end] = into, out, tag
        split = np.flatnonzero(begins.sum(axis=1) > 1)  # rounding: more than one run of corners is inside
        kept = [self._by_corners(int(rows[i]), gaps[i], float(eps[i]), int(tag[i])) for i in split]
        self.xy[rows, :width], self.tags[rows, :width] = xy, tags
        self.n[rows] = np.where(left > 0, left + 2, 0)
        for i, (poly, names) in zip(split, kept, strict=True):
            if len(poly) > self.xy.shape[1]:
                more = len(poly) + 4 - self.xy.shape[1]
                self.xy, self.tags = np.pad(self.xy, ((0, 0), (0, more), (0, 0))), np.pad(self.tags, ((0, 0), (0, more)))
            self.n[rows[i]] = len(poly)
            self.xy[rows[i], : len(poly)], self.tags[rows[i], : len(poly)] = np.array(poly).reshape(-1, 2), names

    def _by_corners(self, row: int, gaps: np.ndarray, eps: float, tag: int) -> tuple[list, list]:
        poly, tags = self.row(row)
        out, names = [], []
        for k, p in enumerate(poly):
            j = (k + 1) % len(poly)
            q, g, h = poly[j], float(gaps[k]), float(gaps[j])
            here, there = g > eps, h > eps
            if here:
                out.append(p)
                names.append(tags[k])
            if here != there:
                t = g / (g - h)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                names.append(tag if here else tags[k])
        return (out, names) if len(out) > 2 else ([], [])

    def reach(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the corners are from each polygon's (x, y); -1 without corners."""
        far = np.hypot(self.xy[:, :, 0] - x[:, None], self.xy[:, :, 1] - y[:, None])
        return np.where(self.counted(), far, -1.0).max(axis=1)

    def moments(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows of the area and the integrals of dx, dy and dx^2 + dy^2, d from each polygon's (x, y)."""
        ok = self.counted()
        v = np.where(ok[:, :, None], self.xy - np.stack([x, y], axis=1)[:, None], 0.0)
        after = (np.arange(self.xy.shape[1]) + 1) % np.maximum(1, self.n)[:, None]
        u = np.take_along_axis(v, after[:, :, None], axis=1)
        k = np.where(ok, v[:, :, 0] * u[:, :, 1] - u[:, :, 0] * v[:, :, 1], 0.0)
        first = (k[:, :, None] * (v + u)).sum(axis=1) / 6
        return np.column_stack([k.sum(axis=1) / 2, first, (k * (v * v + v * u + u * u).sum(axis=2)).sum(axis=1) / 12])

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tag, ends): each edge with its polygon's row; ends are x0, y0, x1, y1."""
        row, k = np.nonzero(self.counted())
        p, q = self.xy[row, k], self.xy[row, (k + 1) % self.n[row]]
        return row, self.tags[row, k], np.hstack([p, q])


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows repeated ``counts`` times: each one's row, and its number within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Grid:
    """A raster's values ``v`` (x, y) from the pixel (x0, y0) on."""

    x0: int
    y0: int
    v: np.ndarray
    corners: bool = False

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, v: np.ndarray, corners: bool = False) -> Grid:
        if not len(x):
            return cls(0, 0, np.zeros((1, 1)), corners)
        x0, y0 = int(x.min()), int(y.min())
        values = np.zeros((int(x.max()) - x0 + 1, int(y.max()) - y0 + 1))
        np.add.at(values, (x - x0, y - y0), np.nan_to_num(v.astype(float)))
        return cls(x0, y0, values, corners)

    def _lanes(self, p: Polygons, axis: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of the raster's columns (rows, for axis 1) that each polygon lies in, and their number."""
        ok = p.counted()
        low = np.where(ok, p.xy[:, :, axis], np.inf).min(axis=1)
        high = np.where(ok, p.xy[:, :, axis], -np.inf).max(axis=1)
        start, size = (self.x0, self.y0)[axis], self.v.shape[axis]
        some = p.n > 2
        first = np.where(some, np.clip(np.floor(np.where(some, low, 0)), start, start + size), 0).astype(np.int64)
        end = np.where(some, np.clip(np.ceil(np.where(some, high, 0)), start, start + size), 0).astype(np.int64)
        return first, np.maximum(0, end - first)

    def _lane(self, p: Polygons, row: np.ndarray, lane: np.ndarray, axis: int) -> Polygons:
        part, every, one, none = p.take(row), np.arange(len(row)), np.ones(len(row)), np.zeros(len(row))
        a, b = (one, none) if axis == 0 else (none, one)
        part.cut(every, a, b, lane + 1.0, every)
        part.cut(every, -a, -b, -lane.astype(float), every)
        return part

    def moments(self, p: Polygons, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As Polygons.moments, of the raster's mass in each polygon. With ``corners`` a pixel's part stands at its lower left corner."""
        out = np.zeros((len(p), 4))
        first, count = self._lanes(p, 0)
        row, k = _runs(count)
        for lo in range(0, len(row), PARTS):
            of, column = row[lo : lo + PARTS], first[row[lo : lo + PARTS]] + k[lo : lo + PARTS]
            strips = self._lane(p, of, column, 0)
            begin, high = self._lanes(strips, 1)
            ends = np.cumsum(high)
            i = 0
            while i < len(of):  # strips that make about PARTS parts at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PARTS, side="right")))
                strip, m = _runs(high[i:j])
                strip, line = strip + i, begin[strip + i] + m
                parts, cell, pixel = self._lane(strips, strip, line, 1), of[strip], column[strip]
                got = parts.moments(x[cell], y[cell])
                if self.corners:
                    dx, dy = pixel - x[cell], line - y[cell]
                    got = got[:, :1] * np.column_stack([np.ones(len(cell)), dx, dy, dx * dx + dy * dy])
                got = got * self.v[pixel - self.x0, line - self.y0][:, None]
                for c in range(4):
                    out[:, c] += np.bincount(cell, weights=got[:, c], minlength=len(p))
                i = j
        return out

    def along(self, ends: np.ndarray) -> np.ndarray:
        """The raster's integral along each segment (x0, y0, x1, y1)."""
        cuts = []
        for lo, hi in ((ends[:, 0], ends[:, 2]), (ends[:, 1], ends[:, 3])):
            low, high = np.minimum(lo, hi), np.maximum(lo, hi)
            first = np.floor(low).astype(np.int64) + 1
            row, k = _runs(np.maximum(0, np.ceil(high).astype(np.int64) - first))
            cuts.append((row, (first[row] + k - lo[row]) / (hi[row] - lo[row])))
        n = np.arange(len(ends))
        row = np.concatenate([n, n, *(r for r, _ in cuts)])
        t = np.concatenate([np.zeros(len(n)), np.ones(len(n)), *(t for _, t in cuts)])
        order = np.lexsort((t, row))
        row, t = row[order], t[order]
        same = row[1:] == row[:-1]
        row, a, b = row[1:][same], t[:-1][same], t[1:][same]
        at = ends[row, :2] + (ends[row, 2:] - ends[row, :2]) * ((a + b) / 2)[:, None]
        i, j = np.floor(at[:, 0]).astype(np.int64) - self.x0, np.floor(at[:, 1]).astype(np.int64) - self.y0
        ok = (i >= 0) & (j >= 0) & (i < self.v.shape[0]) & (j < self.v.shape[1])
        length = np.hypot(ends[row, 2] - ends[row, 0], ends[row, 3] - ends[row, 1]) * (b - a)
        v = np.where(ok, self.v[np.where(ok, i, 0), np.where(ok, j, 0)], 0.0)
        return np.bincount(row, weights=v * length, minlength=len(ends))
