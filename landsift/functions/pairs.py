"""The kernels of ``sweep`` for many pairs of small shapes at once.

The edges of all first shapes of a batch stand in one array, those of all second shapes in
another, each with the row it belongs to; every step works on all pairs of edges of a slab of
rows. Pairs of edges of one row are all tried, so shapes with many edges are left to ``sweep``.
"""

from __future__ import annotations

import numpy as np

from landsift.functions.sweep import FEW, _cross, _spans, point_edge

#: Pairs of edges worked on at a time.
SLAB = 20_000


class Shapes:
    """Edges (n x 4) of the shapes of many rows, in the order of the rows."""

    def __init__(self, edges: np.ndarray, counts: np.ndarray, polygon: np.ndarray):
        self.edges, self.counts, self.polygon = edges, counts, polygon
        self.starts = np.cumsum(counts) - counts
        self.row = np.repeat(np.arange(len(counts)), counts)

    def __len__(self):
        return len(self.counts)

    def part(self, low: int, high: int) -> Shapes:
        first = self.starts[low]
        return Shapes(self.edges[first : first + self.counts[low:high].sum()], self.counts[low:high], self.polygon[low:high])

    def take(self, kept: np.ndarray) -> Shapes:
        return Shapes(self.edges[kept[self.row]], self.counts[kept], self.polygon[kept])


def small(a: Shapes, b: Shapes) -> np.ndarray:
    """Rows whose edges can all be tried."""
    return (a.counts > 0) & (b.counts > 0) & (a.counts * b.counts <= FEW)


def by_slabs(kernel, a: Shapes, b: Shapes) -> np.ndarray:
    ends = np.cumsum(a.counts * b.counts)
    out, low = [], 0
    while low < len(a):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + SLAB, side="right")))
        out.append(kernel(a.part(low, high), b.part(low, high)))
        low = high
    return np.concatenate(out) if out else np.zeros(0)


def _each(rows: np.ndarray, of: Shapes):
    """(item, edge): every item with every edge of the shape of its row."""
    counts = of.counts[rows]
    item = np.repeat(np.arange(len(rows)), counts)
    first = np.repeat(of.starts[rows] - (np.cumsum(counts) - counts), counts)
    return item, first + np.arange(len(item))


def _near(e, f, reach):
    (al, ah), (bl, bh), (ay, az), (by, bz) = _spans(e, 0), _spans(f, 0), _spans(e, 1), _spans(f, 1)
    return (al - reach <= bh) & (bl <= ah + reach) & (ay - reach <= bz) & (by <= az + reach)


def _any(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n) > 0


def _held(px, py, rows, of: Shapes) -> np.ndarray:
    """Even-odd test of points against the shapes of their rows."""
    i, j = _each(rows, of)
    f, y = of.edges[j], py[i]
    up = (f[:, 1] > y) != (f[:, 3] > y)
    i, f, y = i[up], f[up], y[up]
    right = px[i] < f[:, 0] + (y - f[:, 1]) * (f[:, 2] - f[:, 0]) / (f[:, 3] - f[:, 1])
    return np.bincount(i[right], minlength=len(px)) % 2 == 1


def inside(px: np.ndarray, py: np.ndarray, shapes: Shapes) -> np.ndarray:
    """One point per row."""
    return _held(px, py, np.arange(len(px)), shapes)


def overlap(a: Shapes, b: Shapes) -> np.ndarray:
    """Overlap of two signed polygons per row (see ``sweep.overlap``)."""
    n = len(a)
    shift = np.add.reduceat(a.edges[:, :2], a.starts) / a.counts[:, None]
    base = np.minimum(
        np.minimum.reduceat(a.edges[:, [1, 3]].min(axis=1), a.starts), np.minimum.reduceat(b.edges[:, [1, 3]].min(axis=1), b.starts)
    ) - shift[:, 1]

    def trapezoids(s: Shapes):
        e = s.edges - np.tile(shift, 2)[s.row]
        kept = e[:, 0] != e[:, 2]
        e, row = e[kept], s.row[kept]
        back = e[:, 0] > e[:, 2]
        e = np.where(back[:, None], e[:, [2, 3, 0, 1]], e)
        rest = np.column_stack([e[:, 0], e[:, 2], e[:, 1] - base[row], (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])])
        return Shapes(rest, np.bincount(row, minlength=n), s.polygon), np.where(back, 1.0, -1.0)

    (p, a_sign), (q, b_sign) = trapezoids(a), trapezoids(b)
    i, j = _each(p.row, q)
    met = (p.edges[i, 0] <= q.edges[j, 1]) & (q.edges[j, 0] <= p.edges[i, 1])
    i, j = i[met], j[met]
    al, ar, ay, ak = p.edges[i].T
    bl, br, by, bk = q.edges[j].T
    lo, hi = np.maximum(al, bl), np.minimum(ar, br)
    width = hi - lo
    a_lo, a_hi = ay + ak * (lo - al), ay + ak * (hi - al)
    d_lo, d_hi = a_lo - (by + bk * (lo - bl)), a_hi - (by + bk * (hi - bl))
    span = np.abs(d_lo) + np.abs(d_hi)
    top = np.maximum(np.maximum(d_lo, d_hi), 0.0)
    cut = (d_lo > 0) != (d_hi > 0)
    above = np.where(cut, top * top / np.where(span > 0, span, 1.0) / 2, np.maximum((d_lo + d_hi) / 2, 0.0)) * width
    shared = a_sign[i] * b_sign[j] * ((a_lo + a_hi) / 2 * width - above)
    return np.bincount(p.row[i], weights=shared, minlength=n).astype(float)


def distance(a: Shapes, b: Shapes) -> np.ndarray:
    """Least distance of the two shapes of a row; 0 where they meet or one polygon holds the other."""
    n = len(a)
    i, j = _each(a.row, b)
    p, q, row = a.edges[i], b.edges[j], a.row[i]
    least = np.minimum(
        np.minimum(point_edge(p[:, 0], p[:, 1], q), point_edge(p[:, 2], p[:, 3], q)),
        np.minimum(point_edge(q[:, 0], q[:, 1], p), point_edge(q[:, 2], q[:, 3], p)),
    )
    near = _near(p, q, 0.0)
    p, q, met = p[near], q[near], row[near]
    d, f = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]
    s1 = _cross(d[:, 0], d[:, 1], q[:, 0] - p[:, 0], q[:, 1] - p[:, 1])
    s2 = _cross(d[:, 0], d[:, 1], q[:, 2] - p[:, 0], q[:, 3] - p[:, 1])
    s3 = _cross(f[:, 0], f[:, 1], p[:, 0] - q[:, 0], p[:, 1] - q[:, 1])
    s4 = _cross(f[:, 0], f[:, 1], p[:, 2] - q[:, 0], p[:, 3] - q[:, 1])
    zero = _any(met[(s1 * s2 < 0) & (s3 * s4 < 0)], n)
    for s, of in ((b, a), (a, b)):
        asked = of.polygon[s.row]
        e, rows = s.edges[asked], s.row[asked]
        zero |= _any(rows[_held(e[:, 0], e[:, 1], rows, of)], n)
    return np.where(zero, 0.0, np.minimum.reduceat(least, np.cumsum(a.counts * b.counts) - a.counts * b.counts))


def covers(a: Shapes, b: Shapes, tolerance: float) -> np.ndarray:
    """Polygon a of a row, grown by the tolerance, holds polygon b (see ``sweep.covers``)."""
    n = len(a)
    e = b.edges
    d = e[:, 2:] - e[:, :2]
    square = np.maximum((d * d).sum(axis=1), 1e-300)
    every = np.arange(len(e))
    i, j = _each(b.row, a)
    near = _near(e[i], a.edges[j], 4 * tolerance)
    i, g = i[near], a.edges[j[near]]
    f, gap = g[:, 2:] - g[:, :2], g[:, :2] - e[i, :2]
    den = _cross(d[i, 0], d[i, 1], f[:, 0], f[:, 1])
    t = _cross(gap[:, 0], gap[:, 1], f[:, 0], f[:, 1]) / np.where(den != 0, den, 1.0)
    edge = np.concatenate([every, every, i[den != 0], i, i])
    at = np.concatenate([
        np.zeros(len(e)), np.ones(len(e)), t[den != 0], (gap * d[i]).sum(axis=1) / square[i], ((g[:, 2:] - e[i, :2]) * d[i]).sum(axis=1) / square[i],
    ])
    at = np.clip(at, 0.0, 1.0)
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    same = edge[1:] == edge[:-1]
    edge, at = np.concatenate([edge, edge[1:][same]]), np.concatenate([at, ((at[1:] + at[:-1]) / 2)[same]])
    px, py = e[edge, 0] + at * d[edge, 0], e[edge, 1] + at * d[edge, 1]
    out = ~_held(px, py, b.row[edge], a)
    px, py, rows = px[out], py[out], b.row[edge][out]
    i, j = _each(rows, a)
    close = point_edge(px[i], py[i], a.edges[j]) <= tolerance
    beyond = np.ones(len(px), bool)
    beyond[i[close]] = False
    # a hole of a inside b leaves no edge of b outside, but it leaves area
    first = e[b.starts][b.row]
    turned = _cross(e[:, 0] - first[:, 0], e[:, 1] - first[:, 1], e[:, 2] - first[:, 0], e[:, 3] - first[:, 1])
    size = np.abs(np.bincount(b.row, weights=turned, minlength=n) / 2)
    outline = np.bincount(b.row, weights=np.hypot(d[:, 0], d[:, 1]), minlength=n) + np.bincount(
        a.row, weights=np.hypot(a.edges[:, 2] - a.edges[:, 0], a.edges[:, 3] - a.edges[:, 1]), minlength=n
    )
    return ~_any(rows[beyond], n) & (size - overlap(a, b) <= tolerance * outline + 1e-9)


def length_within(lines: Shapes, outlines: Shapes, band: float) -> np.ndarray:
    """Length of the line of a row within ``band`` of its outline (see ``sweep.length_within``)."""
    n = len(lines)
    e = lines.edges
    size = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    i, j = _each(lines.row, outlines)
    near = (size[i] > 0) & _near(e[i], outlines.edges[j], band)
    i, f = i[near], outlines.edges[j[near]]
    x, y, whole = e[i, 0], e[i, 1], size[i]
    ux, uy = (e[i, 2] - x) / whole, (e[i, 3] - y) / whole
    lo, hi = np.full(len(i), np.inf), np.full(len(i), -np.inf)
    for cx, cy in ((f[:, 0], f[:, 1]), (f[:, 2], f[:, 3])):  # round caps
        mid = (cx - x) * ux + (cy - y) * uy
        rest = band * band - ((cx - x - mid * ux) ** 2 + (cy - y - mid * uy) ** 2)
        half = np.sqrt(np.maximum(rest, 0.0))
        lo = np.where(rest >= 0, np.minimum(lo, mid - half), lo)
        hi = np.where(rest >= 0, np.maximum(hi, mid + half), hi)
    long = np.hypot(f[:, 2] - f[:, 0], f[:, 3] - f[:, 1])
    vx, vy = ((f[:, k + 2] - f[:, k]) / np.where(long > 0, long, 1.0) for k in (0, 1))
    t_lo, t_hi = np.zeros(len(i)), whole.copy()
    for start, rate, low, high in (  # the straight part: two slabs
        ((x - f[:, 0]) * vx + (y - f[:, 1]) * vy, ux * vx + uy * vy, 0.0, long),
        ((y - f[:, 1]) * vx - (x - f[:, 0]) * vy, uy * vx - ux * vy, -band, band),
    ):
        flat = np.abs(rate) < 1e-15
        t1, t2 = ((v - start) / np.where(flat, 1.0, rate) for v in (low, high))
        held = (low <= start) & (start <= high)
        t_lo = np.maximum(t_lo, np.where(flat, np.where(held, 0.0, np.inf), np.minimum(t1, t2)))
        t_hi = np.minimum(t_hi, np.where(flat, np.where(held, np.inf, -np.inf), np.maximum(t1, t2)))
    some = (t_lo <= t_hi) & (long > 0)
    lo, hi = np.where(some, np.minimum(lo, t_lo), lo), np.where(some, np.maximum(hi, t_hi), hi)
    lo, hi = np.maximum(lo, 0.0), np.minimum(hi, whole)
    order = np.lexsort((lo, i))
    kept = order[(lo < hi)[order]]
    i, lo, hi = i[kept], lo[kept], hi[kept]
    # the largest end so far on the same edge of the line, by doubling
    most, step = hi.copy(), 1
    while step < len(i) and (i[step:] == i[:-step]).any():
        same = i[step:] == i[:-step]
        most[step:] = np.where(same, np.maximum(most[step:], most[:-step]), most[step:])
        step *= 2
    reached = np.full(len(i), -np.inf)
    if len(i):
        reached[1:] = np.where(i[1:] == i[:-1], most[:-1], -np.inf)
    return np.bincount(lines.row[i], weights=np.maximum(0.0, hi - np.maximum(lo, reached)), minlength=n).astype(float)
