"""Geometry columns.

A geometry is ``struct<kind, xs: array<array<double>>, ys: array<array<double>>>``:
one inner array per part (ring, path or point). Polygon rings carry their sign in
their direction: counter-clockwise adds, clockwise cuts out. Boxes need no such
column; they are the four numbers ``x0, y0, x1, y1`` and stay in the JVM. The
kernels for general shapes work on Arrow batches of pairs the box join found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from landsift.functions import pairs
from landsift.functions.pairs import Shapes, by_slabs, small
from landsift.functions.sweep import FEW
from landsift.functions.sweep import covers as _covers
from landsift.functions.sweep import crossing as _crossing
from landsift.functions.sweep import distance as _distance
from landsift.functions.sweep import even_odd
from landsift.functions.sweep import inside as _inside
from landsift.functions.sweep import length_within as _length_within
from landsift.functions.sweep import overlap as _overlap

PARTS = ST.ArrayType(ST.ArrayType(ST.DoubleType()))
GEOMETRY = ST.StructType(
    [ST.StructField("kind", ST.StringType()), ST.StructField("xs", PARTS), ST.StructField("ys", PARTS)]
)
# Smallest overlap that counts, in square metres, and tolerances in metres.
MINIMUM_OVERLAP = 0.01
COVER_TOLERANCE = 0.01
OUTLINE_BAND = 0.05

# ---------------------------------------------------------------- boxes (JVM)


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def box_overlap(a: str = "", b: str = "r_") -> Column:
    w = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    h = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_intersects(a: str = "", b: str = "r_") -> Column:
    return (
        (F.col(f"{a}x0") <= F.col(f"{b}x1"))
        & (F.col(f"{b}x0") <= F.col(f"{a}x1"))
        & (F.col(f"{a}y0") <= F.col(f"{b}y1"))
        & (F.col(f"{b}y0") <= F.col(f"{a}y1"))
    )


def box_distance(a: str = "", b: str = "r_") -> Column:
    """Also the distance to an axis-parallel line, which is a box without width."""
    dx = F.greatest(F.lit(0.0), F.col(f"{b}x0") - F.col(f"{a}x1"), F.col(f"{a}x0") - F.col(f"{b}x1"))
    dy = F.greatest(F.lit(0.0), F.col(f"{b}y0") - F.col(f"{a}y1"), F.col(f"{a}y0") - F.col(f"{b}y1"))
    return F.sqrt(dx * dx + dy * dy)


def box_covers(a: str = "r_", b: str = "", tolerance: float = COVER_TOLERANCE) -> Column:
    """Does box a, grown by the tolerance, hold box b?

    The corners of a grown box are round, so a corner of b outside both ways must
    lie within the tolerance of the corner of a."""
    left = F.greatest(F.lit(0.0), F.col(f"{a}x0") - F.col(f"{b}x0"))
    right = F.greatest(F.lit(0.0), F.col(f"{b}x1") - F.col(f"{a}x1"))
    low = F.greatest(F.lit(0.0), F.col(f"{a}y0") - F.col(f"{b}y0"))
    high = F.greatest(F.lit(0.0), F.col(f"{b}y1") - F.col(f"{a}y1"))
    dx, dy = F.greatest(left, right), F.greatest(low, high)
    corner = F.greatest(
        left * left + low * low, left * left + high * high, right * right + low * low, right * right + high * high
    )
    return (dx <= tolerance) & (dy <= tolerance) & (corner <= tolerance * tolerance)


def map_window(ratio: float, minimum_width: float = 0.0, p: str = "") -> dict[str, Column]:
    """Map window around a box: padding, then fitted to the aspect ratio."""
    # Padding of at least 18 m and 18 %.
    width = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(1.0))
    height = F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(1.0))
    padding = F.greatest(F.lit(18.0), F.greatest(width, height) * 0.18)
    wide, high = width + 2 * padding, height + 2 * padding
    narrow = wide / high < ratio
    fit_w = F.when(narrow, high * ratio).otherwise(wide)
    fit_h = F.when(narrow, high).otherwise(wide / ratio)
    factor = F.greatest(F.lit(1.0), F.lit(float(minimum_width)) / fit_w)
    cx = (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2
    cy = (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2
    half_w, half_h = fit_w * factor / 2, fit_h * factor / 2
    return {"wx0": cx - half_w, "wy0": cy - half_h, "wx1": cx + half_w, "wy1": cy + half_h}


# ------------------------------------------------- any geometry, single column (JVM)


def bbox(geom: Column) -> dict[str, Column]:
    xs, ys = F.flatten(geom["xs"]), F.flatten(geom["ys"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def _part_sum(geom: Column, term) -> Column:
    """Sum over all parts of the sum of term(x, y, next x, next y) over consecutive points."""

    def part(xs, ys):
        n = F.size(xs)
        steps = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
        values = F.transform(
            steps, lambda i: F.when(n > 1, term(xs[i], ys[i], F.get(xs, i + 1), F.get(ys, i + 1))).otherwise(0.0)
        )
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    parts = F.zip_with(geom["xs"], geom["ys"], part)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def area(geom: Column) -> Column:
    """Signed shoelace sum; rings are closed. Shifted to the first point for precision."""
    ox, oy = geom["xs"][0][0], geom["ys"][0][0]
    double = _part_sum(geom, lambda x, y, nx, ny: (x - ox) * (ny - oy) - (nx - ox) * (y - oy))
    return F.when(geom["kind"] == "polygon", double / 2).otherwise(0.0)


def length(geom: Column) -> Column:
    return _part_sum(geom, lambda x, y, nx, ny: F.sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))


def box_geometry(p: str = "") -> Column:
    x0, y0, x1, y1 = (F.col(p + c) for c in ("x0", "y0", "x1", "y1"))
    return F.struct(
        F.lit("polygon").alias("kind"),
        F.array(F.array(x0, x1, x1, x0, x0)).alias("xs"),
        F.array(F.array(y0, y0, y1, y1, y0)).alias("ys"),
    )


def segment_geometry(p: str = "") -> Column:
    return F.struct(
        F.lit("line").alias("kind"),
        F.array(F.array(F.col(f"{p}x0"), F.col(f"{p}x1"))).alias("xs"),
        F.array(F.array(F.col(f"{p}y0"), F.col(f"{p}y1"))).alias("ys"),
    )


def to_wkt(geom: Column) -> Column:
    """Polygon text with three decimals; a counter-clockwise ring opens a polygon."""

    def ring(xs, ys):
        points = F.zip_with(xs, ys, lambda x, y: F.format_string("%.3f %.3f", x, y))
        return F.concat(F.lit("("), F.array_join(points, ","), F.lit(")"))

    def ring_sign(xs, ys):
        steps = F.sequence(F.lit(0), F.size(xs) - 2)
        terms = F.transform(steps, lambda i: xs[i] * ys[i + 1] - xs[i + 1] * ys[i])
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    rings = F.zip_with(geom["xs"], geom["ys"], ring)
    outer = F.zip_with(geom["xs"], geom["ys"], lambda x, y: ring_sign(x, y) > 0)
    polygons = F.size(F.filter(outer, lambda o: o))
    inner = F.array_join(
        F.transform(
            rings,
            lambda r, i: F.when(i == 0, r)
            .when(outer[i], F.concat(F.lit("),("), r))
            .otherwise(F.concat(F.lit(","), r)),
        ),
        "",
    )
    return F.when(polygons > 1, F.concat(F.lit("MULTIPOLYGON(("), inner, F.lit("))"))).otherwise(
        F.concat(F.lit("POLYGON("), inner, F.lit(")"))
    )


def valid_geometry(df: DataFrame, column: str = "geom") -> DataFrame:
    """Rows whose geometry exists, has points and, for lines, a length."""
    g = F.col(column)
    return df.filter(
        g.isNotNull()
        & (F.size(F.flatten(g["xs"])) > 0)
        & ((g["kind"] != "line") | (length(g) > 0))
        & ((g["kind"] != "polygon") | (F.abs(area(g)) > 0))
    )


# -------------------------------------------------------- kernels (Arrow batches)


def _edges(xs, ys) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all parts; a single point becomes an edge without length."""
    rows = []
    for px, py in zip(xs, ys):
        p = np.column_stack([np.asarray(px, dtype=float), np.asarray(py, dtype=float)])
        q = p[1:] if len(p) > 1 else p
        rows.append(np.hstack([p[: len(q)], q]))
    return np.concatenate(rows) if rows else np.zeros((0, 4))


def _shapes(column: pa.StructArray) -> tuple[Shapes, np.ndarray]:
    """Shapes of a column and which rows are readable; the others have no edges."""
    kind, xs, ys = (pc.struct_field(column, [f]) for f in ("kind", "xs", "ys"))
    n_x, n_y = (pc.list_value_length(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (xs, ys))
    sound = (n_x == n_y) & (n_x >= 0)
    xs, ys = (pc.if_else(pa.array(sound), c, pa.scalar([], c.type)) for c in (xs, ys))
    px, py = xs.flatten(), ys.flatten()
    row = np.repeat(np.arange(len(column)), np.where(sound, n_x, 0))
    n_x, n_y = (pc.list_value_length(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (px, py))
    odd = (n_x != n_y) | (n_x < 0)
    if odd.any():  # a part without a partner: its row is read one by one
        sound[row[odd]] = False
        kept = sound[row]
        px, py, row, n_x = px.filter(pa.array(kept)), py.filter(pa.array(kept)), row[kept], n_x[kept]
    x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (px, py))
    last = np.zeros(len(x), bool)
    last[(np.cumsum(n_x) - 1)[n_x > 0]] = True
    length = np.repeat(n_x, n_x)
    start = np.flatnonzero(~last | (length == 1))
    end = np.where(length[start] == 1, start, start + 1)
    edges = np.column_stack([x[start], y[start], x[end], y[end]])
    rows = np.repeat(row, n_x)[start]
    sound[rows[~np.isfinite(edges).all(axis=1)]] = False
    polygon = pc.fill_null(pc.equal(kind, "polygon"), False).to_numpy(zero_copy_only=False)
    return Shapes(edges, np.bincount(rows, minlength=len(column)), polygon), sound


def _pairwise(kernel, fn, kind: type):
    """Arrow UDF body over two geometry columns: small shapes all at once by ``kernel``, the
    others one by one by ``fn``; an unreadable geometry gives null."""

    def one(p, q):
        try:
            return fn(p["kind"], _edges(p["xs"], p["ys"]), q["kind"], _edges(q["xs"], q["ys"]))
        except (TypeError, ValueError, IndexError):
            return None

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (p, p_sound), (q, q_sound) = _shapes(a), _shapes(b)
        fit = small(p, q) & p_sound & q_sound
        out = np.empty(len(a), object)
        if fit.any():
            out[fit] = by_slabs(kernel, p.take(fit), q.take(fit)).tolist()
        for i in np.flatnonzero(~fit):
            out[i] = one(a[i].as_py(), b[i].as_py())
        return pa.array([None if v is None else kind(v) for v in out], pa.bool_() if kind is bool else pa.float64())

    return run


def overlap_area(a: Column, b: Column) -> Column:
    return F.arrow_udf(_pairwise(pairs.overlap, lambda ka, ea, kb, eb: _overlap(ea, eb), float), "double")(a, b)


def distance(a: Column, b: Column) -> Column:
    return F.arrow_udf(_pairwise(pairs.distance, _distance, float), "double")(a, b)


def intersects(a: Column, b: Column) -> Column:
    return distance(a, b) <= 0.0


def covers(a: Column, b: Column, tolerance: float = COVER_TOLERANCE) -> Column:
    def kernel(p, q):
        return pairs.covers(p, q, tolerance)

    return F.arrow_udf(_pairwise(kernel, lambda ka, ea, kb, eb: _covers(ea, eb, tolerance), bool), "boolean")(a, b)


def length_within(line: Column, outline: Column, band: float = OUTLINE_BAND) -> Column:
    def kernel(p, q):
        return pairs.length_within(p, q, band)

    return F.arrow_udf(_pairwise(kernel, lambda ka, ea, kb, eb: _length_within(ea, eb, band), float), "double")(line, outline)


def point_in_polygon(x: Column, y: Column, geom: Column) -> Column:
    """Even-odd test."""

    def run(px: pa.Array, py: pa.Array, g: pa.Array) -> pa.Array:
        shapes, sound = _shapes(g)
        at_x, at_y = (c.to_numpy(zero_copy_only=False).astype(float) for c in (px, py))
        fit = sound & (shapes.counts <= FEW)
        out = np.zeros(len(g), bool)
        if fit.any():
            held = shapes.take(fit)
            points = Shapes(np.column_stack([at_x[fit], at_y[fit]]), np.ones(len(held), np.int64), held.polygon)
            out[fit] = by_slabs(lambda p, q: pairs.inside(p.edges[:, 0], p.edges[:, 1], q), points, held)
        for i in np.flatnonzero(~fit):
            shape = g[i].as_py()
            out[i] = _inside(at_x[i : i + 1], at_y[i : i + 1], _edges(shape["xs"], shape["ys"]))[0]
        return pa.array(out)

    return F.arrow_udf(run, "boolean")(x, y, geom)


def _orient(xs, ys):
    """Rings of at least four points, directed by how many other rings hold them."""
    rings = [(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys) if len(x) >= 4]
    edges = [_edges([x], [y]) for x, y in rings]
    out_x, out_y, clean = [], [], True
    for i, (x, y) in enumerate(rings):
        depth = 0
        clean &= not _crossing(edges[i], edges[i])
        for j, other in enumerate(edges):
            if i == j or not clean:
                continue
            mid_x, mid_y = (x[1:] + x[:-1]) / 2, (y[1:] + y[:-1]) / 2
            inside = _inside(mid_x, mid_y, other)
            depth += int(inside.mean() > 0.5)
            clean &= not _crossing(edges[i], other)
        turn = float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())
        if (turn > 0) != (depth % 2 == 0):
            x, y = x[::-1], y[::-1]
        out_x.append(x.tolist())
        out_y.append(y.tolist())
    if not clean:  # rings that cross themselves or each other: their even-odd overlay
        found = even_odd(np.concatenate(edges))
        out_x, out_y = [r[:, 0].tolist() for r in found], [r[:, 1].tolist() for r in found]
    return out_x, out_y, clean


def orient_rings(geom: Column) -> Column:
    """Even-odd rings as signed rings; ``clean`` is false where rings crossed themselves or
    each other and were overlaid."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, xs, ys in zip(g["kind"], g["xs"], g["ys"]):
            if kind is None or xs is None:
                rows.append((None, None, None, False))
            elif kind != "polygon":
                rows.append((kind, [list(x) for x in xs], [list(y) for y in ys], True))
            else:
                rows.append((kind, *_orient(xs, ys)))
        return pd.DataFrame(rows, columns=["kind", "xs", "ys", "clean"])

    schema = ST.StructType([*GEOMETRY.fields, ST.StructField("clean", ST.BooleanType())])
    return F.pandas_udf(run, schema)(geom)
