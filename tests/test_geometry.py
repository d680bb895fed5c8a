"""Kernels against known answers and against each other."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landsift.functions import geometry as G

SQUARE = ([[0, 10, 10, 0, 0]], [[0, 0, 10, 10, 0]])
# a square with a square hole (clockwise)
FRAME = ([[0, 10, 10, 0, 0], [4, 4, 6, 6, 4]], [[0, 0, 10, 10, 0], [4, 6, 6, 4, 4]])
# an L
ELL = ([[0, 10, 10, 4, 4, 0, 0]], [[0, 0, 4, 4, 10, 10, 0]])


def edges(shape):
    return G._edges(*shape)


def box(x0, y0, x1, y1):
    return ([[x0, x1, x1, x0, x0]], [[y0, y0, y1, y1, y0]])


def test_overlap_of_known_shapes():
    assert G._overlap(edges(SQUARE), edges(SQUARE)) == pytest.approx(100)
    assert G._overlap(edges(FRAME), edges(SQUARE)) == pytest.approx(96)
    assert G._overlap(edges(FRAME), edges(box(4, 4, 6, 6))) == pytest.approx(0)
    assert G._overlap(edges(ELL), edges(box(3, 3, 20, 20))) == pytest.approx(1 * 7 + 6 * 1)
    assert G._overlap(edges(SQUARE), edges(box(10, 0, 20, 10))) == pytest.approx(0)


coordinate = st.integers(0, 40)


def star(rng_radii, cx, cy):
    """A star-shaped polygon, counter-clockwise."""
    n = len(rng_radii)
    angles = np.linspace(0, 2 * math.pi, n, endpoint=False)
    xs = [cx + r * math.cos(a) for r, a in zip(rng_radii, angles)]
    ys = [cy + r * math.sin(a) for r, a in zip(rng_radii, angles)]
    return ([xs + xs[:1]], [ys + ys[:1]])


radii = st.lists(st.floats(1, 20), min_size=3, max_size=9)


@given(radii, radii, coordinate, coordinate)
@settings(max_examples=60, deadline=None)
def test_overlap_is_symmetric_and_bounded(a, b, x, y):
    p, q = edges(star(a, 0, 0)), edges(star(b, x, y))
    one, two = G._overlap(p, q), G._overlap(q, p)
    assert one == pytest.approx(two, abs=1e-6)
    assert -1e-6 <= one <= min(G._overlap(p, p), G._overlap(q, q)) + 1e-6


@given(radii, radii, coordinate, coordinate)
@settings(max_examples=40, deadline=None)
def test_overlap_against_tiling(a, b, x, y):
    """Parts cut by a vertical line add up to the whole."""
    p, q = edges(star(a, 0, 0)), edges(star(b, x, y))
    whole = G._overlap(p, q)
    left, right = edges(box(-100, -100, 3.3, 100)), edges(box(3.3, -100, 100, 100))
    assert G._overlap(p, left) + G._overlap(p, right) == pytest.approx(G._overlap(p, p), rel=1e-9)
    if whole > 1e-6:
        assert G._distance("polygon", p, "polygon", q) == 0


def test_distance():
    line = edges(([[12, 12]], [[-5, 5]]))
    assert G._distance("polygon", edges(SQUARE), "line", line) == pytest.approx(2)
    inside = edges(([[2, 3]], [[2, 3]]))
    assert G._distance("polygon", edges(SQUARE), "line", inside) == 0
    in_hole = edges(([[5, 5]], [[4.5, 5]]))
    assert G._distance("polygon", edges(FRAME), "line", in_hole) == pytest.approx(0.5)


def test_covers_with_tolerance():
    big = edges(box(0, 0, 10, 10))
    assert G._covers(big, edges(box(2, 2, 5, 5)), 0.01)
    assert G._covers(big, edges(box(-0.005, 2, 5, 5)), 0.01)
    assert not G._covers(big, edges(box(-0.5, 2, 5, 5)), 0.01)
    assert not G._covers(edges(FRAME), edges(box(3, 3, 7, 7)), 0.01)


def test_length_within_band():
    outline = edges(box(0, 0, 10, 10))
    assert G._length_within(edges(([[0, 10]], [[0.0, 0.0]])), outline, 0.05) == pytest.approx(10)
    assert G._length_within(edges(([[2, 8]], [[0.2, 0.2]])), outline, 0.05) == pytest.approx(0)
    assert G._length_within(edges(([[-5, 5]], [[0.0, 0.0]])), outline, 0.05) == pytest.approx(5.05)


def test_rings_are_directed_by_depth():
    xs, ys, clean = G._orient([[0, 0, 10, 10, 0], [2, 8, 8, 2, 2]], [[0, 10, 10, 0, 0], [2, 2, 8, 8, 2]])
    assert clean
    assert G._overlap(G._edges(xs, ys), edges(SQUARE)) == pytest.approx(100 - 36)
    assert not G._orient([[0, 10, 10, 0, 0], [5, 15, 15, 5, 5]], [[0, 0, 10, 10, 0], [5, 5, 15, 15, 5]])[2]
