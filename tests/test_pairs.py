import numpy as np
import pytest
from pyspark.sql import functions as F

from landsift.functions import geometry as G
from landsift.functions import pairs as P
from landsift.functions import sweep as S


def shapes(parts, polygon=True):
    return P.Shapes(np.concatenate(parts), np.array([len(p) for p in parts]), np.full(len(parts), polygon))


def star(rng, n, cx, cy):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(2, 20, n)
    x, y = np.round(cx + far * np.cos(turn), 1), np.round(cy + far * np.sin(turn), 1)
    return G._edges([[*x, x[0]]], [[*y, y[0]]])


def test_many_pairs_at_once_give_what_each_gives_alone(monkeypatch):
    monkeypatch.setattr(P, "SLAB", 700)
    rng = np.random.default_rng(3)
    a = [star(rng, rng.integers(3, 12), *rng.uniform(0, 40, 2)) for _ in range(300)]
    b = [star(rng, rng.integers(3, 12), *rng.uniform(0, 40, 2)) for _ in range(300)]
    b[:50] = [np.vstack([e * 0.3 + 0.7 * np.tile(e[:, :2].mean(axis=0), 2)]) for e in a[:50]]
    b[50:60] = a[50:60]
    p, q = shapes(a), shapes(b)
    assert P.by_slabs(P.overlap, p, q) == pytest.approx([S.overlap(x, y) for x, y in zip(a, b)])
    assert P.by_slabs(P.distance, p, q).tolist() == [S.distance("polygon", x, "polygon", y) for x, y in zip(a, b)]
    line, flat = shapes(a, False), [S.distance("line", x, "polygon", y) for x, y in zip(a, b)]
    assert P.by_slabs(P.distance, line, q).tolist() == flat
    held = [S.covers(x, y, 0.01) for x, y in zip(a, b)]
    assert P.by_slabs(lambda x, y: P.covers(x, y, 0.01), p, q).tolist() == held and 0 < sum(held) < 300
    within = [S.length_within(x, y, 0.5) for x, y in zip(a, b)]
    assert P.by_slabs(lambda x, y: P.length_within(x, y, 0.5), p, q) == pytest.approx(within) and max(within) > 0


def test_unreadable_shapes_give_null_and_large_ones_are_swept(spark):
    turn = np.linspace(0, 2 * np.pi, 800).tolist()
    ring = ([np.cos(turn).tolist()], [np.sin(turn).tolist()])
    box = ([[0.0, 2.0, 2.0, 0.0, 0.0]], [[0.0, 0.0, 2.0, 2.0, 0.0]])
    rows = [(1, ("polygon", *box)), (2, None), (3, ("polygon", [[0.0, 1.0]], [[0.0]])), (4, ("polygon", *ring)), (5, ("polygon", None, None))]
    df = spark.createDataFrame(rows, f"k int, g {G.GEOMETRY.simpleString()}").crossJoin(
        spark.createDataFrame([(("polygon", *ring),), (("polygon", *box),)], f"h {G.GEOMETRY.simpleString()}")
    )
    found = df.select("k", F.size(F.flatten("h.xs")).alias("n"), G.overlap_area(F.col("g"), F.col("h")).alias("o"), G.covers(F.col("g"), F.col("h")).alias("c")).collect()
    o = {(r.k, r.n): r.o for r in found}
    assert o[1, 5] == pytest.approx(4) and o[1, 800] == pytest.approx(np.pi / 4, abs=1e-3) and o[4, 800] == pytest.approx(np.pi, abs=1e-3)
    assert all(o[k, n] is None for k in (2, 3, 5) for n in (5, 800))
    assert {(r.k, r.n) for r in found if r.c} == {(1, 5), (4, 800)}
