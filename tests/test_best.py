"""Best right box of each left box and group, without all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from landsift.operators import planning as P
from landsift.operators import spatial_join as S
from tests.test_spatial import KEY, zone


def placed(spark, rng, n, side, small):
    rows = []
    for i in range(n):
        x, y = rng.uniform(-side, side), rng.uniform(-side, side)
        rows.append((i, x, y, x + rng.uniform(0, small) ** 2, y + rng.uniform(0, small)))
    return rows, spark.createDataFrame(rows, "a int, x0 double, y0 double, x1 double, y1 double")


def ranked(spark, rng, n, side, wide):
    """Boxes on a grid of few corners, so that many share edges, and some anywhere; ranks repeat and may be null."""
    rows = []
    for i in range(n):
        at = (lambda: rng.choice([-200.0, -64.0, 0.0, 128.0, 500.0])) if i % 3 else (lambda: rng.uniform(-side, side))
        x, y, big = at(), at(), wide * rng.choice([0.02, 0.3, 1.0, 4.0])
        rank = None if i % 17 == 0 else rng.randrange(n)
        rows.append((i, rng.choice([None, "p", "q"]), rank, x, y, x + rng.choice([big, 256.0]), y + rng.choice([big, 64.0])))
    return rows, spark.createDataFrame(rows, "b int, g string, rank int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("seed", range(3))
def test_the_best_of_every_group_is_among_the_pairs(spark, seed):
    rng = random.Random(seed)
    left, l = placed(spark, rng, 250, 700, 8 + 6 * seed)
    right, r = ranked(spark, rng, 500, 700, 400)
    order = F.struct(F.col("rank").isNull(), "rank")
    pairs = S.best_join(l, r, ["g"], order).collect()
    assert pairs and len(pairs) == len({(p.a, p.b) for p in pairs})
    key = {b: ((k is None, k or 0), g) for b, g, k, *_ in right}
    for least in (None, 0.01, 30.0):
        want, got = {}, {}
        for a, ax0, ay0, ax1, ay1 in left:
            for b, g, _, bx0, by0, bx1, by1 in right:
                w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
                if w >= 0 and h >= 0 and (least is None or w * h > least):
                    want[a, g] = min(want.get((a, g), key[b][0]), key[b][0])
        for p in pairs:
            w, h = min(p.x1, p.r_x1) - max(p.x0, p.r_x0), min(p.y1, p.r_y1) - max(p.y0, p.r_y0)
            assert w >= 0 and h >= 0
            if least is None or w * h > least:
                got[p.a, p.g] = min(got.get((p.a, p.g), key[p.b][0]), key[p.b][0])
        assert got == want and want


def test_pairs_do_not_grow_with_boxes_that_lie_on_each_other(spark):
    """Zones of one key around one place, each with its own outline: few of them are ever first."""
    parcels = spark.range(200).select(
        F.lit(1).alias("ko_id"), F.col("id").cast("string").alias("parcel_number"),
        *[(F.col("id") * 2.0 + d).alias(c) for c, d in (("x0", 0.0), ("y0", 0.0), ("x1", 9.0), ("y1", 9.0))],
    )
    met = []
    for n in (300, 3000):
        rng = random.Random(8)
        rows = [
            (i, 7, "OPN", "SS", None, "A1", None, *[-rng.uniform(1, 600) for _ in "xy"], *[rng.uniform(100, 900) for _ in "xy"])
            for i in range(n)
        ]
        z = zone(spark, rows)
        first = F.struct(F.col("ord").isNull(), "ord")
        met.append(P.best_shape_join(parcels, z, P.CONTEXT_KEY, first).count())
        got = {r.parcel_number: r.ord for r in P.planning_context(parcels, z).collect()}
        want = {}
        for p in range(200):
            for i, *_, x0, y0, x1, y1 in rows:
                w, h = min(2.0 * p + 9, x1) - max(2.0 * p, x0), min(2.0 * p + 9, y1) - max(2.0 * p, y0)
                if w > 0 and h > 0 and w * h > 0.01:
                    want[str(p)] = min(want.get(str(p), n), i)
        assert got == want
    assert met[1] < 2 * met[0] and met[1] < 20 * 200


def test_the_first_zone_of_a_centre_without_all_pairs(spark):
    zones = spark.range(4000).select(
        F.lit("Kranj").alias("municipality"), (F.lit(4000) - F.col("id")).alias("ord"),
        F.when(F.col("id") < 3990, F.concat(F.lit("z"), 4000 - F.col("id"))).alias("zone_label"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 7 * 100 + 100.0).alias("x1"), F.lit(500.0).alias("y1"),
    )
    parcels = spark.createDataFrame(
        [(1, "1", " kranj", 20.0, 20.0, 40.0, 40.0), (1, "2", "Kranj", 640.0, 20.0, 650.0, 40.0), (1, "3", "Bled", 20.0, 20.0, 40.0, 40.0)],
        KEY + ", municipality string, x0 double, y0 double, x1 double, y1 double",
    )
    got = {r.parcel_number: r.zone_label for r in P.zone_of_centre(parcels, zones).collect()}
    want = {"1": 4000 - 3989, "2": min(4000 - i for i in range(3990) if i % 7 == 6)}
    assert got == {k: f"Z{v}" for k, v in want.items()}
