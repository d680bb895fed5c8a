"""Box join against brute force, with and without crowded cells; general shapes."""

import random

from pyspark.sql import functions as F

from landsift.functions import geometry as G
from landsift.operators import networks as N
from landsift.operators import planning as P
from landsift.operators.spatial_join import box_join


def boxes(rng, n, largest):
    out = []
    for i in range(n):
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        out.append((i, x, y, x + rng.uniform(0, largest), y + rng.uniform(0, largest)))
    return out


def brute(a, b, m=0.0):
    return {
        (i, j)
        for i, x0, y0, x1, y1 in a
        for j, u0, v0, u1, v1 in b
        if x0 <= u1 + m and u0 - m <= x1 and y0 <= v1 + m and v0 - m <= y1
    }


def frames(spark, a, b):
    return (
        spark.createDataFrame(a, "i int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(b, "j int, x0 double, y0 double, x1 double, y1 double"),
    )


def test_box_join_is_brute_force(spark):
    rng = random.Random(5)
    a, b = boxes(rng, 150, 20), boxes(rng, 120, 3) + [(1000 + i, *r[1:]) for i, r in enumerate(boxes(rng, 30, 700))]
    # many boxes on one spot
    a += [(500 + i, 1.0, 1.0, 9.0, 9.0) for i in range(60)]
    b += [(5000 + i, 2.0, 2.0, 40.0, 40.0) for i in range(60)]
    left, right = frames(spark, a, b)
    for margin in (0.0, 35.0):
        want = brute(a, b, margin)
        for kwargs in ({}, {"smallest_cell": 1.0}, {"smallest_cell": 300.0}):
            got = [(r.i, r.j) for r in box_join(left, right, margin=margin, **kwargs).select("i", "j").collect()]
            assert len(got) == len(set(got))
            assert set(got) == want


def test_margin_per_row_and_missing_boxes(spark):
    a = [(1, 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0)]
    b = [(1, 3.0, 0.0, 4.0, 1.0), (2, 3.0, 0.0, 4.0, 1.0)]
    left, right = frames(spark, a, b)
    right = right.withColumn("reach", F.when(F.col("j") == 1, 2.0))
    got = {(r.i, r.j) for r in box_join(left, right, margin=F.col("reach")).collect()}
    assert got == {(1, 1)}


def test_sides_with_nothing(spark):
    left, right = frames(spark, [], [(1, 0.0, 0.0, 1.0, 1.0)])
    assert box_join(left, right).count() == 0
    assert box_join(right.withColumnRenamed("j", "i"), right.limit(0)).count() == 0


KEY = "ko_id bigint, parcel_number string"


def parcel(spark, x1=10.0, y1=10.0, **extra):
    df = spark.createDataFrame([(1723, "123/4", 0.0, 0.0, x1, y1)], KEY + ", x0 double, y0 double, x1 double, y1 double")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def zone(spark, rows):
    schema = "ord int, act_id bigint, act_title string, land_use_code string, land_use_description string, planning_unit string, subunit string, x0 double, y0 double, x1 double, y1 double"
    return spark.createDataFrame(rows, schema)


def test_half_is_fifty_percent_and_touching_is_not_overlap(spark):
    z = zone(spark, [
        (1, 7, "OPN", "SS", "Stanovanjske površine", "A1", None, 5.0, 0.0, 20.0, 10.0),
        (2, 7, "OPN", "K1", None, "A1", None, 10.0, 0.0, 20.0, 10.0),
        (3, 7, "OPN", "SS", "Stanovanjske površine", "A1", None, 0.0, 0.0, 5.0, 10.0),
    ])
    rows = P.planning_context(parcel(spark), z).collect()
    assert [(r.land_use_code, r.parcel_share_percent) for r in rows] == [("SS", 50.0)]
    rows = P.planning_context(parcel(spark), z, dedupe="sum").collect()
    assert [r.parcel_share_percent for r in rows] == [100.0]


def test_general_polygon_gives_the_same_share(spark):
    z = zone(spark, [(1, 7, "OPN", "SS", None, None, None, 5.0, 0.0, 20.0, 10.0)]).withColumn("geom", G.box_geometry())
    p = parcel(spark).withColumn("geom", G.box_geometry())
    assert P.planning_context(p, z).first().parcel_share_percent == 50.0


def test_shares_add_up_and_tone(spark):
    ctx = spark.createDataFrame(
        [(1723, "123/4", "G", None, 28.9), (1723, "123/4", "g", None, 21.1), (1723, "123/4", "SS", None, 50.0)],
        KEY + ", land_use_code string, land_use_description string, parcel_share_percent double",
    )
    p = parcel(spark, area_m2=2000)
    items = {r.code: r for r in P.land_use_shares(p, ctx).collect()}
    assert items["G"].share_percent == 50.0 and items["G"].parcel_area_m2 == 1000.0
    assert items["G"].tone == "concern" and items["SS"].tone == "positive"
    assert P.overall_tone(p, P.land_use_shares(p, ctx)).first().tone == "caution"
    none = P.overall_tone(p, P.land_use_shares(p, ctx.limit(0))).first()
    assert (none.tone, none.items) == ("unknown", 0)


def test_completed_act_wins(spark):
    schema = "ord int, procedure_id bigint, act_ref bigint, title string, act_type string, status string, page_url string, x0 double, y0 double, x1 double, y1 double"
    done = spark.createDataFrame([(1, 9, 1, "A", None, None, None, 0.0, 0.0, 5.0, 5.0), (2, 9, 1, "B", None, None, None, 0.0, 0.0, 5.0, 5.0)], schema)
    open_ = spark.createDataFrame([(1, 9, 1, "C", None, None, None, 0.0, 0.0, 5.0, 5.0), (2, 8, 1, None, None, None, None, 0.0, 0.0, 5.0, 5.0)], schema)
    acts = {r.procedure_id: r for r in P.find_acts(parcel(spark), done, open_).collect()}
    assert acts[9].title == "B" and acts[9].preparation_state == "completed"
    assert acts[8].title == "PIS act 8"


def test_bands_and_direct_objects(spark):
    lines = spark.createDataFrame(
        [
            (1, "L1", "2100", None, "vod", "podzemni kablovod", "0,4 kV", 5.0, -5.0, 5.0, 15.0),
            (2, "L2", "6100", None, None, None, None, 12.0, 0.0, 12.0, 10.0),
            (3, "L3", "1100", None, None, "regionalna cesta", None, 24.0, 0.0, 24.0, 10.0),
            (4, "L4", "3100", None, None, None, None, 30.0, 0.0, 30.0, 10.0),
        ],
        "ord bigint, line_eid string, theme_code string, theme_name string, kind string, attribute1 string, attribute2 string, x0 double, y0 double, x1 double, y1 double",
    )
    direct = spark.createDataFrame(
        [(1723, "123/4", 0, 1, "L4", "3100", None, None, None, None), (1723, "123/4", 2, 2, None, "3200", None, "jašek", None, None)],
        KEY + ", relation int, ord bigint, object_eid string, theme_code string, theme_name string, kind string, attribute1 string, attribute2 string",
    )
    found = {r.name: r for r in N.protection_bands(parcel(spark), lines, direct).collect()}
    assert found["Podzemni kabelski vod 0,4 kV"].distance_m == 0
    assert "širina pasu: 1 m" in found["Podzemni kabelski vod 0,4 kV"].detail
    assert found["Regionalna cesta"].distance_m == 14.0
    telecom = [r for n, r in found.items() if n.startswith("Elektronske")][0]
    assert telecom.distance_m == 2.0 and telecom.reference == "EID GJI L2"
    water = [r for n, r in found.items() if n.startswith("Vodovod")][0]
    assert water.distance_m == 20.0 and water.reference == "EID GJI L4"
    assert found["Kanalizacija – jašek"].reference is None


def test_absent_source_is_not_no(spark):
    p = parcel(spark)
    lines = spark.createDataFrame([("water", 12.0, 0.0, 12.0, 10.0)], "network string, x0 double, y0 double, x1 double, y1 double")
    direct = spark.createDataFrame([], KEY + ", relation int, ord bigint, theme_code string, theme_name string, kind string")
    status = spark.createDataFrame([("water", True), ("sewer", True), ("gas", False)], "network string, loaded boolean")
    got = {r.network: r for r in N.infrastructure_status(N.nearest_line(p, lines), direct, status).collect()}
    assert got["water"].status == "nearby" and got["water"].label.endswith("2 m")
    assert got["sewer"].status == "not_recorded"
    assert got["gas"].status == "unavailable" and got["telecom"].status == "unavailable"


def test_cells_of_degrees_follow_the_boxes(spark):
    from landsift.operators import spatial_join as S

    # boxes of 20 m spread over 2 x 1 degrees: few of them may share a cell
    rows = [(i, 14 + (i * 37 % 1000) * 0.002, 45 + (i * 91 % 1000) * 0.001) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, x double, y double").selectExpr("i", "x AS x0", "y AS y0", "x + 0.0002 AS x1", "y + 0.0002 AS y1")
    level = S._with_level(df, None, S.DEGREE_CELL)
    most = S._cells(level, [1], S.DEGREE_CELL).groupBy("_cell").count().agg({"count": "max"}).first()[0]
    assert most <= 4
    assert box_join(df, df.withColumnRenamed("i", "j"), smallest_cell=S.DEGREE_CELL).filter("i = j").count() == 1000


def test_one_crowded_cell_keeps_all_pairs(spark):
    box = lambda name, n: spark.range(n).selectExpr(f"id AS {name}", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    assert box_join(box("i", 300), box("j", 200)).count() == 60_000
