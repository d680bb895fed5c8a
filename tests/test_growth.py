"""Work that must not grow with copies, batches or rows that cannot matter."""

import io
import random
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from landsift.functions import phrases as PH
from landsift.operators import constraints as C
from landsift.operators import documents as D
from landsift.operators import maps as M
from landsift.operators import networks as N
from landsift.session import spread
from landsift.sources import archives as A
from tests.test_spatial import KEY

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_copies_of_a_sheet_are_met_once_and_all_come_back(spark, monkeypatch):
    parcels = spark.createDataFrame([(1, "1", 0.0, 0.0, 1e-4, 1e-4), (1, "2", 1.0, 1.0, 1.1, 1.1)], f"{KEY}, {BOX}")
    sheets = spark.createDataFrame([(5, 2, 0.0, 0.0, 0.5, 0.5)] * 40 + [(5, None, 0.0, 0.0, 0.5, 0.5)] * 3, f"doc_id bigint, page int, {BOX}")
    mentions = spark.createDataFrame([(1, "1", 5, 2), (1, "2", 5, 2), (1, "1", 5, 0)], f"{KEY}, doc_id bigint, page int")
    met, join = [], M.shape_join
    monkeypatch.setattr(M, "shape_join", lambda p, s, **k: met.append(s.count()) or join(p, s, **k))
    got = M.map_sheet_matches(parcels, sheets, mentions).groupBy("parcel_number", "page", "match_method").count().collect()
    assert {tuple(r) for r in got} == {("1", 2, "geospatial", 40), ("1", None, "geospatial", 3), ("2", 2, "parcel_label", 1)}
    assert met == [2]


def test_unmatched_objects_meet_recorded_lines_only(spark, monkeypatch):
    rng = random.Random(3)
    parcels = spark.createDataFrame([(1, str(i), *[v for v in (i * 30.0, 0.0, i * 30.0 + 20, 20.0)]) for i in range(12)], f"{KEY}, {BOX}")
    fields = "theme_code string, theme_name string, kind string, attribute1 string, attribute2 string"
    about = lambda: (rng.choice(["1100", "2100", "3100"]), None, "vod", rng.choice([None, "nadzemni vod"]), rng.choice(["0,4 kV", "400 kV"]))
    lines = []
    for i in range(300):
        x, y = rng.uniform(-150, 500), rng.uniform(-150, 150)
        lines.append((i, rng.choice([None, f"L{i % 40}"]), *about(), x, y, x + 30, y))
    lines = spark.createDataFrame(lines, f"ord bigint, line_eid string, {fields}, {BOX}")
    direct = [(1, str(rng.randrange(14)), 0, i, rng.choice([None, f"L{rng.randrange(60)}"]), *about()) for i in range(400)]
    direct = spark.createDataFrame(direct, f"{KEY}, relation int, ord bigint, object_eid string, {fields}")
    rest = N.band_candidates(parcels, lines, direct).filter("NOT drawn")
    want = sorted(map(str, rest.collect()))
    keys, join = [], N.shape_join
    monkeypatch.setattr(N, "shape_join", lambda p, s, on=(), **k: keys.append(list(on)) or join(p, s, on=on, **k))
    found = N.unmatched_objects(parcels, lines, direct)
    assert found.columns == rest.columns and sorted(map(str, found.collect())) == want and 0 < len(want) < 400
    assert keys == [["line_eid"]]


def test_findings_that_are_dropped_anyway_are_not_found(spark):
    features = spark.range(600).select(
        F.col("id").alias("ord"), F.lit("5660").alias("layer"),
        F.create_map(F.lit("IME"), F.concat(F.lit("ime "), F.col("id") % 3), F.lit("STATUS"), F.col("id").cast("string")).alias("props"),
        *[F.lit(v).alias(c) for c, v in (("x0", -50.0), ("y0", -50.0), ("x1", 500.0), ("y1", 500.0))],
    )
    parcels = spark.createDataFrame([(1, str(i), i * 3.0, 0.0, i * 3.0 + 8, 9.0) for i in range(20)], f"{KEY}, {BOX}")
    few = C.layer_findings(parcels, features, C.layer_specs(spark), to_dedupe=True)
    every = C.layer_findings(parcels, features, C.layer_specs(spark))
    assert every.count() == 12_000 and few.count() < 200
    assert sorted(map(str, C.dedupe_findings(few).collect())) == sorted(map(str, C.dedupe_findings(every).collect()))


def test_pages_are_python_objects_a_slice_at_a_time(spark):
    seen = []

    def told(rows):
        seen.append(len(rows))
        return pa.array([None if r is None else [r] for r in rows], pa.list_(pa.string()))

    pages = pa.array([None if i % 5 == 0 else f"p{i}" for i in range(1000)])
    out = PH.in_slices(told, pages, pa.list_(pa.string()))
    assert max(seen) <= PH.SLICE and sum(seen) == 1000
    assert out.to_pylist() == [None if i % 5 == 0 else [f"p{i}"] for i in range(1000)]
    assert PH.in_slices(told, pages[:0], pa.list_(pa.string())).to_pylist() == []
    texts = spark.createDataFrame([(i, None if i == 3 else f"parcela {i} / 2 in 7.") for i in range(400)], "i int, text string").coalesce(1)
    got = dict(texts.select("i", D.number_tokens(F.col("text")).alias("t")).collect())
    assert got.pop(3) is None and len(got) == 399
    assert all([tuple(t) for t in found] == D._page_numbers(f"parcela {i} / 2 in 7.") for i, found in got.items())


def test_rows_of_many_archives_go_out_together():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.pdf", b"x")
    batch = pd.DataFrame({"path": [str(i) for i in range(60)], "content": [buffer.getvalue() if i % 2 else b"no" for i in range(60)]})
    frames = list(A._expand(iter([batch, batch]), A.Limits()))
    assert len(frames) == 1 and len(frames[0]) == 120
    assert frames[0]["rejected_reason"].isna().sum() == 60


def test_a_table_of_one_file_is_spread_over_tasks(spark):
    df = spark.range(0, 1000, 1, 1)
    assert spread(df, 100).rdd.getNumPartitions() == 10 and spread(df.limit(0), 100).count() == 0
