"""Request log, usage, streams, exports and text functions on known rows."""

import datetime as dt
import glob
import zipfile

from pyspark.sql import functions as F

from landsift.functions import agent as A
from landsift.functions import text as T
from landsift.operators import history as H
from landsift.operators import parcels as PA
from landsift.operators import traffic as R
from landsift.operators import usage as U
from landsift.sources import archives as AR
from landsift.sources import exports as E
from landsift.sources import features as FE
from landsift.streaming import streams as S

NOW = dt.datetime(2026, 7, 1, 12)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, " 1723   123 / 4 ", T.parse_parcel_reference) == (1723, "123/4")
    assert one(spark, "17234 1", T.parse_parcel_reference) is None
    assert one(spark, "1 / 6", T.share_percent) == 16.67
    assert one(spark, "1/0", T.share_percent) is None and one(spark, "x", T.share_percent) is None
    assert one(spark, "0.5", T.share_percent) == 50.0
    assert one(spark, "2021-03-09T00:00Z", T.format_record_date) == "9. 3. 2021"
    assert one(spark, "  Žabja  STRAẞE ß", T.fold) == "zabja strasse ss"
    assert one(spark, " None ", T.clean_value) is None and one(spark, "5.0", T.clean_value) == "5"
    a, b = (one(spark, v, T.cache_key) for v in ("2057   314/4", " 2057 314/4 "))
    assert a == b and len(a) == 64
    assert one(spark, "api_key=abc sk-proj-aaaaaaaaaaaaaaa password: x1", T.redact) == "api_key=<redacted> sk-<redacted> password: <redacted>"
    assert one(spark, "2001:0db8:0000::0001", A.normalise_ip) == "2001:db8::1"
    assert one(spark, " 192.0.2.1 ", A.normalise_ip) == "192.0.2.1"
    assert one(spark, "", A.normalise_ip) == "unknown"
    assert one(spark, "https://Example.ORG:8/p?q", A.referer_host) == "example.org"
    iphone = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1"
    assert [one(spark, iphone, f) for f in (A.device_type, A.browser_family, A.os_family)] == ["mobile", "Safari", "iOS"]


def test_valuation_keeps_null_apart_from_zero(spark):
    p = spark.createDataFrame([(1, "1", "a"), (1, "2", "b"), (1, "3", "c")], "ko_id bigint, parcel_number string, eid string")
    u = spark.createDataFrame([("a", 3000), ("a", 700), ("b", None)], "eid string, value_eur bigint")
    got = {r.eid: (r.unit_count, r.official_valuation_eur) for r in PA.with_valuation(p, u).collect()}
    assert got == {"a": (2, 3700), "b": (1, None), "c": (0, None)}


def test_ownership(spark):
    r = spark.createDataFrame(
        [("e", 1, "1/4", "x", [("***",)]), ("e", 2, "3/4", "x", [("Občina  Bled",)])],
        "eid string, ord int, fraction string, right_status string, holders array<struct<name:string>>",
    )
    shares = PA.ownership(r)
    labels = [v.owner_label for v in shares.orderBy("ord").collect()]
    assert labels == ["Fizična oseba 1 (ime ni javno)", "Občina Bled"]
    p = spark.createDataFrame([(1, "1", "e"), (1, "2", "f"), (1, "3", "")], "ko_id bigint, parcel_number string, eid string")
    got = {v.eid: v for v in PA.ownership_totals(p, shares).collect()}
    assert (got["e"].private_share_percent, got["e"].publicly_named_share_percent, got["e"].total_share_percent) == (25.0, 75.0, 100.0)
    assert got["e"].label == "2 javna lastniška zapisa"
    assert got["f"].status == "not_found" and got[""].status == "unavailable"


def test_boundary_of_a_triangle(spark):
    p = spark.createDataFrame([(1, "1", "ni urejena", 1.0, 1.0, 2.0, 2.0)], "ko_id bigint, parcel_number string, administrative_status string, x0 double, y0 double, x1 double, y1 double")
    p = p.withColumn("geom", F.expr("named_struct('kind', 'polygon', 'xs', array(array(1d,2d,2d,1d)), 'ys', array(array(1d,1d,2d,1d)))"))
    sides = [(1, "a", 1.0, 1.0, 2.0, 1.0), (2, "b", 2.0, 1.0, 2.0, 2.0), (3, "c", 1.0, 1.0, 2.0, 2.0)]
    s = spark.createDataFrame([(o, i, "ni urejena", "do 1 m", *c) for o, i, *c in sides], "ord int, segment_id string, segment_status string, accuracy string, x0 double, y0 double, x1 double, y1 double")
    got = PA.boundary_status(p, PA.boundary_segments(p, s)).first()
    assert (got.status, got.total_segments, got.evidence_complete, got.accuracy) == ("not_ordered", 3, True, "do 1 m")
    two = PA.boundary_status(p, PA.boundary_segments(p, s.limit(2))).first()
    assert (two.status, two.evidence_complete) == ("not_ordered", False)


def job(**kw):
    import json

    return json.dumps(kw)


def test_usage_totals_and_cached_results(spark):
    rows = [("r1", "j1"), ("r2", "j2"), ("r3", "j3")]
    req = spark.createDataFrame(rows, "request_id string, job_id string").withColumns(
        {"requested_at": F.lit(NOW).cast("timestamp_ntz"), "status_updated_at": F.lit(NOW).cast("timestamp_ntz"), "status": F.lit("queued")}
    )
    later = (NOW + dt.timedelta(minutes=1)).isoformat()
    usage = {"configured": True, "model": "m", "calls": 2, "input_tokens": 1200, "output_tokens": 180, "total_tokens": 1380}
    warn = [{"extraction_warnings": [U.FAILURE_PREFIX + " (X)", "drugo"]}]
    texts = [
        job(id="j1", status="completed", updated_at=later, from_cache=False, result={"openai_usage": usage, "documents": warn}),
        job(id="j2", status="completed", updated_at=later, from_cache=True, result={"openai_usage": usage, "documents": warn}),
        job(id="j3", status="odd", updated_at=later),
        "{broken",
    ]
    jobs = U.parse_jobs(spark.createDataFrame([(t,) for t in texts], "value string"))
    out = U.sync_job_state(R.conform_requests(req), jobs)
    got = {r.job_id: r for r in out.collect()}
    assert (got["j1"].openai_total_tokens, got["j1"].openai_failures) == (1380, 1)
    assert (got["j2"].openai_total_tokens, got["j2"].openai_failures, got["j2"].status) == (0, 0, "completed")
    assert got["j3"].status == "queued"
    report = {(r.section, r.key): r for r in U.usage_report(out, 7, NOW).collect()}
    assert report["summary", ""].analyses == 2 and report["summary", ""].total_tokens == 1380
    assert report["model", "m"].analyses == 1 and report["model", "Ni modela"].analyses == 0


def test_result_expires_exactly_after_seven_days(spark):
    stored = H.cache_rows(spark.createDataFrame([("2057 314/4", NOW)], "parcel_reference string, stored_at timestamp_ntz"))
    ask = spark.createDataFrame([(" 2057   314/4", False)], "parcel_reference string, force_refresh boolean")
    at = lambda d: H.reuse_results(ask, stored, NOW + d).first().reused
    assert at(dt.timedelta(days=7) - dt.timedelta(seconds=1)) and not at(dt.timedelta(days=7))


def test_failed_logins_by_address_or_user(spark):
    rows = [(i, NOW + dt.timedelta(minutes=m), ip, u, ok) for i, m, ip, u, ok in [
        (1, 0, "a", "x", False), (2, 1, "a", "y", False), (3, 2, "b", "x", False), (4, 3, "a", "x", False), (5, 17, "a", "x", True), (6, 16, "c", "z", True)]]
    df = spark.createDataFrame(rows, "id int, attempted_at timestamp_ntz, ip_address string, username string, successful boolean")
    got = {r.id: (r.failures, r.blocked) for r in R.failed_logins(df, 15, 3).collect()}
    assert got[4] == (3, True) and got[5] == (2, False) and got[6] == (0, False)


def test_late_record_vanishes(spark, tmp_path):
    src = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(src)
    write([(1, NOW)])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = S.retained(spark.readStream.schema("event_id bigint, ts timestamp_ntz").parquet(src), "ts", 90)
        q = stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination()

    run()
    write([(2, NOW - dt.timedelta(days=91)), (3, NOW - dt.timedelta(days=1))])
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_status_over_several_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "job_id string, status string, updated_at timestamp_ntz, progress bigint"
    for n, (status, progress) in enumerate([("running", 40), ("completed", 0), ("running", 10)]):
        spark.createDataFrame([("j", status, NOW + dt.timedelta(minutes=n), progress)], schema).coalesce(1).write.mode("append").parquet(src)
    got = S.follow_status(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).collect()
    assert [(r.status, r.progress) for r in got] == [("completed", 100)]


def test_csv_has_mark_semicolons_and_crlf(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b;c", 2)], "`Združeno po` string, `Število` int")
    E.write_excel_csv(df, str(tmp_path / "csv"), one_file=True)
    data = open(glob.glob(str(tmp_path / "csv" / "part-*"))[0], "rb").read()
    assert data.startswith(b"\xef\xbb\xbf" + "Združeno po;Število\r\n".encode())
    assert data.endswith(b'"b;c";2\r\n')


def test_archive_files_on_disk(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("mapa/načrt.pdf", b"1")
        z.writestr("../outside.pdf", b"2")
        z.writestr("opis.txt", b"3")
    got = {r.source_name: r.local_name for r in AR.expand_archives(AR.read_archives(spark, str(tmp_path))).collect()}
    assert set(got) == {"mapa/načrt.pdf", "../outside.pdf"}
    assert got["../outside.pdf"].startswith("outside-") and "/" not in got["../outside.pdf"]


def test_layers_from_files(spark, tmp_path):
    import json

    f = {"features": [
        {"attributes": {"OBMOCJE": "Test Natura"}, "geometry": {"rings": [[[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}},
        {"attributes": {"OBMOCJE": "brez"}, "geometry": None}]}
    (tmp_path / "p1.json").write_text(json.dumps(f))
    rows = FE.read_arcgis_layer(spark, str(tmp_path), "5667", required=("geom",)).collect()
    assert len(rows) == 1 and rows[0].props["OBMOCJE"] == "Test Natura" and rows[0].geom.clean and rows[0].x1 == 10
