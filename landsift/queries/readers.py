"""Readers over text that Spark derives from the tables, and keyed snapshots."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import geometry as G
from landsift.functions import text as T
from landsift.operators import history as H
from landsift.operators.snapshot import KeyedSnapshot
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.session import new_folder, spread, table
from landsift.sources import archives as A
from landsift.sources import features as FE
from landsift.sources import logs as L

NOW = dt.datetime(2024, 1, 20)


def geojson_pages(spark, folder):
    """Zones as GeoJSON text, one page per zone; every sixth lacks its geometry."""
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"), ("x0", "y0"))])
    feature = F.struct(
        F.col("zone_id").cast("string").alias("id"),
        F.struct(F.col("s_name").alias("IME"), F.col("planning_unit").alias("EUP"), F.col("act_id").alias("AKT")).alias("properties"),
        F.when(F.col("zone_id") % 6 != 0, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"),
    )
    return X.zones(spark, folder).select("zone_id", F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))


@query(
    "s1_geojson_layer",
    X.ctes("zones") + """ SELECT zone_id, s_name AS ime, planning_unit AS eup, CAST(NULL AS VARCHAR) AS akt, CASE WHEN zone_id % 6 <> 0 THEN x0 END AS x0,
    CASE WHEN zone_id % 6 <> 0 THEN y1 END AS y1, CASE WHEN zone_id % 6 <> 0 THEN w * h END AS area FROM zones""",
)
def s1_geojson_layer(spark, folder):
    layer = FE.parse_layer(geojson_pages(spark, folder), "zones", props=["IME", "EUP"])
    area = F.when(F.col("geom").isNotNull(), G.area(F.col("geom")))
    out = FE.select_props(layer, ["IME", "EUP", "AKT"])
    return out.select("zone_id", F.col("IME").alias("ime"), F.col("EUP").alias("eup"), F.col("AKT").alias("akt"), "x0", "y1", area.alias("area"))


def arcgis_pages(spark, folder):
    """Zones and lines as ArcGIS text: rings with a hole, rings that cross, paths, and points."""
    def ring(a, b, c, d):
        return f"array(array({a},{b}), array({a},{d}), array({c},{d}), array({c},{b}), array({a},{b}))"

    z = F.col("zone_id")
    geometry = F.when(z % 4 == 0, F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(None).cast("array<array<array<double>>>").alias("paths"), F.lit(None).cast("array<array<array<double>>>").alias("rings"))).when(
        z % 4 == 1,
        F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.expr("array(array(array(x0,y0), array(x1,y0)), array(array(x0,y1), array(x1,y1)))").alias("paths"), F.lit(None).cast("array<array<array<double>>>").alias("rings")),
    ).when(
        z % 4 == 2,
        F.struct(
            F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("array<array<array<double>>>").alias("paths"),
            F.expr(
                f"concat(array({ring('x0','y0','x1','y1')}, {ring('x0+100','y0+100','x0+200','y0+200')}, array(array(x0, y0), array(x1, y1))),"
                f" CASE WHEN zone_id % 8 = 6 THEN array({ring('x0+300','y0+300','x1+300','y1+300')}) ELSE array() END)"
            ).alias("rings"),
        ),
    )
    feature = F.struct(F.struct(F.col("s_name").alias("IME")).alias("attributes"), geometry.alias("geometry"))
    return X.zones(spark, folder).select("zone_id", F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))


ARC = """SELECT zone_id, ['point', 'line', 'polygon', NULL][zone_id % 4 + 1] AS kind, CASE WHEN zone_id % 8 = 6 THEN 2 * w * h - 10000 - 2 * (w - 300) * (h - 300) WHEN zone_id % 4 = 2 THEN w * h - 10000 WHEN zone_id % 4 <> 3 THEN 0 END AS area,
  CASE zone_id % 4 WHEN 1 THEN 2 * w WHEN 0 THEN 0 WHEN 2 THEN 2 * (w + h) * (1 + (zone_id % 8 = 6)::INT) + 400 END AS length FROM zones"""


@query("s2_arcgis_layer", X.ctes("zones") + f" {ARC}")
def s2_arcgis_layer(spark, folder):
    layer = FE.parse_layer(arcgis_pages(spark, folder), "x", arcgis=True)
    g = F.col("geom")
    return layer.select("zone_id", "geom.kind", F.when(g.isNotNull(), F.round(G.area(g), 3)).alias("area"), F.when(g.isNotNull(), F.round(G.length(g), 3)).alias("length"))


@query("x1_normalise_geometry", X.ctes("zones") + f" SELECT kind, count(*) AS n, sum(area) AS area FROM ({ARC}) GROUP BY 1")
def x1_normalise_geometry(spark, folder):
    return s2_arcgis_layer(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("s3_required_parts", X.ctes("zones") + f" SELECT zone_id, kind FROM ({ARC}) WHERE kind IS NOT NULL")
def s3_required_parts(spark, folder):
    return FE.parse_layer(arcgis_pages(spark, folder), "x", arcgis=True, required=("props", "geom")).select("zone_id", "geom.kind")


@query("f8_valid_geometry", X.ctes("zones") + f" SELECT zone_id FROM ({ARC}) WHERE kind IS NOT NULL")
def f8_valid_geometry(spark, folder):
    return G.valid_geometry(FE.parse_layer(arcgis_pages(spark, folder), "x", arcgis=True)).select("zone_id")


@query(
    "s4_event_log",
    "SELECT CASE WHEN event_id % 7 = 2 THEN CAST(ts AS DATE)::TIMESTAMP ELSE ts END AS recorded_at, 'v' || user_id AS visitor_id, event_type, CAST(NULL AS VARCHAR) AS parcel_reference FROM events WHERE event_id % 7 NOT IN (0, 1)",
)
def s4_event_log(spark, folder):
    e = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    moment = F.when(e % 7 == 1, "yesterday").when(e % 7 == 2, F.substring(iso, 1, 10)).otherwise(iso)
    text = F.to_json(F.struct(moment.alias("recorded_at"), F.concat(F.lit("v"), F.col("user_id")).alias("visitor_id"), "event_type"))
    lines = table(spark, folder, "events").select(F.when(e % 7 == 0, F.substring(text, 1, 9)).otherwise(text).alias("value"))
    return L.parse_event_lines(lines).drop("consent_version")


def marked_pages(spark, folder):
    p = F.col("page_id")
    row = F.concat(F.lit("<table><tr><th>x</th></tr><tr class='a'><td> <b>La</b>bel </td>\n<td>cona&nbsp;"), p % 5, F.lit(" &amp; b</td></tr></table>"))
    form = F.concat(F.lit("<form method='post' id='f1'><input type=hidden name='a' value='1'><INPUT value=\""), p, F.lit("\" name=\"b\"/><input name='a' value='2'><input type=submit></form>"))
    return table(spark, folder, "pages").select("page_id", F.concat(F.col("html"), F.when(p % 3 != 0, row).otherwise(""), form).alias("html"))


@query("s9_html_table_value", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'cona ' || (page_id % 5) || ' & b' END AS value FROM pages")
def s9_html_table_value(spark, folder):
    return L.html_table_value(marked_pages(spark, folder), "LABEL").select("page_id", "value")


@query("s10_html_form_fields", "SELECT page_id, '2' AS a, CAST(page_id AS VARCHAR) AS b, 2 AS n FROM pages")
def s10_html_form_fields(spark, folder):
    f = L.html_form_fields(marked_pages(spark, folder), "f1")
    return f.select("page_id", F.col("fields.a").alias("a"), F.col("fields.b").alias("b"), F.size("fields").alias("n"))


def _pack(batches):
    """One archive per document, with files of every kind."""
    def nested(files):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data in files:
                z.writestr(name, data)
        return buffer.getvalue()

    for batch in batches:
        rows = []
        for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
            data = text.encode()
            inner = nested([("odlok č.pdf", lang.encode()), ("globlje.zip", nested([("../p.PDF", b"p"), ("tretji.zip", nested([("q.pdf", b"q")]))]))])
            files = [(f"a/Karta {doc_id}.pdf", data), ("preberi.txt", b"x"), ("Tekstualni_del.zip", inner), ("drugo.zip", nested([("n.pdf", b"n")]))]
            rows.append((f"{doc_id}.zip", nested(files) if doc_id % 10 else b"no archive"))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    "s7_expand_archives",
    """SELECT doc_id || '.zip' AS archive, NULL AS source_name, NULL AS local_name, NULL AS size_bytes, 'bad_archive' AS rejected_reason FROM documents WHERE doc_id % 10 = 0
    UNION ALL SELECT doc_id || '.zip', NULL, NULL, NULL, 'pdf_too_large' FROM documents WHERE doc_id % 10 <> 0 AND octet_length(encode(text)) > 20000
    UNION ALL SELECT doc_id || '.zip', n, l, s, NULL FROM (SELECT doc_id, unnest(['a/Karta ' || doc_id || '.pdf', 'Tekstualni_del.zip::odlok č.pdf', 'Tekstualni_del.zip::globlje.zip::../p.PDF']) AS n,
      unnest(['Karta ' || doc_id || '-' || sha256(text)[1:10] || '.pdf', 'odlok č-' || sha256(lang)[1:10] || '.pdf', 'p-' || sha256('p')[1:10] || '.pdf']) AS l,
      unnest([octet_length(encode(text)), octet_length(encode(lang)), 1]) AS s FROM documents WHERE doc_id % 10 <> 0 AND octet_length(encode(text)) <= 20000)""",
)
def s7_expand_archives(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), 2_000)
    packed = docs.mapInPandas(_pack, "path string, content binary")
    return A.expand_archives(packed, A.Limits(pdf_bytes=20_000, archive_bytes=100_000)).drop("sha256")


@query(
    "w11_archive_size_limit",
    "SELECT doc_id % 10 = 0 AS broken, count(*) AS archives FROM documents WHERE doc_id % 10 = 0 OR octet_length(encode(text)) + octet_length(encode(lang)) + 1 > 2 * 2000 GROUP BY 1",
)
def w11_archive_size_limit(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), 2_000)
    packed = docs.mapInPandas(_pack, "path string, content binary")
    out = A.expand_archives(packed, A.Limits(pdf_bytes=10_000_000, archive_bytes=2000))
    return out.filter("rejected_reason IS NOT NULL").groupBy((F.col("rejected_reason") == "bad_archive").alias("broken")).agg(F.count("*").alias("archives"))


@query(
    "s8_valid_manifests",
    """SELECT l_suppkey AS act_id FROM lineitem GROUP BY 1 HAVING l_suppkey % 4 <> 0
    AND count(*) FILTER (WHERE l_linenumber = 1 AND l_quantity = 50 AND l_tax = 0) = 0""",
)
def s8_valid_manifests(spark, folder):
    li = table(spark, folder, "lineitem")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("local_name")
    listed = li.select(F.col("l_suppkey").alias("act_id"), name)
    gone = li.filter("l_linenumber = 1 AND l_quantity = 50 AND l_tax = 0").select(F.col("l_suppkey").alias("act_id"), name)
    files = listed.join(gone, ["act_id", "local_name"], "left_anti")
    manifests = li.select(F.col("l_suppkey").alias("act_id")).distinct().withColumn("version", F.when(F.col("act_id") % 4 == 0, 1).otherwise(2))
    return A.valid_manifests(manifests, listed, files).select("act_id")


def cache_writes(spark, folder):
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit(" "), (1000 + e % 50).cast("string"), F.lit("   "), (e % 500).cast("string"), F.lit(" ")).alias("parcel_reference"),
        F.col("ts").alias("stored_at"), F.col("value"), (e % 2).alias("half"),
    )


REFERENCE = "(1000 + event_id % 50) || ' ' || (event_id % 500)"


@query(
    "s13_upsert",
    f"SELECT sha256('v8:' || {REFERENCE}) AS cache_key, {REFERENCE} AS parcel_reference, max(ts) AS stored_at, arg_max(value, ts) AS value FROM events GROUP BY 1, 2",
)
def s13_upsert(spark, folder):
    rows = H.cache_rows(cache_writes(spark, folder))
    even, odd = rows.filter("half = 0"), rows.filter("half = 1")
    # both halves hold different keys, so the later write of each key wins
    return H.upsert(even, odd, "cache_key", "stored_at").select("cache_key", "parcel_reference", "stored_at", "value")


@query(
    "s13_snapshot",
    f"SELECT sha256('v8:' || {REFERENCE}) AS cache_key, {REFERENCE} AS parcel_reference, max(ts) AS stored_at, arg_max(value, ts) AS value FROM events GROUP BY 1, 2",
)
def s13_snapshot(spark, folder):
    """The same table from two batches on a snapshot in buckets."""
    rows = H.cache_rows(cache_writes(spark, folder)).select("cache_key", "parcel_reference", "stored_at", "value", "half")
    kept = rows.drop("half")
    latest = lambda both: both.groupBy("cache_key").agg(F.max_by(F.struct(*kept.columns[1:]), "stored_at").alias("r")).select("cache_key", "r.*")
    snapshot = KeyedSnapshot(spark, new_folder(spark, "results"), "cache_key", kept.schema, latest)
    for number in (0, 1):
        snapshot.apply(rows.filter(F.col("half") == number), number)
    return snapshot.read()


@query("x30_cache_key", f"SELECT event_id, sha256('v8:' || {REFERENCE}) AS cache_key FROM events")
def x30_cache_key(spark, folder):
    e = F.col("event_id")
    ref = F.concat(F.lit(" "), (1000 + e % 50).cast("string"), F.lit(" \t"), (e % 500).cast("string"))
    return table(spark, folder, "events").select("event_id", T.cache_key(ref).alias("cache_key"))


@query(
    "t7_reuse_results",
    f"""WITH s AS (SELECT {REFERENCE} AS r, max(ts) AS stored_at FROM events GROUP BY 1)
    SELECT event_id, coalesce(stored_at + INTERVAL 7 DAY > TIMESTAMP '2024-02-05' AND event_id % 3 <> 0, false) AS reused,
      CASE WHEN stored_at + INTERVAL 7 DAY > TIMESTAMP '2024-02-05' AND event_id % 3 <> 0 THEN stored_at END AS stored_at FROM events LEFT JOIN s ON r = {REFERENCE}""",
)
def t7_reuse_results(spark, folder):
    writes = H.cache_rows(cache_writes(spark, folder))
    snapshot = H.upsert(writes.limit(0), writes, "cache_key", "stored_at")
    e = F.col("event_id")
    incoming = table(spark, folder, "events").select(
        "event_id", F.concat((1000 + e % 50).cast("string"), F.lit(" "), (e % 500).cast("string")).alias("parcel_reference"), (e % 3 == 0).alias("force_refresh")
    )
    return H.reuse_results(incoming, snapshot, dt.datetime(2024, 2, 5)).select("event_id", "reused", "stored_at")


@query(
    "w8_recent_searches",
    f"""SELECT user_id, r AS parcel_reference, rank FROM (SELECT user_id, r, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, r) AS rank FROM
      (SELECT user_id, {REFERENCE} AS r, max(ts) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2)) WHERE rank <= 10""",
)
def w8_recent_searches(spark, folder):
    e = F.col("event_id")
    s = table(spark, folder, "events").select(
        F.col("user_id").alias("visitor_id"), F.concat((1000 + e % 50).cast("string"), F.lit(" "), (e % 500).cast("string")).alias("parcel_reference"), F.col("ts").alias("searched_at")
    )
    return H.recent_searches(s, dt.datetime(2024, 2, 4)).select(F.col("visitor_id").alias("user_id"), "parcel_reference", "rank")


@query(
    "w12_progress_curve",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 100 ELSE max(least(99, CAST(props->>'k' AS BIGINT) + event_id % 30)) OVER (PARTITION BY user_id ORDER BY ts) END AS shown FROM events""",
)
def w12_progress_curve(spark, folder):
    steps = table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("at"),
        (F.get_json_object("props", "$.k").cast("bigint") + F.col("event_id") % 30).alias("progress"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"),
    )
    return H.progress_curve(steps).select("event_id", "shown")


@query(
    "s14_supplementary_sources",
    X.ctes("parcels", "page_text")
    + f""", v AS (SELECT doc_id % 40 AS source_id, doc_id AS version, TIMESTAMP '2024-01-10' + INTERVAL (doc_id % 15) DAY AS fetched_at FROM documents WHERE doc_id % 6 <> 0),
    latest AS (SELECT source_id, max((fetched_at, version)) AS v FROM v GROUP BY 1),
    sized AS (SELECT doc_id AS version, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS characters FROM page_text GROUP BY 1 HAVING characters >= 1000)
    SELECT ko_id, parcel_number, source_id, v[2] AS version, v[1] <= TIMESTAMP '2024-01-13' AS stale FROM parcels p JOIN latest l ON p.municipality = {X.sql_pick(X.MUNICIPALITIES, "source_id % 4")} JOIN sized ON sized.version = v[2]""",
)
def s14_supplementary_sources(spark, folder):
    d = F.col("doc_id")
    versions = table(spark, folder, "documents").select(
        F.upper(X.pick(X.MUNICIPALITIES, "doc_id % 40 % 4")).alias("municipality"), (d % 40).alias("source_id"), d.alias("version"),
        (F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, cast(doc_id % 15 as int))")).alias("fetched_at"), (d % 6 != 0).alias("readable"),
    )
    pages = X.page_text(spark, folder).select((d % 40).alias("source_id"), d.alias("version"), "text")
    out = H.select_supplementary_sources(X.parcels(spark, folder), versions, pages, NOW)
    return out.select(*PARCEL_KEY, "source_id", "version", "stale")


@query("a22_text_gate", X.ctes("page_text") + r" SELECT doc_id, CAST(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS characters FROM page_text GROUP BY 1 HAVING characters >= 1000")
def a22_text_gate(spark, folder):
    pages = X.page_text(spark, folder)
    return pages.groupBy("doc_id").agg(F.sum(F.length(T.squeeze_ends(F.col("text")))).alias("characters")).filter(F.col("characters") >= H.SOURCE_CHARACTERS)


@query("u4_text_sources", X.ctes("page_text") + " SELECT origin, count(*) AS pages FROM (SELECT 'archive' AS origin FROM page_text WHERE doc_id % 2 = 0 UNION ALL SELECT 'municipal' FROM page_text WHERE doc_id % 2 = 1) GROUP BY 1")
def u4_text_sources(spark, folder):
    p = X.page_text(spark, folder)
    both = p.filter("doc_id % 2 = 0").withColumn("origin", F.lit("archive")).unionByName(p.filter("doc_id % 2 = 1").withColumn("origin", F.lit("municipal")))
    return both.groupBy("origin").agg(F.count("*").alias("pages"))
