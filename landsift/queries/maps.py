"""Map sheets and windows, and the geometry functions on boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import geometry as G
from landsift.operators import maps as M
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.planning import BASE, KEY, OVERLAP, TOUCH, contexts
from landsift.session import spread, table


def sheets(spark, folder):
    """Sheets from suppliers: a tile of the 10 km square each, one page of a document."""
    s = F.col("s_suppkey")
    x, y = (s % 10 * 1000).cast("double"), (F.expr("s_suppkey div 10 % 10") * 1000).cast("double")
    return table(spark, folder, "supplier").select(
        (s % 30).alias("doc_id"), (s % 7).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + 1000).alias("x1"), (y + 1000).alias("y1")
    )


SHEETS = """sheets AS (SELECT s_suppkey % 30 AS doc_id, CAST(s_suppkey % 7 AS INT) AS page, CAST(s_suppkey % 10 * 1000 AS DOUBLE) AS x0, CAST(s_suppkey // 10 % 10 * 1000 AS DOUBLE) AS y0,
    CAST(s_suppkey % 10 * 1000 + 1000 AS DOUBLE) AS x1, CAST(s_suppkey // 10 % 10 * 1000 + 1000 AS DOUBLE) AS y1 FROM supplier),
  named AS (SELECT 1000 + l_partkey % 50 AS ko_id, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || '/' || (l_partkey % 7 + 1) END AS parcel_number,
      l_suppkey % 30 AS doc_id, CAST(l_orderkey % 7 AS INT) AS page FROM lineitem),
  by_area AS (SELECT """ + f"""{KEY}, doc_id, page FROM parcels p JOIN sheets z ON p.x0 * 1e-5 <= z.x1 * 1e-5 + 1e-7 AND z.x0 * 1e-5 - 1e-7 <= p.x1 * 1e-5 AND p.y0 * 1e-5 <= z.y1 * 1e-5 + 1e-7 AND z.y0 * 1e-5 - 1e-7 <= p.y1 * 1e-5),
  sheet_match AS (SELECT *, 'geospatial' AS match_method FROM by_area UNION ALL
    SELECT *, 'parcel_label' FROM (SELECT DISTINCT {KEY}, doc_id, page FROM named WHERE page > 0 EXCEPT SELECT {KEY}, doc_id, page FROM by_area))"""


def named(spark, folder):
    k = F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        (1000 + k % 50).alias("ko_id"),
        F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 7 + 1).cast("string"))).alias("parcel_number"),
        (F.col("l_suppkey") % 30).alias("doc_id"),
        (F.col("l_orderkey") % 7).cast("int").alias("page"),
    )


def in_degrees(df):
    """The boxes of a table in units of about a degree: a metre is 0.00001."""
    return df.withColumns({c: F.col(c) * F.lit(1e-5) for c in ("x0", "y0", "x1", "y1")})


def matches(spark, folder):
    return M.map_sheet_matches(in_degrees(X.parcels(spark, folder)), in_degrees(sheets(spark, folder)), named(spark, folder))


@query("j17_map_sheet_matches", X.ctes("parcels") + f", {SHEETS} SELECT * FROM sheet_match")
def j17_map_sheet_matches(spark, folder):
    return matches(spark, folder)


@query("u5_unmatched_pages", X.ctes("parcels") + f", {SHEETS} SELECT {KEY}, doc_id, page FROM sheet_match WHERE match_method = 'parcel_label'")
def u5_unmatched_pages(spark, folder):
    return matches(spark, folder).filter("match_method = 'parcel_label'").drop("match_method")


@query(
    "w9_top_map_evidence",
    BASE
    + f""", {SHEETS}, m AS (SELECT *, doc_id % 20 AS act_id, 'List ' || (doc_id % 4) AS pdf_title, 'c' || (doc_id % 15) AS checksum FROM sheet_match),
    o AS (SELECT m.*, (c.act_id IS NULL, match_method <> 'geospatial', -m.act_id, pdf_title) AS o FROM m LEFT JOIN (SELECT DISTINCT {KEY}, act_id FROM context) c USING (ko_id, parcel_number, act_id)),
    g AS (SELECT {KEY}, checksum, page, min(o) AS o FROM o GROUP BY ALL)
    SELECT {KEY}, checksum, page, row_number() OVER (PARTITION BY {KEY} ORDER BY o, checksum, page) AS rank FROM g
    QUALIFY rank <= 3""",
)
def w9_top_map_evidence(spark, folder):
    m = matches(spark, folder).select(
        *PARCEL_KEY, "page", "match_method", (F.col("doc_id") % 20).alias("act_id"), F.concat(F.lit("List "), F.col("doc_id") % 4).alias("pdf_title"),
        F.concat(F.lit("c"), F.col("doc_id") % 15).alias("checksum"),
    )
    return M.top_map_evidence(m, contexts(spark, folder)).select(*PARCEL_KEY, "checksum", "page", "rank")


WINDOW = """w AS (SELECT *, greatest(x1 - x0, 1) AS bw, greatest(y1 - y0, 1) AS bh FROM parcels),
  w2 AS (SELECT *, bw + 2 * greatest(18, greatest(bw, bh) * 0.18::DOUBLE) AS pw, bh + 2 * greatest(18, greatest(bw, bh) * 0.18::DOUBLE) AS ph FROM w),
  w3 AS (SELECT *, CASE WHEN pw / ph < 1.5 THEN ph * 1.5::DOUBLE ELSE pw END AS fw, CASE WHEN pw / ph < 1.5 THEN ph ELSE pw / 1.5::DOUBLE END AS fh FROM w2),
  w4 AS (SELECT *, greatest(1, 190.0::DOUBLE / fw) AS f FROM w3)"""


@query(
    "x11_map_window",
    X.ctes("parcels") + f""", {WINDOW} SELECT {KEY}, round((x0 + x1) / 2 - fw * f / 2, 6) AS wx0, round((y0 + y1) / 2 - fh * f / 2, 6) AS wy0,
    round((x0 + x1) / 2 + fw * f / 2, 6) AS wx1, round((y0 + y1) / 2 + fh * f / 2, 6) AS wy1 FROM w4""",
)
def x11_map_window(spark, folder):
    w = G.map_window(1.5, M.LAND_USE_MINIMUM)
    return X.parcels(spark, folder).select(*PARCEL_KEY, *[F.round(c, 6).alias(n) for n, c in w.items()])


@query(
    "x12_map_request_url",
    X.ctes("parcels") + f""" SELECT {KEY}, 'https://maps.example.org/wms?SERVICE=WMS&BBOX=' || replace(printf('%.2f,%.2f,%.2f,%.2f', x0, y0, x1, y1), ',', '%2C')
    || '&LAYERS=A%3AB&CQL_FILTER=' || 'KO_ID%3D' || ko_id || '+AND+ST_PARCELE%3D%27' || replace(parcel_number, '/', '%2F') || '%27' AS url FROM parcels""",
)
def x12_map_request_url(spark, folder):
    box = {"wx0": F.col("x0"), "wy0": F.col("y0"), "wx1": F.col("x1"), "wy1": F.col("y1")}
    url = M.map_request_url("https://maps.example.org/wms", "A:B", box, {"SERVICE": "WMS"}, M.parcel_filter(F.col("ko_id"), F.col("parcel_number")))
    return X.parcels(spark, folder).select(*PARCEL_KEY, url.alias("url"))


@query(
    "x13_control_point_fit",
    """WITH p AS (SELECT l_suppkey AS sheet, CAST(l_partkey AS DOUBLE) AS lon, l_quantity AS lat, 3 * CAST(l_partkey AS DOUBLE) + 2 * l_quantity + l_suppkey AS x, CAST(l_partkey AS DOUBLE) - l_quantity AS y FROM lineitem)
    SELECT sheet, 3.0::DOUBLE AS ax, 2.0::DOUBLE AS bx, 1.0::DOUBLE AS ay, -1.0::DOUBLE AS "by" FROM p GROUP BY 1""",
)
def x13_control_point_fit(spark, folder):
    p = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("sheet"), F.col("l_partkey").cast("double").alias("lon"), F.col("l_quantity").alias("lat"),
        (F.col("l_partkey") * 3 + F.col("l_quantity") * 2 + F.col("l_suppkey")).cast("double").alias("x"), (F.col("l_partkey") - F.col("l_quantity")).cast("double").alias("y"),
    )
    fit = M.control_point_fit(p, "sheet")
    return fit.select("sheet", *[F.round(c, 6).alias(c) for c in ("ax", "bx", "ay", "by")])


def shaped(spark, folder):
    p = X.parcels(spark, folder).select("k", "x0", "y0", "x1", "y1")
    return p.withColumn("geom", G.box_geometry())


@query("x2_bbox", X.ctes("parcels") + " SELECT k, x0, y0, x1, y1 FROM parcels")
def x2_bbox(spark, folder):
    g = shaped(spark, folder).select("k", "geom")
    return g.select("k", *[c.alias(n) for n, c in G.bbox(F.col("geom")).items()])


@query("x3_area_length", X.ctes("parcels") + " SELECT k, w * h AS area, 2 * (w + h) AS length FROM parcels")
def x3_area_length(spark, folder):
    return shaped(spark, folder).select("k", G.area(F.col("geom")).alias("area"), G.length(F.col("geom")).alias("length"))


@query(
    "x4_geometry_to_wkt",
    X.ctes("parcels") + " SELECT k, printf('POLYGON((%.3f %.3f,%.3f %.3f,%.3f %.3f,%.3f %.3f,%.3f %.3f))', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) AS wkt FROM parcels",
)
def x4_geometry_to_wkt(spark, folder):
    return shaped(spark, folder).select("k", G.to_wkt(F.col("geom")).alias("wkt"))


def shaped_pairs(spark, folder):
    from landsift.operators.planning import shape_join

    z = X.zones(spark, folder).select("zone_id", "x0", "y0", "x1", "y1").withColumn("geom", G.box_geometry())
    return shape_join(shaped(spark, folder), z)


@query("x5_overlap_area", X.ctes("parcels", "zones") + f" SELECT p.k, z.zone_id, greatest(0, {OVERLAP}) AS overlap FROM parcels p JOIN zones z ON {TOUCH}")
def x5_overlap_area(spark, folder):
    area = G.overlap_area(F.col("geom"), F.col("r_geom"))
    return shaped_pairs(spark, folder).select("k", "zone_id", (F.round(area, 6) + 0.0).alias("overlap"))


@query("x6_intersects", X.ctes("parcels", "zones") + f" SELECT p.k, z.zone_id, true AS meets FROM parcels p JOIN zones z ON {TOUCH}")
def x6_intersects(spark, folder):
    return shaped_pairs(spark, folder).select("k", "zone_id", G.intersects(F.col("geom"), F.col("r_geom")).alias("meets"))


@query(
    "x7_distance",
    X.ctes("parcels", "lines") + """ SELECT p.k, z.line_id, round(sqrt(pow(greatest(0, z.x0 - p.x1, p.x0 - z.x1), 2) + pow(greatest(0, z.y0 - p.y1, p.y0 - z.y1), 2)), 6) AS distance
    FROM parcels p JOIN lines z ON p.x0 <= z.x1 + 70 AND z.x0 - 70 <= p.x1 AND p.y0 <= z.y1 + 70 AND z.y0 - 70 <= p.y1""",
)
def x7_distance(spark, folder):
    from landsift.operators.planning import shape_join

    lines = X.network_lines(spark, folder).select("line_id", "x0", "y0", "x1", "y1").withColumn("geom", G.segment_geometry())
    pairs = shape_join(shaped(spark, folder), lines, margin=70.0)
    return pairs.select("k", "line_id", F.round(G.distance(F.col("geom"), F.col("r_geom")), 6).alias("distance"))


@query(
    "x8_covers",
    X.ctes("parcels", "zones") + f" SELECT p.k, z.zone_id, p.x0 >= z.x0 AND p.y0 >= z.y0 AND p.x1 <= z.x1 AND p.y1 <= z.y1 AS covered FROM parcels p JOIN zones z ON {TOUCH}",
)
def x8_covers(spark, folder):
    return shaped_pairs(spark, folder).select("k", "zone_id", G.covers(F.col("r_geom"), F.col("geom")).alias("covered"))


@query(
    "x10_point_in_polygon",
    X.ctes("parcels", "zones") + f""" SELECT p.k, z.zone_id, (p.x0 + p.x1) / 2 > z.x0 AND (p.x0 + p.x1) / 2 < z.x1 AND (p.y0 + p.y1) / 2 > z.y0 AND (p.y0 + p.y1) / 2 < z.y1 AS inside
    FROM parcels p JOIN zones z ON {TOUCH} WHERE (p.x0 + p.x1) / 2 NOT IN (z.x0, z.x1) AND (p.y0 + p.y1) / 2 NOT IN (z.y0, z.y1)""",
)
def x10_point_in_polygon(spark, folder):
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    off_edge = ~mx.isin(F.col("r_x0"), F.col("r_x1")) & ~my.isin(F.col("r_y0"), F.col("r_y1"))
    return shaped_pairs(spark, folder).filter(off_edge).select("k", "zone_id", G.point_in_polygon(mx, my, F.col("r_geom")).alias("inside"))


@query("x9_length_within", X.ctes("parcels") + " SELECT k, w AS below, 0.05::DOUBLE * 2 AS across FROM parcels")
def x9_length_within(spark, folder):
    """The lower side lies on the outline; a line through the middle only near the sides it crosses."""
    p = spread(shaped(spark, folder), 20_000)
    low = F.struct(F.lit("line").alias("kind"), F.array(F.array("x0", "x1")).alias("xs"), F.array(F.array("y0", "y0")).alias("ys"))
    mid = (F.col("y0") + F.col("y1")) / 2
    across = F.struct(F.lit("line").alias("kind"), F.array(F.array("x0", "x1")).alias("xs"), F.array(F.array(mid, mid)).alias("ys"))
    return p.select("k", F.round(G.length_within(low, F.col("geom")), 6).alias("below"), F.round(G.length_within(across, F.col("geom")), 6).alias("across"))
