"""Text, number and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift.functions import text as T
from landsift.operators import traffic as R
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.session import table


@query(
    "x14_parse_reference",
    """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 1000 + event_id % 50 END AS ko_id,
    CASE event_id % 5 WHEN 0 THEN event_id || '/' || (event_id % 7) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN event_id || '/3' END AS parcel_number FROM events""",
)
def x14_parse_reference(spark, folder):
    e, ko = F.col("event_id"), (1000 + F.col("event_id") % 50).cast("string")
    text = (
        F.when(e % 5 == 0, F.concat(F.lit("  "), ko, F.lit("   "), e, F.lit(" / "), e % 7, F.lit(" ")))
        .when(e % 5 == 1, F.concat(ko, F.lit("-"), e))
        .when(e % 5 == 2, F.concat(ko, F.lit(":"), e, F.lit("/3")))
        .when(e % 5 == 3, F.concat(ko, F.lit("  "), e, F.lit("/a")))
        .otherwise(F.concat(F.lit("123456 "), e))
    )
    p = T.parse_parcel_reference(text)
    return table(spark, folder, "events").select("event_id", p["ko_id"].alias("ko_id"), p["parcel_number"].alias("parcel_number"))


@query(
    "x16_clean_value",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'a b' WHEN 4 THEN 'Ni podatka' ELSE CAST(event_id AS VARCHAR) || '.5' END AS cleaned,
    CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 3 THEN 'a b' WHEN 5 THEN CAST(event_id AS VARCHAR) || '.5' END AS attribute FROM events""",
)
def x16_clean_value(spark, folder):
    e = F.col("event_id")
    text = (
        F.when(e % 6 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".0")))
        .when(e % 6 == 1, " NaN ")
        .when(e % 6 == 2, F.lit(" \t "))
        .when(e % 6 == 3, F.lit("  a \n b"))
        .when(e % 6 == 4, "Ni podatka")
        .otherwise(F.concat(e.cast("string"), F.lit(".5")))
    )
    return table(spark, folder, "events").select("event_id", T.clean_value(text).alias("cleaned"), T.clean_attribute(text).alias("attribute"))


@query("x19_record_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'leta ' || year(o_orderdate) WHEN o_orderkey % 4 <> 1 THEN day(o_orderdate) || '. ' || month(o_orderdate) || '. ' || year(o_orderdate) END AS text FROM orders")
def x19_record_date(spark, folder):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("leta "), F.year("o_orderdate"))).when(k % 4 != 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return table(spark, folder, "orders").select("o_orderkey", T.format_record_date(raw).alias("text"))


@query(
    "x31_day_bounds",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 10 HOUR ELSE TIMESTAMP '0001-01-01' END AS low,
    CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND WHEN 1 THEN o_orderdate + INTERVAL 10 HOUR ELSE TIMESTAMP '9999-12-31 23:59:59' END AS high FROM orders""",
)
def x31_day_bounds(spark, folder):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.lit("T12:00:00+02:00"))).otherwise("not a date at all")
    return table(spark, folder, "orders").select("o_orderkey", R.day_bounds(text, False).alias("low"), R.day_bounds(text, True).alias("high"))


@query(
    "x32_clip",
    r"""SELECT doc_id, i, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(t[1:59]) || '…' END AS clipped FROM (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM page_lines)""".replace(
        "SELECT doc_id, i, CASE", X.ctes("page_lines") + " SELECT doc_id, i, CASE", 1
    ),
)
def x32_clip(spark, folder):
    return X.page_lines(spark, folder).select("doc_id", "i", T.clip(F.col("line"), 60).alias("clipped"))


@query("x32_percentage", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(regexp_replace(regexp_replace(printf('%.2f', l_quantity + l_discount), '0+$', ''), '\\.$', ''), '.', ',') || ' %' AS text FROM lineitem")
def x32_percentage(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.format_percentage(F.col("l_quantity") + F.col("l_discount")).alias("text"))


@query(
    "x33_file_names",
    "SELECT doc_id, 'Načrt_ ' || doc_id || ' (1)-' || sha256(text)[1:10] || '.pdf' AS name, 'poročilo-1000-' || doc_id || '-7.pdf' AS report FROM documents".replace("poročilo", "porocilo"),
)
def x33_file_names(spark, folder):
    d = F.col("doc_id")
    name = T.safe_filename(F.concat(F.lit("a/b/ Načrt§ "), d, F.lit(" (1).PDF")), F.sha2(F.col("text").cast("binary"), 256))
    report = T.report_filename("porocilo", F.lit(1000), F.concat(d, F.lit("/7")))
    return table(spark, folder, "documents").select("doc_id", name.alias("name"), report.alias("report"))
