"""Request log queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from landsift.functions import agent as A
from landsift.functions import text as T
from landsift.operators import traffic as R
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.planning import sql_map
from landsift.session import table
from landsift.sources import exports as E

SECRET = "a fixed test secret"
NOW = dt.datetime(2024, 1, 31)


def log(spark, folder):
    raw = X.requests(spark, folder)
    return R.enrich_requests(R.apply_consent(raw, "2026-01"), SECRET, ipv6=False)


LOG = f"""log AS (SELECT * REPLACE (CASE WHEN ok THEN visitor_id END AS visitor_id, ok AS analytics_consent,
      CASE WHEN ok THEN consent_version END AS consent_version),
    CASE WHEN regexp_matches(user_agent, '(?i)bot|crawler|spider|slurp|headless') THEN 'bot' WHEN regexp_matches(user_agent, '(?i)ipad|tablet') THEN 'tablet'
      WHEN regexp_matches(user_agent, '(?i)mobile|iphone|ipod|android') THEN 'mobile' ELSE 'desktop' END AS device_type,
    CASE WHEN user_agent LIKE '%Edg/%' THEN 'Edge' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome'
      WHEN user_agent LIKE '%Safari/%' AND user_agent LIKE '%Version/%' THEN 'Safari' ELSE 'Other' END AS browser_family,
    CASE WHEN user_agent LIKE '%iPhone%' OR user_agent LIKE '%iPad%' THEN 'iOS' WHEN user_agent LIKE '%Android%' THEN 'Android'
      WHEN user_agent LIKE '%Windows%' THEN 'Windows' WHEN user_agent LIKE '%Mac OS X%' THEN 'macOS' WHEN user_agent LIKE '%Linux%' THEN 'Linux' ELSE 'Other' END AS os_family,
    CASE event_id % 5 WHEN 0 THEN 'search.example.org' WHEN 4 THEN 'host.example.com' ELSE '' END AS referer_host,
    'T-' || substr(sha256(encode('{SECRET}') || '\\x00'::BLOB || encode(ip_address) || '\\x00'::BLOB || encode(user_agent)), 1, 12) AS technical_group
  FROM (SELECT *, coalesce(analytics_consent AND consent_version = '2026-01', false) AS ok FROM requests))"""
BASE = X.ctes("requests") + f", {LOG}"
FILTERS = R.RequestFilters(date_from="2024-01-05", date_to="2024-01-20", parcel="10", status="completed", visitor="%R%")
WHERE = """requested_at >= TIMESTAMP '2024-01-05' AND requested_at <= TIMESTAMP '2024-01-20 23:59:59.999999'
  AND parcel_reference ILIKE '%10%' AND status = 'completed'
  AND (visitor_id ILIKE '%%R%%' OR technical_group ILIKE '%%R%%' OR request_id ILIKE '%%R%%')"""


@query("x26_user_agent", BASE + " SELECT user_agent, device_type, browser_family, os_family, count(*) AS n FROM log GROUP BY ALL")
def x26_user_agent(spark, folder):
    return log(spark, folder).groupBy("user_agent", "device_type", "browser_family", "os_family").agg(F.count("*").alias("n"))


@query("x27_normalise_ip", X.ctes("requests") + " SELECT request_id, ip_address FROM requests")
def x27_normalise_ip(spark, folder):
    raw = X.requests(spark, folder).select("request_id", F.concat(F.lit(" "), F.col("ip_address")).alias("raw"))
    return raw.select("request_id", A.normalise_ip(F.col("raw")).alias("ip_address"))


@query("x28_referer_host", BASE + " SELECT request_id, referer_host FROM log")
def x28_referer_host(spark, folder):
    return log(spark, folder).select("request_id", "referer_host")


@query("x29_technical_group", BASE + " SELECT request_id, technical_group FROM log")
def x29_technical_group(spark, folder):
    return log(spark, folder).select("request_id", "technical_group")


@query("f5_filter_requests", BASE + f" SELECT request_id, visitor_id, status, requested_at FROM log WHERE {WHERE}")
def f5_filter_requests(spark, folder):
    return R.filter_requests(log(spark, folder), FILTERS).select("request_id", "visitor_id", "status", "requested_at")


@query("f11_consent_gate", BASE + " SELECT request_id, visitor_id, analytics_consent, consent_version FROM log")
def f11_consent_gate(spark, folder):
    return R.apply_consent(X.requests(spark, folder), "2026-01").select(
        "request_id", "visitor_id", "analytics_consent", "consent_version"
    )


@query(
    "f12_normalise_domain",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events",
)
def f12_normalise_domain(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", T.normalise_domain(F.col("event_type"), ["click", "view"], "other").alias("kind")
    )


SUMMARY = """SELECT count(*) AS requests, count(DISTINCT ip_address) AS unique_ips, count(DISTINCT visitor_id) AS consented_visitors,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status IN ('queued', 'running')) AS active FROM log"""


@query("a10_request_summary", BASE + f" {SUMMARY}")
def a10_request_summary(spark, folder):
    return R.request_summary(log(spark, folder))


@query("a10_filtered_summary", BASE + f" {SUMMARY} WHERE {WHERE}")
def a10_filtered_summary(spark, folder):
    return R.request_summary(R.filter_requests(log(spark, folder), FILTERS))


TECH = "CASE {0} WHEN 'Other' THEN 'Drugo' ELSE {0} END"
DEVICE_NAME = f"{sql_map(R.DEVICE_LABELS, 'device_type')} || ' · ' || {TECH.format('browser_family')} || ' · ' || {TECH.format('os_family')}"
KEYS = {
    "visitor": (
        "coalesce(visitor_id, 'request:' || request_id)",
        f"CASE WHEN visitor_id IS NULL THEN '{R.NO_VISITOR_LABEL}' ELSE 'Obiskovalec ' || visitor_id[1:8] END",
    ),
    "technical": ("technical_group", "technical_group"),
    "ip": ("ip_address", "ip_address"),
    "parcel": ("parcel_reference", "parcel_reference"),
    "device": (DEVICE_NAME, DEVICE_NAME),
    "day": ("strftime(requested_at, '%Y-%m-%d')", "strftime(requested_at, '%Y-%m-%d')"),
    "status": ("status", sql_map(R.STATUS_LABELS, "status")),
}


def _register_groups(by, key, name):
    sql = (
        BASE
        + f""" SELECT {key} AS key, {name} AS label, count(*) AS request_count, count(DISTINCT ip_address) AS unique_ips,
        max(requested_at) AS last_request FROM log GROUP BY ALL ORDER BY request_count DESC, last_request DESC, key LIMIT 500"""
    )

    @query(f"a11_request_groups_{by}", sql)
    def run(spark, folder):
        return R.request_groups(log(spark, folder), by)


for _by, (_key, _name) in KEYS.items():
    _register_groups(_by, _key, _name)


@query(
    "k6_top_groups",
    BASE + " SELECT parcel_reference AS key, count(*) AS request_count, max(requested_at) AS last_request FROM log GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100",
)
def k6_top_groups(spark, folder):
    return R.request_groups(log(spark, folder), "parcel", 100).select("key", "request_count", "last_request")


@query("k5_request_page", BASE + " SELECT request_id, requested_at, status FROM log ORDER BY requested_at DESC, request_id DESC LIMIT 100 OFFSET 40")
def k5_request_page(spark, folder):
    return R.request_page(log(spark, folder), 100, 40).select("request_id", "requested_at", "status")


@query(
    "s6_request_log",
    BASE
    + """ SELECT request_id, strftime(requested_at, '%Y-%m-%d') AS day, 0 AS openai_calls, false AS openai_usage_synced,
    CAST(NULL AS VARCHAR) AS openai_model, technical_group FROM log""",
)
def s6_request_log(spark, folder):
    from landsift.session import new_folder

    path = new_folder(spark, "requests")
    R.append_requests(log(spark, folder), path)
    back = spark.read.parquet(path)
    return back.select(
        "request_id", F.col("day").cast("string").alias("day"), "openai_calls", "openai_usage_synced", "openai_model", "technical_group"
    )


CSV_COLUMNS = ["ID zahteve", "Stanje", "Vrsta naprave", "Brskalnik", "Analitično soglasje", "ID obiskovalca"]


@query(
    "s11_request_csv",
    BASE
    + f""" SELECT request_id AS "ID zahteve", {sql_map(R.STATUS_LABELS, "status")} AS "Stanje", {sql_map(R.DEVICE_LABELS, "device_type")} AS "Vrsta naprave",
    {TECH.format('browser_family')} AS "Brskalnik", CASE WHEN analytics_consent THEN 'DA' ELSE 'NE' END AS "Analitično soglasje",
    coalesce(visitor_id, '') AS "ID obiskovalca" FROM log""",
)
def s11_request_csv(spark, folder):
    from landsift.session import new_folder

    path = new_folder(spark, "csv")
    E.write_excel_csv(E.request_rows(R.conform_requests(log(spark, folder).withColumn("status_updated_at", F.col("requested_at")))), path)
    back = spark.read.option("sep", ";").option("header", True).option("lineSep", "\r\n").csv(path)
    first = back.columns[0]
    return back.withColumnRenamed(first, first.lstrip("﻿")).fillna("", ["ID obiskovalca"]).select(*CSV_COLUMNS)


def attempts(spark, folder):
    return (
        table(spark, folder, "events")
        .select(
            F.col("event_id").alias("attempt_id"),
            F.col("ts").alias("attempted_at"),
            F.concat(F.lit("192.0.2."), (F.col("user_id") % 25).cast("string")).alias("ip_address"),
            F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("username"),
            (F.col("event_type") != "error").alias("successful"),
        )
    )


@query(
    "a14_failed_logins",
    """WITH a AS (SELECT event_id AS attempt_id, ts, user_id % 25 AS ip, user_id % 7 AS usr, event_type <> 'error' AS ok FROM events)
    SELECT a.attempt_id, count(b.attempt_id) AS failures, count(b.attempt_id) >= 5 AS blocked FROM a
    LEFT JOIN a b ON NOT b.ok AND b.attempt_id <> a.attempt_id AND (b.ip = a.ip OR b.usr = a.usr) AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 15 MINUTE
    GROUP BY 1""",
)
def a14_failed_logins(spark, folder):
    return R.failed_logins(attempts(spark, folder)).select("attempt_id", "failures", "blocked")
