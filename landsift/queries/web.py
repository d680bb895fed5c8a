"""Web analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from landsift.operators import web as W
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.planning import sql_map
from landsift.session import table
from landsift.sources.exports import report_sections_long

NOW = dt.datetime(2024, 1, 31)
CHANNELS = list(W.CHANNEL_LABELS) + ["Paid"]
COUNTRIES = list(W.COUNTRY_LABELS) + ["France"]
NAMES = {"click": W.CUSTOM_EVENTS[0], "purchase": W.CUSTOM_EVENTS[1], "error": W.CUSTOM_EVENTS[2], "signup": W.CUSTOM_EVENTS[3], "view": W.PAGE_VIEW}


def events(spark, folder):
    from landsift.functions import text as T

    return table(spark, folder, "events").select(
        "user_id",
        "ts",
        T.label(F.col("event_type"), NAMES).alias("event_name"),
        X.pick(CHANNELS, "user_id % 6").alias("channel"),
        X.pick(list(W.DEVICE_LABELS), "user_id % 3").alias("device"),
        X.pick(COUNTRIES, "user_id % 9").alias("country"),
    )


BASE = f"""WITH ev AS (SELECT user_id, ts, {sql_map(NAMES, "event_type")} AS event_name, {X.sql_pick(CHANNELS, "user_id % 6")} AS channel,
      {X.sql_pick(list(W.DEVICE_LABELS), "user_id % 3")} AS device, {X.sql_pick(COUNTRIES, "user_id % 9")} AS country FROM events),
  period AS (SELECT *, epoch_us(ts) AS t FROM ev WHERE ts >= TIMESTAMP '2024-01-25' AND ts <= TIMESTAMP '2024-01-31'),
  marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM period),
  numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t) AS session FROM marked),
  sessions AS (SELECT user_id, session, min(t) AS start, max(t) - min(t) AS length, count(*) AS events,
      min(channel) AS channel, min(device) AS device, min(country) AS country FROM numbered GROUP BY 1, 2)"""


@query(
    "a13_web_summary",
    BASE
    + """ SELECT count(DISTINCT user_id) AS total_users, (SELECT count(*) FROM (SELECT min(ts) m FROM ev GROUP BY user_id) WHERE m >= TIMESTAMP '2024-01-25' AND m <= TIMESTAMP '2024-01-31') AS new_users,
    count(*) AS sessions, (SELECT count(*) FROM period WHERE event_name = 'page_view') AS page_views,
    count(*) FILTER (WHERE events >= 2 OR length >= 10000000) AS engaged_sessions, CAST(sum(length) AS DOUBLE) / count(*) / 1e6 AS average_session_duration FROM sessions""",
)
def a13_web_summary(spark, folder):
    return W.web_summary(events(spark, folder), 7, NOW)


@query(
    "a13_web_daily",
    BASE
    + """ SELECT strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT user_id) AS active_users, count(*) FILTER (WHERE event_name = 'page_view') AS page_views,
    coalesce(any_value(s.n), 0) AS sessions FROM period LEFT JOIN (SELECT strftime(make_timestamp(start), '%Y-%m-%d') AS d, count(*) AS n FROM sessions GROUP BY 1) s ON s.d = strftime(ts, '%Y-%m-%d') GROUP BY 1""",
)
def a13_web_daily(spark, folder):
    return W.web_daily(events(spark, folder), 7, NOW)


def _dimension(name, lead):
    @query(
        f"a13_web_{name}",
        BASE + f" SELECT {name}, count(*) AS sessions, count(DISTINCT user_id) AS total_users FROM sessions GROUP BY 1 ORDER BY {lead} DESC, 1 LIMIT 10",
    )
    def run(spark, folder):
        return W.web_dimension(events(spark, folder), 7, NOW, name)


_dimension("channel", "sessions")
_dimension("device", "total_users")
_dimension("country", "total_users")


@query("k7_web_events", BASE + " SELECT event_name AS event, count(*) AS event_count FROM period WHERE event_name <> 'page_view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def k7_web_events(spark, folder):
    return W.web_events(events(spark, folder), 7, NOW)


@query("f6_custom_events", BASE + " SELECT event_name, count(*) AS n FROM ev WHERE event_name <> 'page_view' GROUP BY 1")
def f6_custom_events(spark, folder):
    return W.custom_events(events(spark, folder)).groupBy("event_name").agg(F.count("*").alias("n"))


@query(
    "j19_labels",
    BASE + f" SELECT coalesce({sql_map(W.COUNTRY_LABELS, 'country')}, country) AS country, coalesce({sql_map(W.CHANNEL_LABELS, 'channel')}, channel) AS channel, count(*) AS n FROM ev GROUP BY ALL",
)
def j19_labels(spark, folder):
    out = W.localise(W.localise(events(spark, folder), "country"), "channel")
    return out.groupBy("country", "channel").agg(F.count("*").alias("n"))


@query(
    "x39_report_rows",
    "SELECT event_id, event_type AS d_type, CAST(user_id AS DOUBLE) AS m_users, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS m_value FROM events",
)
def x39_report_rows(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id",
        F.expr("array('type')").alias("dimension_names"),
        F.expr("array('users', 'value')").alias("metric_names"),
        F.array("event_type").alias("dimension_values"),
        F.array(F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("metric_values"),
    )
    out = W.report_rows(raw)
    return out.select("event_id", F.col("dimensions.type").alias("d_type"), F.col("metrics.users").alias("m_users"), F.col("metrics.value").alias("m_value"))


@query(
    "s12_report_sections",
    BASE
    + """, e AS (SELECT event_name AS event, count(*) AS event_count FROM period WHERE event_name <> 'page_view' GROUP BY 1),
    d AS (SELECT device, count(DISTINCT user_id) AS total_users FROM sessions GROUP BY 1)
    SELECT 'devices' AS section, device AS ord, 0 AS column_ord, 'device' AS "column", device AS value FROM d
    UNION ALL SELECT 'devices', device, 1, 'total_users', CAST(total_users AS VARCHAR) FROM d
    UNION ALL SELECT 'events', event, 0, 'event', event FROM e UNION ALL SELECT 'events', event, 1, 'event_count', CAST(event_count AS VARCHAR) FROM e""",
)
def s12_report_sections(spark, folder):
    ev = events(spark, folder)
    devices = W.web_dimension(ev, 7, NOW, "device").withColumn("ord", F.col("device"))
    counts = W.web_events(ev, 7, NOW).withColumn("ord", F.col("event"))
    long = report_sections_long({"devices": (devices, ["device", "total_users"]), "events": (counts, ["event", "event_count"])})
    return long.drop("section_ord")
