"""Streams over the event table, run with everything available now."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from landsift.operators import traffic as R
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.requests import BASE, SECRET
from landsift.session import table
from landsift.streaming import streams as S


def events(spark, folder):
    return S.read_stream(spark, folder, "events.parquet", table(spark, folder, "events").schema)


def requests(spark, folder):
    """The request fixture over the stream of events."""
    return X.requests_of(events(spark, folder))


@query(
    "t1_ingest_requests",
    BASE + " SELECT request_id, job_id, visitor_id, device_type, technical_group, referer_host, requested_at FROM log",
)
def t1_ingest_requests(spark, folder):
    stream = requests(spark, folder)
    # every request comes twice; one of them must go
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = S.run_to_table(S.ingest_requests(twice, SECRET, "2026-01", ipv6=False), "requests")
    return out.select("request_id", "job_id", "visitor_id", "device_type", "technical_group", "referer_host", "requested_at")


@query(
    "t2_follow_status",
    """WITH s AS (SELECT 'j' || user_id AS job_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS status,
      ts, CAST(props->>'k' AS BIGINT) AS p FROM events)
    SELECT job_id, arg_max(status, (status IN ('completed', 'failed'), ts)) AS status, arg_max(ts, (status IN ('completed', 'failed'), ts)) AS updated_at,
      max(CASE WHEN status = 'completed' THEN 100 ELSE least(99, p) END) AS progress FROM s GROUP BY 1""",
)
def t2_follow_status(spark, folder):
    status = F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("queued")
    steps = events(spark, folder).select(
        F.concat(F.lit("j"), F.col("user_id")).alias("job_id"), status.alias("status"), F.col("ts").alias("updated_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("progress"),
    )
    return S.follow_status(steps)


@query(
    "t3_failed_login_windows",
    """WITH f AS (SELECT date_trunc('minute', ts) AS m, '192.0.2.' || (user_id % 25) AS ip_address FROM events WHERE event_type = 'error')
    SELECT window_start, ip_address, count(*) AS failures, count(*) >= 3 AS blocked FROM (SELECT m - CAST(i AS INT) * INTERVAL 1 MINUTE AS window_start, ip_address FROM f, (SELECT unnest(range(15)) AS i)) GROUP BY 1, 2""",
)
def t3_failed_login_windows(spark, folder):
    attempts = events(spark, folder).select(
        F.col("ts").alias("attempted_at"), F.concat(F.lit("192.0.2."), F.col("user_id") % 25).alias("ip_address"), (F.col("event_type") != "error").alias("successful")
    )
    last = {"attempted_at": S.END, "successful": False}
    return S.run_to_end(attempts, last, lambda rows: S.failed_login_windows(rows, 15, 3), "logins")


NOW = dt.datetime(2024, 1, 31)


@query(
    "t4_retention",
    """SELECT 'logins' AS log, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-30'
    UNION ALL SELECT 'requests', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-01'
    UNION ALL SELECT 'events', count(*) FROM events
    UNION ALL SELECT 'results', count(*) FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31'
    UNION ALL SELECT 'jobs', count(*) FROM events WHERE NOT (event_type IN ('purchase', 'view') AND ts < TIMESTAMP '2024-01-11')""",
)
def t4_retention(spark, folder):
    e = table(spark, folder, "events")
    cutoff = F.lit(NOW - dt.timedelta(days=20)).cast("timestamp_ntz")
    finished = F.col("event_type").isin("purchase", "view")
    kept = {
        "logins": R.purge(e, "ts", NOW, 1),
        "requests": R.purge(e, "ts", NOW, 30),
        "events": R.purge(e, "ts", NOW, 90),
        # results expire exactly seven days after they were stored
        "results": R.purge(e, "ts", NOW, 7, inclusive=True),
        # only finished jobs are removed
        "jobs": e.filter(~(finished & (F.col("ts") < cutoff))),
    }
    out = None
    for name, df in kept.items():
        part = df.agg(F.lit(name).alias("log"), F.count("*").alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query("t5_late_records", "SELECT event_id, ts FROM events")
def t5_late_records(spark, folder):
    """Nothing of one batch is late; the test feeds a late file and sees it vanish."""
    return S.run_to_table(S.retained(events(spark, folder).select("event_id", "ts"), "ts", 90), "retained")


@query("t6_forget_events", "SELECT event_id, 'v' || user_id AS visitor_id FROM events WHERE user_id % 7 <> 0")
def t6_forget_events(spark, folder):
    stream = events(spark, folder).select("event_id", F.concat(F.lit("v"), F.col("user_id")).alias("visitor_id"))
    gone = table(spark, folder, "events").filter("user_id % 7 = 0").select(F.concat(F.lit("v"), F.col("user_id")).alias("visitor_id"))
    return S.run_to_table(S.forget(stream, gone), "kept").select("event_id", "visitor_id")


@query(
    "t6_forget_visitors",
    BASE + """ SELECT request_id, CASE WHEN user_id % 7 <> 0 THEN visitor_id END AS visitor_id,
    CASE WHEN user_id % 7 <> 0 OR visitor_id IS NULL THEN analytics_consent ELSE false END AS analytics_consent FROM log""",
)
def t6_forget_visitors(spark, folder):
    log = R.apply_consent(X.requests(spark, folder), "2026-01")
    gone = table(spark, folder, "events").filter("user_id % 7 = 0").select(F.concat(F.lit("visitor-"), F.col("user_id")).alias("visitor_id"))
    return R.forget_visitors(log, gone).select("request_id", "visitor_id", "analytics_consent")


@query(
    "t8_daily_traffic",
    X.ctes("requests") + """ SELECT strftime(requested_at, '%Y-%m-%d') AS day, status, count(*) AS requests FROM requests GROUP BY 1, 2""",
)
def t8_daily_traffic(spark, folder):
    return S.run_to_end(requests(spark, folder).select("requested_at", "status"), {"requested_at": S.END}, S.daily_traffic, "daily")
