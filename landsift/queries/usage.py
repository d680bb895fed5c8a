"""Jobs and model usage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from landsift.functions import text as T
from landsift.operators import traffic as R
from landsift.operators import usage as U
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.requests import log
from landsift.session import table

NOW = dt.datetime(2024, 1, 30, 12)


def job_texts(spark, folder):
    """One JSON text per job; some unreadable, some with an unknown status."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(e % 97 == 0, "odd").otherwise(X.pick(["running", "completed", "completed", "completed", "failed"], "event_id % 5"))
    usage = F.struct(
        (e % 4 > 0).alias("configured"),
        X.pick(X.MODELS, "event_id % 3").alias("model"),
        (e % 4).alias("calls"),
        (k * 10).alias("input_tokens"),
        k.alias("output_tokens"),
        F.when(e % 50 == 7, F.lit("many")).otherwise((k * 11).cast("string")).alias("total_tokens"),
        F.when(e % 6 == 0, F.lit(1000)).alias("rate_limit_tokens"),
        (F.lit(5) - e % 9).alias("rate_limit_remaining_tokens"),
    )
    bad = F.concat(F.lit(U.FAILURE_PREFIX), F.lit(" (X)"))
    documents = F.array(
        F.struct(F.array(bad, F.lit("drugo")).alias("extraction_warnings")),
        F.struct(F.when(e % 2 == 0, F.array(bad)).otherwise(F.expr("cast(array() as array<string>)")).alias("extraction_warnings")),
    )
    job = F.struct(
        F.md5(e.cast("string")).alias("id"),
        status.alias("status"),
        F.date_format(F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 3 - 1 as int))"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_at"),
        (e % 10 == 0).alias("from_cache"),
        F.when(e % 13 != 0, F.struct(usage.alias("openai_usage"), documents.alias("documents"))).alias("result"),
    )
    text = F.to_json(job)
    return table(spark, folder, "events").select(F.when(e % 101 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


JOBS = f"""jobs AS (
    SELECT *, CASE WHEN cached OR NOT has THEN 0 ELSE 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END AS failures,
      NOT cached AND has AS uses FROM (
      SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS job_id, {X.sql_pick(["running", "completed", "completed", "completed", "failed"], "event_id % 5")} AS job_status,
        ts + (event_id % 3 - 1) * INTERVAL 1 MINUTE AS updated_at, event_id % 10 = 0 AS cached, event_id % 13 <> 0 AS has,
        CAST(props->>'k' AS BIGINT) AS jk, {X.sql_pick(X.MODELS, "event_id % 3")} AS model FROM events
      WHERE event_id % 97 <> 0 AND event_id % 101 <> 0))"""


@query("s5_read_jobs", f"WITH {JOBS} SELECT job_id AS id, job_status AS status, updated_at, failures AS all_failures FROM (SELECT * REPLACE (CASE WHEN NOT has THEN 0 ELSE 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END AS failures) FROM jobs)")
def s5_read_jobs(spark, folder):
    jobs = U.parse_jobs(job_texts(spark, folder))
    return jobs.select("id", "status", "updated_at", U.failure_count(F.col("result")).alias("all_failures"))


@query("a17_failure_count", f"WITH {JOBS} SELECT job_status AS status, CAST(sum(CASE WHEN NOT has THEN 0 ELSE 1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END) AS BIGINT) AS failures FROM jobs GROUP BY 1")
def a17_failure_count(spark, folder):
    return U.parse_jobs(job_texts(spark, folder)).groupBy("status").agg(F.sum(U.failure_count(F.col("result"))).alias("failures"))


def requests_in(spark, folder):
    base = log(spark, folder).withColumn("status_updated_at", F.col("requested_at"))
    number = F.substring("request_id", 2, 20).cast("bigint")
    return R.conform_requests(base.withColumn("openai_usage_synced", number % 4 == 0))


def synced(spark, folder):
    return U.sync_job_state(requests_in(spark, folder), U.parse_jobs(job_texts(spark, folder)))


SYNCED = f"""{JOBS}, synced AS (
    SELECT request_id, r.job_id, requested_at, parcel_reference,
      CASE WHEN ch THEN job_status ELSE status END AS status, CASE WHEN ch THEN updated_at ELSE requested_at END AS status_updated_at,
      CASE WHEN ch THEN job_status IN ('completed', 'failed') ELSE is_synced END AS openai_usage_synced,
      coalesce(ch AND uses AND event_id % 4 > 0, false) AS openai_configured, CASE WHEN ch AND uses THEN model END AS openai_model,
      CASE WHEN ch AND uses THEN event_id % 4 ELSE 0 END AS openai_calls, CASE WHEN ch AND uses THEN jk * 10 ELSE 0 END AS openai_input_tokens,
      CASE WHEN ch AND uses THEN jk ELSE 0 END AS openai_output_tokens, CASE WHEN ch AND uses AND event_id % 50 <> 7 THEN jk * 11 ELSE 0 END AS openai_total_tokens,
      CASE WHEN ch AND uses AND event_id % 6 = 0 THEN 1000 END AS limit_tokens, CASE WHEN ch AND uses THEN greatest(0, 5 - event_id % 9) END AS remaining,
      CASE WHEN ch THEN failures ELSE 0 END AS openai_failures
    FROM (SELECT r.* EXCLUDE (event_id), j.* EXCLUDE (job_id), coalesce((status IN ('queued', 'running') OR NOT is_synced)
        AND (updated_at > requested_at OR (job_status IN ('completed', 'failed') AND NOT is_synced)), false) AS ch
      FROM (SELECT *, event_id % 4 = 0 AS is_synced FROM requests) r LEFT JOIN jobs j USING (job_id)) r)"""


@query("j18_sync_job_state", X.ctes("requests") + f", {SYNCED} SELECT request_id, status, status_updated_at, openai_usage_synced, openai_model, openai_calls, openai_total_tokens, openai_failures FROM synced")
def j18_sync_job_state(spark, folder):
    return synced(spark, folder).select(
        "request_id", "status", "status_updated_at", "openai_usage_synced", "openai_model", "openai_calls", "openai_total_tokens", "openai_failures"
    )


IN_PERIOD = "FROM synced WHERE status = 'completed' AND openai_usage_synced AND requested_at >= TIMESTAMP '2024-01-11'"
SUMS = """count(*) FILTER (WHERE openai_configured) AS configured_analyses, count(*) FILTER (WHERE openai_calls > 0) AS ai_analyses,
  CAST(sum(openai_calls) AS BIGINT) AS calls, CAST(sum(openai_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(openai_output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(openai_total_tokens) AS BIGINT) AS total_tokens, CAST(sum(openai_failures) AS BIGINT) AS failures"""


@query(
    "a12_usage_report",
    X.ctes("requests")
    + f""", {SYNCED}
    SELECT 'summary' AS section, '' AS key, count(*) AS analyses, {SUMS}, arg_max(limit_tokens, requested_at) FILTER (WHERE limit_tokens IS NOT NULL) AS limit_tokens,
      arg_max(remaining, requested_at) FILTER (WHERE limit_tokens IS NOT NULL) AS remaining_tokens,
      arg_max(status_updated_at, requested_at) FILTER (WHERE limit_tokens IS NOT NULL) AS observed_at {IN_PERIOD}
    UNION ALL SELECT 'day', strftime(requested_at, '%Y-%m-%d'), count(*), {SUMS}, NULL, NULL, NULL {IN_PERIOD} GROUP BY 2
    UNION ALL SELECT 'model', coalesce(openai_model, 'Ni modela'), count(*) FILTER (WHERE openai_calls > 0), {SUMS}, NULL, NULL, NULL {IN_PERIOD} GROUP BY 2""",
)
def a12_usage_report(spark, folder):
    return U.usage_report(synced(spark, folder), 20, NOW).drop("reset")


@query("a12_recent_usage", X.ctes("requests") + f", {SYNCED} SELECT requested_at, job_id, openai_calls, openai_total_tokens {IN_PERIOD} ORDER BY requested_at DESC, job_id DESC LIMIT 100")
def a12_recent_usage(spark, folder):
    return U.recent_usage(synced(spark, folder), 20, NOW).select("requested_at", "job_id", "openai_calls", "openai_total_tokens")


@query(
    "w14_latest_observation",
    X.ctes("requests") + f", {SYNCED} SELECT parcel_reference, arg_max(status, requested_at) AS status, max(requested_at) AS requested_at FROM synced GROUP BY 1",
)
def w14_latest_observation(spark, folder):
    return synced(spark, folder).groupBy("parcel_reference").agg(
        F.max_by("status", "requested_at").alias("status"), F.max("requested_at").alias("requested_at")
    )


@query("x40_coercion", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE greatest(0, CAST(user_id - 40 AS BIGINT)) END AS n FROM events")
def x40_coercion(spark, folder):
    raw = F.when(F.col("event_id") % 7 == 0, "x1").otherwise((F.col("user_id") - 40).cast("string"))
    return table(spark, folder, "events").select("event_id", T.nonnegative(raw).alias("n"))
