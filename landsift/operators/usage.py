"""Job documents, their state in the request log, and the model usage report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.functions import text as T
from landsift.operators.traffic import RETENTION_DAYS, STATUS_VALUES

# Fixed value: how the warning of a failed summary begins.
FAILURE_PREFIX = "Povzetka z umetno inteligenco ni bilo mogoče pripraviti"
NO_MODEL = "Ni modela"
RECENT = 100
# Numbers are read as text, so that a bad one counts 0 and does not spoil its document.
JOB_SCHEMA = """id string, status string, updated_at string, created_at string, progress string, from_cache string,
  result struct<openai_usage: struct<configured: string, model: string, calls: string, input_tokens: string, output_tokens: string,
    total_tokens: string, rate_limit_tokens: string, rate_limit_remaining_tokens: string, rate_limit_reset: string>,
  documents: array<struct<extraction_warnings: array<string>>>>"""


def parse_jobs(texts: DataFrame, column: str = "value") -> DataFrame:
    """Job documents from JSON texts; unreadable ones and unknown statuses drop out."""
    job = F.from_json(F.col(column), JOB_SCHEMA, {"mode": "PERMISSIVE"})
    return (
        # a generator keeps the filters from parsing the text again
        texts.select(F.inline(F.array(job)))
        .filter(F.col("status").isin(STATUS_VALUES) & F.col("updated_at").isNotNull())
        .withColumn("updated_at", F.col("updated_at").try_cast("timestamp").cast("timestamp_ntz"))
        .filter(F.col("updated_at").isNotNull())
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return parse_jobs(spark.read.text(path, wholetext=True))


def failure_count(result: Column) -> Column:
    """Nested warnings that begin with the failure text."""
    warnings = F.flatten(F.transform(result["documents"], lambda d: d["extraction_warnings"]))
    hits = F.filter(warnings, lambda w: w.startswith(FAILURE_PREFIX))
    return F.coalesce(F.nullif(F.size(hits), F.lit(-1)), F.lit(0)).cast("bigint")


def _flag(c: Column) -> Column:
    return F.coalesce(~F.lower(c).isin("", "0", "false", "null", "none"), F.lit(False))


def sync_job_state(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests brought up to their job documents.

    Only open or not yet synced requests can change; a document counts if it is newer,
    or if it is final and not yet synced. A cached result adds no usage and no failure."""
    cached = _flag(F.col("from_cache"))
    used = F.col("result.openai_usage")

    def number(field):
        return F.when(cached, F.lit(0).cast("bigint")).otherwise(T.nonnegative(used[field]))

    def optional(field):
        return F.when(~cached, T.optional_nonnegative(used[field]))

    def short(field):
        return F.when(~cached, T.blank_to_null(F.substring(used[field], 1, 100)))

    fresh = F.struct(
        F.col("status").alias("status"),
        F.col("updated_at").alias("status_updated_at"),
        F.col("status").isin("completed", "failed").alias("openai_usage_synced"),
        (~cached & _flag(used["configured"])).alias("openai_configured"),
        short("model").alias("openai_model"),
        number("calls").alias("openai_calls"),
        number("input_tokens").alias("openai_input_tokens"),
        number("output_tokens").alias("openai_output_tokens"),
        number("total_tokens").alias("openai_total_tokens"),
        optional("rate_limit_tokens").alias("openai_rate_limit_tokens"),
        optional("rate_limit_remaining_tokens").alias("openai_rate_limit_remaining_tokens"),
        short("rate_limit_reset").alias("openai_rate_limit_reset"),
        F.when(cached, F.lit(0).cast("bigint")).otherwise(failure_count(F.col("result"))).alias("openai_failures"),
    )
    latest = jobs.groupBy(F.col("id").alias("job_id")).agg(F.max_by(fresh, "updated_at").alias("fresh"))
    open_ = F.col("status").isin("queued", "running") | ~F.col("openai_usage_synced")
    newer = F.col("fresh.status_updated_at") > F.col("status_updated_at")
    final = F.col("fresh.openai_usage_synced") & ~F.col("openai_usage_synced")
    change = F.coalesce(open_ & (newer | final), F.lit(False))
    fields = [f.name for f in latest.schema["fresh"].dataType]
    out = requests.join(latest.hint("merge"), "job_id", "left").withColumn("_change", change)
    return out.withColumns(
        {c: F.when(F.col("_change"), F.col(f"fresh.{c}")).otherwise(F.col(c)) for c in fields}
    ).drop("fresh", "_change")


def usage_rows(requests: DataFrame, days: int, now: dt.datetime, retention: int = RETENTION_DAYS) -> DataFrame:
    """Completed and synced requests of the period; the period keeps to 1..retention days."""
    period = max(1, min(int(days), retention))
    first = dt.datetime.combine((now - dt.timedelta(days=period - 1)).date(), dt.time.min)
    return requests.filter(
        (F.col("status") == "completed")
        & F.col("openai_usage_synced")
        & (F.col("requested_at") >= F.lit(first).cast("timestamp_ntz"))
    )


def usage_report(requests: DataFrame, days: int, now: dt.datetime, retention: int = RETENTION_DAYS) -> DataFrame:
    """Totals, days and models in one pass over the log (section, key, counts).

    ``analyses`` counts all rows of a day and of the total, but only rows with calls
    of a model. The total also carries the latest rate limit seen."""
    rows = usage_rows(requests, days, now, retention).select(
        F.date_format("requested_at", "yyyy-MM-dd").alias("day"),
        F.coalesce(T.blank_to_null(F.col("openai_model")), F.lit(NO_MODEL)).alias("model"),
        "requested_at",
        "status_updated_at",
        "openai_configured",
        *[F.col(f"openai_{c}").alias(c) for c in ("calls", "input_tokens", "output_tokens", "total_tokens", "failures",
                                                  "rate_limit_tokens", "rate_limit_remaining_tokens", "rate_limit_reset")],
    )
    known = F.col("rate_limit_tokens").isNotNull()
    limit = F.struct(
        F.col("rate_limit_tokens").alias("limit_tokens"),
        F.col("rate_limit_remaining_tokens").alias("remaining_tokens"),
        F.col("rate_limit_reset").alias("reset"),
        F.col("status_updated_at").alias("observed_at"),
    )
    sums = [F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "total_tokens", "failures")]
    grouped = rows.groupingSets([[], [F.col("day")], [F.col("model")]], F.col("day"), F.col("model")).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("all_rows"),
        F.count_if(F.col("openai_configured")).alias("configured_analyses"),
        F.count_if(F.col("calls") > 0).alias("ai_analyses"),
        *sums,
        F.max_by(limit, F.when(known, F.col("requested_at"))).alias("limit"),
    )
    model_row = F.col("gid") == 2
    whole = F.col("gid") == 3
    return grouped.select(
        F.when(whole, "summary").when(model_row, "model").otherwise("day").alias("section"),
        F.coalesce("day", "model", F.lit("")).alias("key"),
        F.when(model_row, F.col("ai_analyses")).otherwise(F.col("all_rows")).alias("analyses"),
        "configured_analyses",
        "ai_analyses",
        "calls",
        "input_tokens",
        "output_tokens",
        "total_tokens",
        "failures",
        F.when(whole, F.col("limit.limit_tokens")).alias("limit_tokens"),
        F.when(whole, F.col("limit.remaining_tokens")).alias("remaining_tokens"),
        F.when(whole, F.col("limit.reset")).alias("reset"),
        F.when(whole, F.col("limit.observed_at")).alias("observed_at"),
    )


def order_usage(report: DataFrame) -> DataFrame:
    """Days ascending, models by tokens."""
    tokens = F.when(F.col("section") == "model", -F.col("total_tokens")).otherwise(0)
    return report.orderBy("section", tokens, "key")


def recent_usage(requests: DataFrame, days: int, now: dt.datetime, retention: int = RETENTION_DAYS) -> DataFrame:
    """The 100 most recent analyses of the period."""
    rows = usage_rows(requests, days, now, retention)
    return rows.orderBy(F.desc("requested_at"), F.desc("job_id")).limit(RECENT)
