"""Request log: ingest columns, filter, summary, groups, retention, consent."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from landsift.functions import agent as A
from landsift.functions import text as T

# Domains and labels of the request log.
STATUS_VALUES = ["queued", "running", "completed", "failed"]
GROUP_BY_VALUES = ["none", "visitor", "technical", "ip", "parcel", "device", "day", "status"]
STATUS_LABELS = {"queued": "V čakalni vrsti", "running": "V teku", "completed": "Zaključeno", "failed": "Napaka"}
DEVICE_LABELS = {
    "desktop": "Namizni računalnik",
    "mobile": "Telefon",
    "tablet": "Tablica",
    "bot": "Robot",
    "unknown": "Neznana naprava",
}
GROUP_LABELS = {
    "visitor": "ID obiskovalca",
    "technical": "Tehnična skupina",
    "ip": "IP naslov",
    "parcel": "Parcela",
    "device": "Naprava",
    "day": "Dan",
    "status": "Stanje",
}
VISITOR_LABEL = "Obiskovalec "
NO_VISITOR_LABEL = "Posamezna zahteva brez analitičnega ID"
MAX_GROUPS = 500
MAX_PAGE = 500
RETENTION_DAYS = 30


def _fields(text: str) -> ST.StructType:
    return ST.StructType.fromDDL(text)


def requests_schema() -> ST.StructType:
    """The 28 columns of the request log."""
    return _fields(
        "request_id string, job_id string, requested_at timestamp_ntz, parcel_reference string, status string,"
        " status_updated_at timestamp_ntz, ip_address string, visitor_id string, technical_group string,"
        " device_type string, browser_family string, os_family string, user_agent string, accept_language string,"
        " referer_host string, analytics_consent boolean, consent_version string, openai_usage_synced boolean,"
        " openai_configured boolean, openai_model string, openai_calls bigint, openai_input_tokens bigint,"
        " openai_output_tokens bigint, openai_total_tokens bigint, openai_rate_limit_tokens bigint,"
        " openai_rate_limit_remaining_tokens bigint, openai_rate_limit_reset string, openai_failures bigint"
    )


# Defaults of the columns added later.
ADDED_DEFAULTS = {
    "openai_usage_synced": False,
    "openai_configured": False,
    "openai_calls": 0,
    "openai_input_tokens": 0,
    "openai_output_tokens": 0,
    "openai_total_tokens": 0,
    "openai_failures": 0,
}


def conform_requests(df: DataFrame) -> DataFrame:
    """All columns of the log in order; columns an older table lacks get their defaults."""
    schema = requests_schema()
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing).fillna(ADDED_DEFAULTS).select(*[F.col(f.name).cast(f.dataType) for f in schema])


def append_requests(df: DataFrame, path: str) -> None:
    """Appends to the log, one folder per day, so that retention drops whole folders."""
    day = F.date_format("requested_at", "yyyy-MM-dd")
    conform_requests(df).withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def apply_consent(df: DataFrame, version: str) -> DataFrame:
    """The visitor id stays only with consent to the current version."""
    given = F.coalesce(F.col("analytics_consent") & (F.col("consent_version") == version), F.lit(False))
    return df.withColumns(
        {
            "visitor_id": F.when(given, F.col("visitor_id")),
            "consent_version": F.when(given, F.col("consent_version")),
            "analytics_consent": given,
        }
    )


def enrich_requests(raw: DataFrame, secret: str, ipv6: bool = True) -> DataFrame:
    """Derived columns of a raw request; everything but IPv6 text stays in the JVM."""
    return (
        raw.withColumn("ip_address", A.normalise_ip(F.col("ip_address"), ipv6))
        .withColumns(
            {
                "device_type": A.device_type(F.col("user_agent")),
                "browser_family": A.browser_family(F.col("user_agent")),
                "os_family": A.os_family(F.col("user_agent")),
                "referer_host": A.referer_host(F.col("referer")),
                "technical_group": A.technical_group(secret, F.col("ip_address"), F.coalesce("user_agent", F.lit(""))),
            }
        )
        .drop("referer")
    )


@dataclass(frozen=True)
class RequestFilters:
    date_from: str | None = None
    date_to: str | None = None
    parcel: str | None = None
    ip_address: str | None = None
    device_type: str | None = None
    status: str | None = None
    visitor: str | None = None


def day_bound(text: str, end: bool) -> dt.datetime:
    """A bare date is the whole day; text that is no date sets no bound."""
    text = text.strip()[:40]
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return dt.datetime(9999, 12, 31, 23, 59, 59) if end else dt.datetime(1, 1, 1)
    if len(text) == 10:
        return dt.datetime.combine(moment.date(), dt.time.max if end else dt.time.min)
    return moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def day_bounds(c: Column, end: bool) -> Column:
    """The same rule for a column of texts."""
    text = F.substring(F.trim(c), 1, 40)
    tail = "T23:59:59.999999" if end else "T00:00:00"
    moment = F.when(F.length(text) == 10, F.concat(text, F.lit(tail))).otherwise(F.regexp_replace(text, "Z$", "+00:00"))
    far = "9999-12-31T23:59:59" if end else "0001-01-01T00:00:00"
    parsed = F.coalesce(moment.try_cast("timestamp").cast("timestamp_ntz"), F.lit(far).cast("timestamp_ntz"))
    return parsed


def _like(c: str, text: str, limit: int) -> Column:
    return F.col(c).ilike("%" + text.strip()[:limit] + "%")


def filter_requests(df: DataFrame, f: RequestFilters) -> DataFrame:
    """Filters that reach the scan: bounds as plain comparisons, the rest as LIKE or equality.

    As in the log's own search, ``%`` and ``_`` in a text are wildcards."""
    if f.date_from:
        df = df.filter(F.col("requested_at") >= F.lit(day_bound(f.date_from, False)).cast("timestamp_ntz"))
    if f.date_to:
        df = df.filter(F.col("requested_at") <= F.lit(day_bound(f.date_to, True)).cast("timestamp_ntz"))
    if f.parcel:
        df = df.filter(_like("parcel_reference", f.parcel, 80))
    if f.ip_address:
        df = df.filter(_like("ip_address", f.ip_address, 64))
    if f.device_type:
        df = df.filter(F.col("device_type") == f.device_type[:30])
    if f.status in STATUS_VALUES:
        df = df.filter(F.col("status") == f.status)
    if f.visitor:
        df = df.filter(
            _like("visitor_id", f.visitor, 128) | _like("technical_group", f.visitor, 128) | _like("request_id", f.visitor, 128)
        )
    return df


def request_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("requests"),
        F.countDistinct("ip_address").alias("unique_ips"),
        F.countDistinct(T.blank_to_null(F.col("visitor_id"))).alias("consented_visitors"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("queued", "running")).alias("active"),
    )


def group_key(by: str) -> tuple[Column, Column]:
    """Key and label of the request groups."""
    visitor = T.blank_to_null(F.col("visitor_id"))
    if by == "visitor":
        key = F.coalesce(visitor, F.concat(F.lit("request:"), F.col("request_id")))
        name = F.coalesce(F.concat(F.lit(VISITOR_LABEL), F.substring(visitor, 1, 8)), F.lit(NO_VISITOR_LABEL))
        return key, name
    if by == "device":
        name = F.concat_ws(
            " · ",
            T.label(F.col("device_type"), DEVICE_LABELS),
            A.technical_label(F.col("browser_family")),
            A.technical_label(F.col("os_family")),
        )
        return name, name
    if by == "status":
        return F.col("status"), T.label(F.col("status"), STATUS_LABELS)
    if by == "day":
        day = F.date_format("requested_at", "yyyy-MM-dd")
        return day, day
    column = F.col({"technical": "technical_group", "ip": "ip_address", "parcel": "parcel_reference"}[by])
    return column, column


def request_groups(df: DataFrame, by: str = "visitor", limit: int | None = MAX_GROUPS) -> DataFrame:
    """Requests, different addresses and last time per group; the largest 500 groups.

    Addresses are reduced per (group, address) first, so a group that holds a third of
    the log is counted from its different addresses, on many tasks."""
    by = by if by in GROUP_BY_VALUES else "visitor"
    schema = "key string, label string, request_count bigint, unique_ips bigint, last_request timestamp_ntz"
    if by == "none":
        return df.sparkSession.createDataFrame([], schema)
    key, name = group_key(by)
    groups = (
        df.groupBy(key.alias("key"), name.alias("label"), "ip_address")
        .agg(F.count("*").alias("n"), F.max("requested_at").alias("last"))
        .groupBy("key", "label")
        .agg(
            F.sum("n").alias("request_count"),
            F.count("*").alias("unique_ips"),
            F.max("last").alias("last_request"),
        )
    )
    if limit is None:
        return groups
    return groups.orderBy(F.desc("request_count"), F.desc("last_request"), "key").limit(limit)


#: Rows that may be sorted for one page, and buckets of a histogram.
PAGE_ROWS, PAGE_BUCKETS = 50_000, 1024


def page_range(df: DataFrame, offset: int, limit: int) -> tuple[Column | None, int]:
    """A filter on the time that holds the page, and the page's offset behind it.

    Counts of equal time buckets, at most ``PAGE_BUCKETS`` rows a pass, tell in which the page
    lies, newest first; only those are cut finer, until few rows or one instant are left."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("requested_at").cast("timestamp_ntz"))
    at = F.coalesce(micros, F.lit(-(1 << 62)))  # rows without a time come last
    low, high, n = df.agg(F.min(at), F.max(at), F.count("*")).first()
    held = None
    while n > PAGE_ROWS and low < high and offset < n:
        width = -(-(high - low + 1) // PAGE_BUCKETS)
        rows = df if held is None else df.filter(held)
        bucket = F.floor((at - F.lit(low)) / width) if width < 1 << 40 else F.floor(at.cast("decimal(38,0)") / width - F.lit(low).cast("decimal(38,0)") / width)
        counts = rows.groupBy(bucket.cast("long").alias("b")).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect()
        counts.sort(key=lambda r: -r["high"])
        before, kept, rest = 0, [], offset
        for r in counts:
            if before + r["n"] <= offset:
                rest = offset - before - r["n"]
            elif before < offset + limit:
                kept.append(r)
            before += r["n"]
        fewer = sum(r["n"] for r in kept)
        low, high = min(r["low"] for r in kept), max(r["high"] for r in kept)
        held, offset = at.between(F.lit(low), F.lit(high)), rest
        if fewer == n:
            break
        n = fewer
    return held, offset


def request_page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the log, newest first; of a deep one only the rows around it are sorted."""
    offset, limit = max(0, offset), max(1, min(limit, MAX_PAGE))
    if offset + limit > PAGE_ROWS:
        held, offset = page_range(df, offset, limit)
        df = df if held is None else df.filter(held)
    ordered = df.orderBy(F.desc("requested_at"), F.desc("request_id"))
    return ordered.offset(offset).limit(limit)


def forget_visitors(df: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Requests stay, without visitor and consent. ``withdrawn``: distinct visitor ids."""
    gone = withdrawn.select("visitor_id").distinct().withColumn("gone", F.lit(True))
    return (
        df.join(gone, "visitor_id", "left")
        .withColumns(
            {
                "analytics_consent": F.when(F.col("gone"), False).otherwise(F.col("analytics_consent")),
                "consent_version": F.when(F.col("gone").isNull(), F.col("consent_version")),
                "visitor_id": F.when(F.col("gone").isNull(), F.col("visitor_id")),
            }
        )
        .drop("gone")
    )


def purge(df: DataFrame, column: str, now: dt.datetime, days: int, inclusive: bool = False) -> DataFrame:
    """Rows within the retention; ``inclusive`` also drops rows exactly at the cutoff."""
    cutoff = F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz")
    return df.filter(F.col(column) > cutoff if inclusive else F.col(column) >= cutoff)


def failed_logins(attempts: DataFrame, minutes: int = 15, max_attempts: int = 5) -> DataFrame:
    """For every attempt: failed ones of the same address or user in the window before it.

    Counted as address + user - both, so nothing is paired with anything. A failure adds one
    at its instant and takes it away just after the window's length, so each count is a
    running sum, linear in the attempts of a key. Names and addresses are trimmed and folded
    in case, names cut to 128 characters. The window length and the limit keep to their bounds."""
    minutes, max_attempts = max(5, min(minutes, 60)), max(3, min(max_attempts, 20))
    from pyspark.sql import Window

    span = minutes * 60 * 1_000_000
    failed = F.when(F.coalesce("successful", F.lit(False)), 0).otherwise(1)
    # an attempt counts in its own slice of time and in the next one, so a window never reaches
    # beyond its slice and a busy address is spread over many tasks
    slice_of = F.floor(F.col("_t") / span)
    marks = [F.struct((slice_of + k).alias("slice"), (F.col("_t") + at).alias("at"), (F.col("_failed") * sign).alias("n"), F.lit(k == 0 and at == 0).alias("asks"))
             for k in (0, 1) for at, sign in ((0, 1), (span + 1, -1))]

    def trailing(*keys):
        w = Window.partitionBy(*keys, "_m.slice").orderBy("_m.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_m.n").over(w)

    return (
        attempts.withColumns({
            "_t": F.unix_micros(F.col("attempted_at").cast("timestamp")), "_failed": failed,
            "_ip": F.lower(F.trim("ip_address")), "_name": F.substring(F.lower(F.trim("username")), 1, 128),
        })
        .withColumn("_m", F.explode(F.array(*marks)))
        .withColumns({"_a": trailing("_ip"), "_u": trailing("_name"), "_b": trailing("_ip", "_name")})
        .filter("_m.asks")
        # attempts at the same instant count only if they came before: own row is left out
        .withColumn("failures", F.col("_a") + F.col("_u") - F.col("_b") - F.col("_failed"))
        .withColumn("blocked", F.col("failures") >= max_attempts)
        .drop("_t", "_failed", "_ip", "_name", "_m", "_a", "_u", "_b")
    )
