"""Web analytics from raw events.

Definitions used here: a session ends after 30 minutes without an event of its user;
it is engaged with two events or 10 seconds; a user is new whose first event of all
lies in the period.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.functions import text as T

# Periods, the events that count, and labels.
PERIODS = (7, 30, 90)
CUSTOM_EVENTS = [
    "parcel_analysis_started",
    "parcel_analysis_completed",
    "parcel_analysis_failed",
    "result_tab_opened",
    "location_report_downloaded",
]
CHANNEL_LABELS = {
    "Direct": "Neposredno",
    "Organic Search": "Organsko iskanje",
    "Referral": "Povezave z drugih strani",
    "Organic Social": "Družbena omrežja",
    "Unassigned": "Nedoločeno",
}
DEVICE_LABELS = {"desktop": "Namizni računalnik", "mobile": "Telefon", "tablet": "Tablica"}
EVENT_LABELS = {
    "parcel_analysis_started": "Začete analize",
    "parcel_analysis_completed": "Zaključene analize",
    "parcel_analysis_failed": "Neuspele analize",
    "result_tab_opened": "Odprti zavihki rezultatov",
    "location_report_downloaded": "Prenesena poročila PDF",
}
COUNTRY_LABELS = {
    "Slovenia": "Slovenija",
    "Austria": "Avstrija",
    "Croatia": "Hrvaška",
    "Italy": "Italija",
    "Germany": "Nemčija",
    "Hungary": "Madžarska",
    "United States": "Združene države Amerike",
    "United Kingdom": "Združeno kraljestvo",
}
GAP = 30 * 60 * 1_000_000
ENGAGED = 10 * 1_000_000
PAGE_VIEW = "page_view"
DIMENSIONS = ["channel", "device", "country"]


def period_events(events: DataFrame, days: int, now: dt.datetime) -> DataFrame:
    if days not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    first = dt.datetime.combine((now - dt.timedelta(days=days - 1)).date(), dt.time.min)
    bound = lambda t: F.lit(t).cast("timestamp_ntz")
    return events.filter((F.col("ts") >= bound(first)) & (F.col("ts") <= bound(now)))


def sessions(events: DataFrame) -> DataFrame:
    """One row per session: user, dimensions, start, length, events.

    Events of one user in one half-hour slot always belong together, so they are added
    up before the shuffle; what is left of a busy user is bounded by time, not by events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = (
        events.withColumn("_t", micros)
        .groupBy("user_id", F.floor(F.col("_t") / GAP).alias("slot"))
        .agg(
            F.min("_t").alias("first"),
            F.max("_t").alias("last"),
            F.count("*").alias("n"),
            *[F.min_by(d, "_t").alias(d) for d in DIMENSIONS],
        )
    )
    w = Window.partitionBy("user_id").orderBy("slot")
    opens = F.coalesce(F.col("first") - F.lag("last").over(w) > GAP, F.lit(True))
    numbered = slots.withColumn("opens", opens).withColumn("session", F.sum(F.col("opens").cast("int")).over(w))
    return numbered.groupBy("user_id", "session").agg(
        F.min("first").alias("start"),
        (F.max("last") - F.min("first")).alias("length"),
        F.sum("n").alias("events"),
        *[F.min_by(d, "first").alias(d) for d in DIMENSIONS],
    )


def web_summary(events: DataFrame, days: int, now: dt.datetime) -> DataFrame:
    """One row: users, new users, sessions, page views, engaged sessions, mean length."""
    period = period_events(events, days, now)
    first_seen = events.groupBy("user_id").agg(F.min("ts").alias("ts"))
    new = period_events(first_seen, days, now).agg(F.count("*").alias("new_users"))
    views = period.agg(F.count_if(F.col("event_name") == PAGE_VIEW).alias("page_views"))
    per_session = sessions(period).agg(
        F.countDistinct("user_id").alias("total_users"),
        F.count("*").alias("sessions"),
        F.count_if((F.col("events") >= 2) | (F.col("length") >= ENGAGED)).alias("engaged_sessions"),
        F.coalesce(F.try_divide(F.sum("length"), F.count("*")) / 1e6, F.lit(0.0)).alias("average_session_duration"),
    )
    # three tables of exactly one row
    return per_session.join(new, F.lit(True)).join(views, F.lit(True))


def web_daily(events: DataFrame, days: int, now: dt.datetime) -> DataFrame:
    period = period_events(events, days, now)
    day = F.date_format("ts", "yyyy-MM-dd").alias("date")
    # users are reduced per day before they are counted
    active = (
        period.groupBy(day, "user_id")
        .agg(F.count_if(F.col("event_name") == PAGE_VIEW).alias("views"))
        .groupBy("date")
        .agg(F.count("*").alias("active_users"), F.sum("views").alias("page_views"))
    )
    started = sessions(period).groupBy(
        F.date_format(F.timestamp_micros("start").cast("timestamp_ntz"), "yyyy-MM-dd").alias("date")
    ).agg(F.count("*").alias("sessions"))
    return active.join(started, "date", "left").fillna(0, ["sessions"])


def web_dimension(events: DataFrame, days: int, now: dt.datetime, dimension: str, limit: int = 10) -> DataFrame:
    """Sessions and users per channel, device or country; the first ten."""
    per_user = (
        sessions(period_events(events, days, now)).groupBy(dimension, "user_id").agg(F.count("*").alias("n"))
    )
    out = per_user.groupBy(dimension).agg(F.sum("n").alias("sessions"), F.count("*").alias("total_users"))
    lead = "sessions" if dimension == "channel" else "total_users"
    return out.orderBy(F.desc(lead), dimension).limit(limit)


def custom_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_name").isin(CUSTOM_EVENTS))


def web_events(events: DataFrame, days: int, now: dt.datetime, limit: int = 20) -> DataFrame:
    counts = custom_events(period_events(events, days, now)).groupBy(F.col("event_name").alias("event"))
    return counts.agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "event").limit(limit)


def localise(df: DataFrame, column: str) -> DataFrame:
    labels = {"channel": CHANNEL_LABELS, "device": DEVICE_LABELS, "country": COUNTRY_LABELS, "event": EVENT_LABELS}
    return df.withColumn(column, T.label(F.col(column), labels[column]))


def report_rows(report: DataFrame) -> DataFrame:
    """Header and value arrays of a report to maps: ``dimensions`` and ``metrics``.

    ``report``: ``dimension_names, metric_names, dimension_values, metric_values`` arrays
    of text. Metrics that are no numbers count 0."""
    def number(v: Column) -> Column:
        return F.coalesce(v.try_cast("double"), F.lit(0.0))

    def zipped(names, values):
        shorter = F.least(F.size(names), F.size(values))
        return F.map_from_arrays(F.slice(names, 1, shorter), F.slice(values, 1, shorter))

    numbers = F.transform(F.col("metric_values"), number)
    return report.withColumns(
        {
            "dimensions": zipped(F.col("dimension_names"), F.col("dimension_values")),
            "metrics": zipped(F.col("metric_names"), numbers),
        }
    ).drop("dimension_names", "metric_names", "dimension_values", "metric_values")
