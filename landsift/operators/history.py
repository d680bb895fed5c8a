"""Keyed snapshots, reuse of results, recent searches, progress, supplementary sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsift.functions import text as T
from landsift.operators.scan import running

# Result retention, recent searches, supplementary sources.
RESULT_DAYS = 7
RECENT_DAYS, RECENT_COUNT = 30, 10
SOURCE_DAYS, SOURCE_CHARACTERS = 7, 1000


def upsert(current: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows replace or join the current ones; of several for one key the last by ``order``."""
    whole = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (key, "_new")]
    return whole.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("r")).select(key, "r.*")


def cache_rows(results: DataFrame) -> DataFrame:
    """Results keyed for reuse, with their expiry. ``results``: ``parcel_reference, stored_at``."""
    return results.withColumns(
        {
            "cache_key": T.cache_key(F.col("parcel_reference")),
            "parcel_reference": T.normalise_reference(F.col("parcel_reference")),
            "expires_at": F.col("stored_at") + F.expr(f"interval {RESULT_DAYS} days"),
        }
    )


def reuse_results(incoming: DataFrame, snapshot: DataFrame, now: dt.datetime) -> DataFrame:
    """Incoming references with the result they can reuse, or marked to be worked out.

    ``incoming``: ``parcel_reference, force_refresh``; a result is gone at its expiry."""
    fresh = snapshot.filter(F.col("expires_at") > F.lit(now).cast("timestamp_ntz")).select("cache_key", "stored_at")
    asked = incoming.withColumn("cache_key", T.cache_key(F.col("parcel_reference")))
    hit = F.col("stored_at").isNotNull() & ~F.coalesce("force_refresh", F.lit(False))
    return asked.join(fresh, "cache_key", "left").select(
        *asked.columns, hit.alias("reused"), F.when(hit, F.col("stored_at")).alias("stored_at")
    )


def recent_searches(searches: DataFrame, now: dt.datetime) -> DataFrame:
    """The ten latest different references of each visitor within 30 days."""
    since = F.lit(now - dt.timedelta(days=RECENT_DAYS)).cast("timestamp_ntz")
    last = (
        searches.filter(F.col("searched_at") >= since)
        .groupBy("visitor_id", "parcel_reference")
        .agg(F.max("searched_at").alias("searched_at"))
    )
    w = Window.partitionBy("visitor_id").orderBy(F.desc("searched_at"), "parcel_reference")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= RECENT_COUNT)


def progress_curve(steps: DataFrame) -> DataFrame:
    """Progress that never falls and stays below 100 until the job is completed.

    ``steps``: ``job_id, at, progress, status``."""
    steps = running(steps, ["job_id"], ["at"], {"_most": ("max", F.least(F.lit(99), F.col("progress")))})
    return steps.withColumn("shown", F.when(F.col("status") == "completed", 100).otherwise(F.col("_most"))).drop("_most")


def select_supplementary_sources(parcels: DataFrame, versions: DataFrame, pages: DataFrame, now: dt.datetime) -> DataFrame:
    """Municipal documents for the parcels of a municipality: the latest readable copy,
    marked stale after seven days, if it holds at least 1,000 characters of text.

    ``versions``: ``municipality, source_id, version, fetched_at, readable``;
    ``pages``: ``source_id, version, text``."""
    row = F.struct("version", "fetched_at")
    latest = (
        versions.filter("readable")
        .groupBy(T.fold(F.col("municipality")).alias("_m"), "source_id")
        .agg(F.max_by(row, F.struct("fetched_at", "version")).alias("v"))
        .select("_m", "source_id", "v.*")
    )
    enough = (
        pages.groupBy("source_id", "version")
        .agg(F.sum(F.length(T.squeeze_ends(F.col("text")))).alias("characters"))
        .filter(F.col("characters") >= SOURCE_CHARACTERS)
    )
    limit = F.lit(now - dt.timedelta(days=SOURCE_DAYS)).cast("timestamp_ntz")
    usable = latest.join(enough, ["source_id", "version"]).withColumn("stale", F.col("fetched_at") <= limit)
    towns = parcels.withColumn("_m", T.fold(F.col("municipality")))
    return towns.join(usable, "_m").drop("_m")
