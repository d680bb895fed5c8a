"""Structured Streaming forms of the continuously running behaviours."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from landsift.operators import traffic as R
from landsift.operators.snapshot import KeyedSnapshot
from landsift.session import new_folder


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: ST.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Everything available now into a table of the shared folder; resumes after a failure.

    With the path of an earlier run it goes on from there."""
    spark = stream.sparkSession
    path = path or new_folder(spark, name)
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    q.awaitTermination()
    schema = ST.StructType([ST.StructField(f.name, f.dataType) for f in stream.schema])
    return spark.read.schema(schema).parquet(path)


#: Time of the row that ends a stream: later than any window of its data.
END = dt.datetime(9999, 1, 1)


def run_to_end(stream: DataFrame, last: dict, plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``plan`` over a stream that ends, with its last windows.

    Once everything available is answered, a row of ``last`` (null elsewhere) follows in a
    second run of the same query, from the same checkpoint. It must carry ``END`` as its
    time: the watermark passes all windows but the one of that row, which never comes out."""
    spark = stream.sparkSession
    path, ending = new_folder(spark, name), new_folder(spark, f"{name}-end")
    schema = ST.StructType([ST.StructField(f.name, f.dataType) for f in stream.schema])
    spark.createDataFrame([], schema).write.parquet(ending)
    whole = plan(stream.unionByName(spark.readStream.schema(schema).parquet(ending)))
    run_to_table(whole, name, path=path)
    spark.createDataFrame([tuple(last.get(f.name) for f in schema)], schema).coalesce(1).write.mode("append").parquet(ending)
    return run_to_table(whole, name, path=path)


def ingest_requests(stream: DataFrame, secret: str, consent_version: str, delay: str = "1 hour", ipv6: bool = True) -> DataFrame:
    """Request ingest: one row per job id, derived columns, consent applied.

    ``event_time`` carries the watermark; ids are remembered only within the delay."""
    marked = stream.withColumn("event_time", F.col("requested_at").cast("timestamp")).withWatermark("event_time", delay)
    unique = marked.dropDuplicatesWithinWatermark(["job_id"])
    return R.enrich_requests(R.apply_consent(unique, consent_version), secret, ipv6).drop("event_time")


def latest_status(rows: DataFrame) -> DataFrame:
    """One row per job: the final state if there is one, else the latest; progress never falls."""
    final = F.col("status").isin("completed", "failed")
    newest = F.max_by(F.struct("status", "updated_at"), F.struct(final, "updated_at"))
    shown = F.max(F.when(F.col("status") == "completed", 100).otherwise(F.least(F.lit(99), F.col("progress"))))
    return rows.groupBy("job_id").agg(newest.alias("s"), shown.alias("progress")).select("job_id", "s.*", "progress")


def follow_status(stream: DataFrame, name: str = "job-status") -> DataFrame:
    """Job states kept up to date in a keyed snapshot: a batch rewrites the buckets of its jobs.

    A version is named by its batch, so a batch that runs again changes nothing."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    schema = ST.StructType.fromDDL("job_id string, status string, updated_at timestamp_ntz, progress bigint")
    snapshot = KeyedSnapshot(spark, path, "job_id", schema, latest_status)

    def merge(batch: DataFrame, number: int) -> None:
        snapshot.apply(batch.withColumn("progress", F.col("progress").cast("bigint")), number)

    q = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return snapshot.read()


def failed_login_windows(stream: DataFrame, minutes: int = 15, max_attempts: int = 5, delay: str = "1 hour") -> DataFrame:
    """Failed attempts per address in sliding windows of a minute's step, and whether the limit is met."""
    minutes, max_attempts = max(5, min(minutes, 60)), max(3, min(max_attempts, 20))
    failed = stream.filter(~F.col("successful")).withColumn("event_time", F.col("attempted_at").cast("timestamp"))
    counts = (
        failed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", f"{minutes} minutes", "1 minute").alias("w"), "ip_address")
        .agg(F.count("*").alias("failures"))
    )
    return counts.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "ip_address", "failures", (F.col("failures") >= max_attempts).alias("blocked")
    )


def daily_traffic(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests per day and status; a day comes out once it is over by the delay."""
    marked = stream.withColumn("event_time", F.col("requested_at").cast("timestamp")).withWatermark("event_time", delay)
    counts = marked.groupBy(F.window("event_time", "1 day").alias("w"), "status").agg(F.count("*").alias("requests"))
    return counts.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "status", "requests")


def retained(stream: DataFrame, column: str, days: int) -> DataFrame:
    """Rows later than the retention behind the newest vanish: the watermark is the retention."""
    marked = stream.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark("event_time", f"{days} days")
    # a stateful step is what makes the watermark drop late rows
    return marked.dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")


def forget(stream: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Events without those of visitors who withdrew (a static table of ids)."""
    return stream.join(withdrawn.select("visitor_id").distinct(), "visitor_id", "left_anti")
