"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench; a cluster passes its own session instead."""
    builder = SparkSession.builder.appName("landsift")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.driver.memory", "12g"
        )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch one only in a local session (tests).

    On a cluster every executor would write to a disk of its own, so an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _SCRATCH.setdefault(app, _SCRATCH.get(app) or tempfile.mkdtemp(prefix="landsift-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over tasks of about ``rows`` rows: a small file, or one with a single row group, is
    one task however much work a row brings. For tables, whose rows are counted from the files."""
    return df.repartition(max(1, -(-df.count() // rows)))
