"""What several operators of this part share: words, files in the shared folder, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a table may be sent to every executor.
BROADCAST_ROWS = 10_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names.

    Only a local session may go without that setting (tests): it then gets a folder under
    the warehouse, which driver and tasks of one process share.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Session setting by which Spark drops the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    Nothing goes back behind the table, so the shuffle files of the write are dropped with it.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables; whatever was made from them must be written itself by now."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it was counted to have at most ``rows`` rows.

    Beyond that it comes back as it is, and the join shuffles both sides. ``df`` should be
    a written table, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, "[\\x20\\x09-\\x0D]+")
    )


def n_words(text: Column) -> Column:
    """How many words a text has, as a long, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")
