"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import small, written


def numbered(df: DataFrame, groups: list[str], order: list[str], more: dict | None = None) -> DataFrame:
    """``df`` with ``i`` (place of the row in its group by ``order``, from 0) and ``n`` (rows
    of the group), as a written table's rows.

    The rows are dealt by ranges of group, order and their place in the input, so that neither
    a hot group nor equal rows meet in one task; nulls come first, and rows equal in ``order``
    keep the order of the input's splits. Only one row per group and range is summed up by
    group. ``groups`` must hold no nulls. ``more`` are columns made for the order alone.
    """
    keys = [*groups, *order, "_row"]
    dealt = df.withColumns({"_row": F.monotonically_increasing_id(), **(more or {})}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(dealt.drop("_row", *(more or ())).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    held = Window.partitionBy(*groups)
    pieces = rows.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    pieces = pieces.select(
        "_part",
        *groups,
        (F.sum("_rows").over(held.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(held).alias("n"),
    )
    pieces = small(written(pieces, "pieces"))
    return rows.join(pieces, ["_part", *groups]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
