"""Merkle manifest of documents: trees of eight per language, their roots under one root.

Per level, one window of blocks of neighbours gives every node its seven neighbours on either
side by lag and lead of fixed offsets; slot (place in the run of eight) and run length (the
last run may be short) mask those that belong to other runs. The first child of a run hashes
the parent from itself and its leads, and only first children go on to the next level. The
blocks are much smaller than a language, so no language meets in one task. On the way down
parents hand their path (slot and siblings per level) to their children by an equi-join.

Defined results: null columns count as ``-``; leaves with equal or null doc_id (nulls first)
keep the input's order; repeated rows are leaves of their own; a null doc_id is never tampered
with; empty texts are values of zero bytes; further columns are ignored, whatever their names;
an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import written
from landsift.llm.order import numbered

FAN = 8
#: Neighbours in one window: a multiple of the run.
BLOCK = 8 * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    """SHA-256 of the parts that are not null, in lowercase hex."""
    return F.sha2(F.concat_ws("", *parts), 256)


def _value(value: Column) -> Column:
    """UTF-8 byte count, colon and value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``g`` (the language, so written that null comes first), ``node`` (the leaf)
    and ``altered`` (the leaf of the tampered text where doc_id is tampered with, else null)."""
    at = {c: F.col(f"`{c}`") for c in FIELDS}
    lower = {**at, "text": F.translate(at["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    chosen = F.crc32(at["doc_id"].cast("string").cast("binary")) % 3 == 0
    return docs.select(
        at["doc_id"].alias("doc_id"),
        F.coalesce(F.concat(F.lit("1"), at["lang"]), F.lit("0")).alias("g"),
        _hash(*[_value(c) for c in at.values()]).alias("node"),
        F.when(chosen, _hash(*[_value(c) for c in lower.values()])).alias("altered"),
    )


def _level(nodes: DataFrame) -> DataFrame:
    """Nodes with ``slot``, ``siblings`` and, on first children, ``parent``."""
    place = Window.partitionBy("g", F.floor(F.col("i") / BLOCK)).orderBy("i")
    slot = F.col("i") % FAN
    run = F.least(F.lit(FAN), F.col("n") - F.col("i") + slot)
    before = [F.when(slot >= k, F.lag("node", k).over(place)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("node", k).over(place)) for k in range(1, FAN)]
    return nodes.withColumns(
        {
            "slot": slot.cast("int"),
            "siblings": F.concat_ws("", *before, *after),
            "parent": F.when((slot == 0) & (F.col("n") > 1), _hash(F.col("node"), *after)),
        }
    )


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees of ``nodes`` (g, i, n, node), lowest first, and one row per tree:
    ``g``, ``level`` and ``top``. A tree ends where one node remains."""
    found = [written(_level(nodes), "merkle-level")]
    tops, most = None, found[0].agg(F.max("n")).first()[0] or 0
    while True:
        level = found[-1]
        top = level.filter("n = 1").select("g", F.lit(len(found) - 1).alias("level"), F.col("node").alias("top"))
        tops = top if tops is None else tops.unionByName(top)
        if most <= 1:
            return found, written(tops, "merkle-tops")
        most = -(-most // FAN)
        up = level.filter("parent IS NOT NULL").select(
            "g", F.expr(f"i div {FAN}").alias("i"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("parent").alias("node")
        )
        found.append(written(_level(up), "merkle-level"))


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with ``path``: slot and siblings of each level up to the root.

    ``tops`` gives each tree the path above it (``above``); its other columns are handed down.
    """
    handed = [c for c in tops.columns if c not in ("g", "level", "above")]
    path = None
    for k in range(len(levels) - 1, -1, -1):
        up = tops.filter(F.col("level") == k).select("g", F.lit(0).cast("long").alias("up"), "above", *handed)
        if path is not None:
            up = up.unionByName(path.select("g", F.col("i").alias("up"), F.col("path").alias("above"), *handed))
        step = F.when(F.col("n") > 1, F.array(F.struct("slot", "siblings"))).otherwise(F.array().cast("array<struct<slot:int,siblings:string>>"))
        rows = levels[k].withColumn("up", F.expr(f"i div {FAN}")).join(up, ["g", "up"])
        path = rows.withColumn("path", F.concat(step, "above")).drop("up", "above", "siblings", "slot", "parent")
    return path


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, and what its tampered leaf folds to."""
    levels, tops = grow(numbered(leaves(docs), ["g"], ["doc_id"]))
    langs, whole = grow(numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("top").alias("node")), ["g"], ["lang"]))
    none = F.array().cast("array<struct<slot:int,siblings:string>>")
    above = descend(langs, whole.withColumn("above", none))
    above = written(above.select(F.col("lang").alias("g"), F.col("node").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("above")), "merkle-langs")
    rows = descend(levels, tops.drop("top").join(above, "g"))
    folded = F.expr(
        "aggregate(path, coalesce(altered, node), (h, x) -> "
        "sha2(concat(substr(x.siblings, 1, 64 * x.slot), h, substr(x.siblings, 64 * x.slot + 1)), 256))"
    )
    return rows.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        _hash(F.array_join("path.siblings", "")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
