"""Mixing sources to target weights by hash-threshold histograms.

Sizes are counted in one pass over the texts and written; all else reads that narrow table.
Every document has a fixed hash: 36 bits of its key and, behind them, 24 bits of its text, so
that rows of one repeated or null key part by their texts. Per source, sizes are summed by
hash bucket; running sums find the bucket that crosses the budget, only that bucket is split
further, and after five levels of 4096 buckets at most, fewer where each such bucket holds
one row, the threshold is exact to one hash value. The mix is a filter on the hash: nothing is
sorted, a larger budget takes a superset, and reruns agree. Only where rows of equal key and
text lie across a budget are these numbered, and as many taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import n_words, small, written

#: Weights of the sources in order of their names.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
REPEATS = 3
#: Hexadecimal digits of the hash, from the key and from the text; three are refined at a time.
DIGITS, TEXT_DIGITS = 9, 6
BITS = 4 * (DIGITS + TEXT_DIGITS)
#: Times that what a budget leaves over is offered to documents that still fit it.
FILLS = 2


def hash_of(key: Column, text: Column) -> Column:
    """36 bits of the MD5 of a key as text, then 24 of the text's; null counts as empty."""
    first = lambda c, n: F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, n)
    return F.conv(F.concat(first(key, DIGITS), first(text, TEXT_DIGITS)), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size, target, repeats and budget, from documents' sizes.

    Sources in order of code points, null last, weigh ``weights`` in turn. Targets share the
    sum of all sizes by weight; one above ``REPEATS`` times its source's size stops there and
    the excess is shared again. That is a water level: in order of size / weight, a source
    stops if the level that the others would share exceeds its bound. All sums are whole
    numbers, so the target is one division. repeats: how often the whole source is taken;
    budget: words to take once more. Only one row per source meets in the windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), place).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sources = (
        sources.withColumn("bound", REPEATS * F.col("source_size"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("bound_before", F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_before", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    )
    left = F.col("all_words") - F.coalesce("bound_before", F.lit(0))
    weight_left = F.col("all_weight") - F.coalesce("weight_before", F.lit(0))
    sources = sources.withColumn("stops", F.col("bound") * weight_left < left * F.col("weight"))
    sources = sources.withColumn("den", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)).withColumn(
        "num", F.col("all_words") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("bound"))).over(everything), F.lit(0))
    )
    part = F.col("weight") * F.col("num")
    sources = sources.withColumn(
        "target", F.when(F.col("stops"), F.col("bound").cast("double")).otherwise(part / F.col("den"))
    ).withColumn("whole", F.when(F.col("stops"), F.col("bound")).otherwise(F.expr("weight * num div den")))
    repeats = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(F.lit(0))
    return sources.withColumn("repeats", repeats.cast("long")).select(
        "source",
        "source_size",
        "target",
        "repeats",
        (F.col("whole") - F.col("repeats") * F.col("source_size")).alias("budget"),
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash below which documents fit its budget, and the words left over.

    ``sizes``: source, h, size of the documents on offer; ``budgets``: source, budget. At
    each level only documents of the boundary bucket are summed, by source and bucket, with
    partial sums before the shuffle; at most 4096 rows per source meet in a window. fits: how
    many of the rows whose hash is the limit fit, too, where several share it; what they may
    take is no longer left.
    """
    state = budgets.select(
        "source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("limit"), F.lit(True).alias("open"),
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"),
    )
    for level in range(BITS // 12):
        shift = BITS - 12 * (level + 1)
        known = small(state.filter("open").select(F.col("source").alias("_s"), "limit"))
        at = F.shiftright("h", shift)
        inside = F.shiftright("h", shift + 12) == F.shiftright("limit", shift + 12)
        buckets = (
            sizes.join(known, F.col("source").eqNullSafe(F.col("_s")) & inside)
            .groupBy("source", at.alias("bucket"))
            .agg(F.sum("size").cast("long").alias("words"), F.count("*").alias("rows"), F.max("size").alias("largest"))
        )
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        crossed = (
            buckets.withColumn("run", run)
            .join(small(state.select(F.col("source").alias("_s"), "left")), F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("over", F.col("run") > F.col("left"))
            .groupBy(F.col("source").alias("_c"))
            .agg(
                F.min(F.when(F.col("over"), F.struct("bucket", "rows", "largest"))).alias("at"),
                F.coalesce(F.max(F.when(~F.col("over"), F.col("run"))), F.lit(0)).alias("used"),
            )
        )
        # only at the first level can all documents on offer fit; then there is no bound
        bound = F.coalesce(F.shiftleft(F.col("at.bucket"), shift), F.lit(1 << BITS))
        state = written(
            state.join(crossed, F.col("source").eqNullSafe(F.col("_c")), "left").select(
                "source",
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                F.when(F.col("open"), bound).otherwise(F.col("limit")).alias("limit"),
                (F.col("open") & F.col("at").isNotNull()).alias("open"),
                F.coalesce("at.rows", F.lit(0)).alias("n"),
                F.coalesce("at.largest", F.lit(0)).alias("most"),
            ),
            "mix-thresholds",
        )
        if state.filter("open AND n > 1").isEmpty():
            break
    fits = F.when(F.col("open") & (F.col("n") > 1), F.expr("left div most")).otherwise(F.lit(0)).cast("long")
    return state.withColumn("fits", fits).select("source", (F.col("left") - F.col("fits") * F.col("most")).alias("left"), "limit", "fits")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document.

    Null texts have size 0, a null source is a source of its own, an empty table gives no rows.
    Rows of a repeated or null key are taken apart by their texts; of rows with the same key
    and text as many are taken as fit, no matter which. Whole repeats come first; the rest
    of a target goes to documents below the threshold, then what is left over to documents
    that still fit it, by a threshold among these. A source that takes all of its documents
    again cannot leave a rest, as a budget is smaller than its source.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("h"))
    sizes = written(rows, "mix-sizes")
    return _decided(sizes, *_plan(sizes, weights)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def apply(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as it is taken, most not at all."""
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("h"),
    )
    sizes = written(named.select("source", "size", "h"), "mix-sizes")
    taken = _decided(named, *_plan(sizes, weights)).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).select("row.*")


def _plan(sizes: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """Targets and thresholds of the sources, from source, size and h of all documents."""
    targets = written(source_targets(sizes, weights), "mix-targets")
    rest = targets.select("source", "budget")
    limits: list[DataFrame] = []
    for _ in range(FILLS):
        offered = _marked(sizes, limits).filter("NOT again AND fits = 0").select("source", "h", "size")
        if limits:
            known = small(rest.withColumnRenamed("source", "_s"))
            offered = offered.join(known, F.col("source").eqNullSafe(F.col("_s"))).filter("size <= budget").select("source", "h", "size")
        found = thresholds(offered, rest)
        both = found.join(rest.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        limits.append(written(both.select("source", "limit", "budget", "fits"), "mix-limits"))
        rest = found.select("source", F.col("left").alias("budget"))
    return targets, limits


def _decided(rows: DataFrame, targets: DataFrame, limits: list[DataFrame]) -> DataFrame:
    """``rows`` with source_size, target and times, how often each is taken."""
    marked = _marked(rows, limits)
    if any(not limit.filter("fits > 0").isEmpty() for limit in limits):
        marked = marked.filter("fits = 0").unionByName(_first_of_equals(marked.filter("fits > 0")))
    whole = small(targets.drop("budget").withColumnRenamed("source", "_s"))
    joined = marked.join(whole, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # an empty document of a source at its bound fits any rest, but is not taken more often
    return joined.withColumn("times", F.least(F.col("repeats") + F.col("again").cast("long"), F.lit(REPEATS).cast("long")))


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again`` for the first ``fits`` of each source and hash.

    Rows are numbered within their part of a written table, and parts by what stands in those
    before: a window holds rows of one part, or one row per part.
    """
    rows = written(rows.withColumn("_r", F.monotonically_increasing_id()), "mix-equals").withColumn("_part", F.shiftright("_r", 33))
    parts = rows.groupBy("source", "h", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source", "h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    parts = small(written(parts.select(F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("_part").alias("_p"), before), "mix-parts"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")) & (F.col("_part") == F.col("_p"))
    place = F.row_number().over(Window.partitionBy("source", "h", "_part").orderBy("_r")) + F.col("_before")
    return rows.join(parts, same).withColumn("again", place <= F.col("fits")).drop("_r", "_part", "_s", "_h", "_p", "_before")


def _marked(sizes: DataFrame, limits: list[DataFrame]) -> DataFrame:
    """``sizes`` (with source, size, h) with ``again``: below a threshold at which it was on offer.

    fits is above 0 for rows at a threshold of which some fit, and says how many.
    """
    out = sizes
    again, fits = F.lit(False), F.lit(0).cast("long")
    for k, limit in enumerate(limits):
        names = [F.col("limit").alias(f"_l{k}"), F.col("budget").alias(f"_b{k}"), F.col("fits").alias(f"_f{k}")]
        mine = small(limit.select(F.col("source").alias("_s"), *names))
        out = out.join(mine, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        offered = (fits == 0) & (F.col("size") <= F.col(f"_b{k}")) if k else F.lit(True)
        below, equal = F.col("h") < F.col(f"_l{k}"), F.col("h") == F.col(f"_l{k}")
        again, fits = again | (offered & below), F.when(offered & equal & ~again, F.col(f"_f{k}")).otherwise(fits)
    return out.select(*sizes.columns, F.coalesce(again, F.lit(False)).alias("again"), F.coalesce(fits, F.lit(0)).alias("fits"))
