"""Join of two sets of boxes on overlap.

Every box belongs to the grid level whose cells are just larger than the box, so
it touches at most four cells. Two boxes meet at the coarser of their two levels:
each side is exploded to its own level and to those coarser levels that the other
side uses. A pair is kept only in the cell holding the lower-left corner of the
overlap, so no distinct is needed. Cells are never much larger than the larger
box of a pair, so the number of candidates follows the number of results.

A first pass counts the rows per grid level (at most 13 levels a side), a second one those
per cell; both read only the boxes and run when the join is built. A cell with more than
``BLOCK`` rows of a side is dealt into blocks: its rows on the one side meet those on the
other block by block, so that no task holds more than a block of pairs at a time however
dense a place is. The number of partitions follows the pairs to be tried, not the bytes
read: small files of dense boxes would otherwise be worked on by one task. Neither side is
ever broadcast, as files do not tell how large their rows are. The smallest cell is a
parameter in the unit of the coordinates.

``best_join`` is for callers that keep only the best pair of each left box and group: it
leaves out right boxes that another one of their group beats wherever they are met.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.session import materialise

BOX = ["x0", "y0", "x1", "y1"]
#: Smallest cells: 16 m, and about as much in degrees.
METRE_CELL, DEGREE_CELL = 16.0, 0.00015
LEVEL_FACTOR = 4.0
TOP_LEVEL = 12
#: Rows of one side of a cell that are met at a time.
BLOCK = 2048
#: Levels below its own down to which a box of ``best_join`` is cut into cells.
FINER = 2
#: Cells a right box is then reckoned to touch.
CUT = 200
#: Rows a task reads, pairs it tries, and the most tasks of a join.
TASK_ROWS, TASK_PAIRS, MOST_TASKS = 20_000, 500_000, 4_000


def _with_level(df: DataFrame, margin: Column | None, smallest: float) -> DataFrame:
    """Adds the grown box and its grid level; rows without a box drop out.

    The grown sides are made non-null, so that no null check of them, with all it is
    computed from, is pushed into the scan."""
    df = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in BOX))
    zero = F.lit(0.0)
    if margin is None:
        grown = {f"_{c}": F.coalesce(c, zero) for c in BOX}
    else:
        df = df.withColumn("_margin", F.coalesce(margin, zero))
        low, high = F.col("_margin") * -1, F.col("_margin")
        grown = {f"_{c}": F.coalesce(F.col(c) + (low if c.endswith("0") else high), zero) for c in BOX}
    extent = F.expr(f"greatest(_x1 - _x0, _y1 - _y0, double({smallest}))")
    level = F.ceil(F.log(LEVEL_FACTOR, extent / smallest)).cast("int")
    return df.withColumns(grown).drop("_margin").withColumn("_level", F.least(level, F.lit(TOP_LEVEL)))


def _level_counts(left: DataFrame, right: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """Rows per grid level on both sides: one pass, at most 2 x 13 rows come back."""
    both = left.select(F.lit(0).alias("side"), "_level").unionAll(
        right.select(F.lit(1).alias("side"), "_level")
    )
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for side, level, n in both.groupBy("side", "_level").count().collect():
        counts[side][level] = n
    return counts


def _cells(df: DataFrame, other_levels: list[int], smallest: float) -> DataFrame:
    """One row per cell the box touches, on the levels where partners can be."""
    levels = ", ".join(str(v) for v in other_levels)
    lowest = other_levels[0] if other_levels else TOP_LEVEL + 1
    size = f"(double({smallest}) * power({LEVEL_FACTOR}D, l))"
    cells = f"""
        flatten(transform(
            filter(array_union(array(_level), array({levels})), l -> l > _level or (l = _level and {lowest} <= l)),
            l -> flatten(transform(
                sequence(floor(_x0 / {size}), floor(_x1 / {size})),
                cx -> transform(
                    sequence(floor(_y0 / {size}), floor(_y1 / {size})),
                    cy -> struct(l as l, cx as cx, cy as cy))))))
    """
    # the outer form: the inner one would add a filter that works the cells out twice
    return df.withColumn("_cell", F.explode_outer(F.expr(cells)))


def _tasks(rows: int, pairs: int = 0) -> int:
    return max(1, min(MOST_TASKS, -(-rows // TASK_ROWS) + -(-pairs // TASK_PAIRS)))


def _cell_counts(l_cells: DataFrame, r_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides per cell where both have some: ``keys, _ln, _rn``."""
    both = l_cells.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        r_cells.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = both.groupBy(*keys).agg(F.sum("l").alias("_ln"), F.sum("r").alias("_rn"))
    return materialise(counts.filter("_ln > 0 AND _rn > 0"), "box-cells")


def _in_blocks(cells: DataFrame, crowded: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Each row once per block of the other side of its cell: ``_l_block, _r_block`` number the pair of blocks."""
    told = cells.join(F.broadcast(crowded), keys, "left")
    # by what the row holds, so that a task that runs again deals it into the same block
    plain = [c for c, kind in cells.dtypes if c not in keys and not kind.startswith(("map", "array", "struct"))]
    mine = F.pmod(F.xxhash64(*plain), F.ceil(F.coalesce(own, F.lit(1)) / BLOCK)).cast("int")
    theirs = F.sequence(F.lit(0), F.ceil(F.coalesce(other, F.lit(1)) / BLOCK).cast("int") - 1)
    here, there = ("_l_block", "_r_block") if own == "_ln" else ("_r_block", "_l_block")
    # numbers of their own, not a struct: one that may be null on a side would be shuffled again
    return told.withColumn(here, mine).withColumn(there, F.explode(theirs)).drop("_ln", "_rn")


def box_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = (),
    margin: float | Column = 0.0,
    smallest_cell: float = METRE_CELL,
) -> DataFrame:
    """Pairs whose boxes touch or overlap after growing the right box by ``margin``.

    Both sides carry ``x0, y0, x1, y1``; ``margin`` may be a column of the right
    side. The right box comes back as ``r_x0 .. r_y1``; further columns of the two
    sides must differ, apart from ``on``.
    """
    on = list(on)
    clash = (set(left.columns) & set(right.columns)) - set(BOX) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if not isinstance(margin, Column):
        margin = F.lit(float(margin)) if margin else None
    l_side = _with_level(left, None, smallest_cell)
    r_side = _with_level(right, margin, smallest_cell)
    l_levels, r_levels = _level_counts(l_side, r_side)
    # dealt out before they are multiplied: a small file is one task
    l_side = l_side.repartition(_tasks(sum(l_levels.values())))
    r_side = r_side.repartition(_tasks(sum(r_levels.values())))
    l_cells = _cells(l_side, sorted(r_levels), smallest_cell)
    r_cells = _cells(r_side, sorted(l_levels), smallest_cell)
    # per row: a power per pair would cost more than the rest of the test
    l_cells = l_cells.withColumn("_size", smallest_cell * F.power(F.lit(LEVEL_FACTOR), F.col("_cell.l")))
    size = F.col("_size")
    corner_x = F.greatest("_x0", "_rx0")
    corner_y = F.greatest("_y0", "_ry0")
    once = (
        (F.greatest("_level", "_rlevel") == F.col("_cell.l"))
        & (F.floor(corner_x / size) == F.col("_cell.cx"))
        & (F.floor(corner_y / size) == F.col("_cell.cy"))
    )
    return _pairs(l_cells, r_cells, on, once).select(*_kept(left, right, on))


def _kept(left: DataFrame, right: DataFrame, on: list[str]) -> list[str]:
    return left.columns + [f"r_{c}" if c in BOX else c for c in right.columns if c not in on]


def _pairs(l_cells: DataFrame, r_cells: DataFrame, on: list[str], once: Column) -> DataFrame:
    """Pairs of one cell whose boxes meet; ``once`` names the one cell in which a pair counts."""
    keys = [*on, "_cell"]
    counts = _cell_counts(l_cells, r_cells, keys)
    rows, tried, most = counts.agg(
        F.sum(F.col("_ln") + F.col("_rn")), F.sum(F.col("_ln") * F.col("_rn")), F.max(F.greatest("_ln", "_rn"))
    ).first()
    if (most or 0) > BLOCK:
        # at most one of BLOCK rows is the first of a crowded cell
        crowded = counts.filter(F.greatest("_ln", "_rn") > BLOCK)
        l_cells = _in_blocks(l_cells, crowded, keys, "_ln", "_rn")
        r_cells = _in_blocks(r_cells, crowded, keys, "_rn", "_ln")
        keys = [*keys, "_l_block", "_r_block"]
    tasks = _tasks(rows or 0, tried or 0)
    r_cells = r_cells.withColumnsRenamed(
        {c: f"r_{c}" for c in BOX}
        | {"_x0": "_rx0", "_y0": "_ry0", "_x1": "_rx1", "_y1": "_ry1", "_level": "_rlevel"}
    )
    l_cells, r_cells = l_cells.repartition(tasks, *keys), r_cells.repartition(tasks, *keys)
    return l_cells.join(r_cells.hint("merge"), keys).filter(
        (F.col("_x0") <= F.col("_rx1"))
        & (F.col("_rx0") <= F.col("_x1"))
        & (F.col("_y0") <= F.col("_ry1"))
        & (F.col("_ry0") <= F.col("_y1"))
        & once
    )


def _levels(levels: list[int], meeting: str) -> str:
    """Levels at which a box meets those of the other side, as an array expression."""
    return f"array_distinct(transform(array({', '.join(str(v) for v in levels)}), o -> int({meeting})))"


def _leaders(cells: DataFrame, on: list[str], group: list[str], smallest: float) -> DataFrame:
    """Rows of a cell that may be the best of their group for some left box of the cell.

    A left box of the cell lies within the cell grown by one cell. There, of right boxes that
    look alike (same level, same part of the place) the first by ``_rank`` stands for all, and
    none counts that comes after one which covers the whole place."""
    size = f"(double({smallest}) * power({LEVEL_FACTOR}D, _cell.l))"
    # a hundredth of a cell more, so that no rounding of sizes or cell numbers matters
    low, high = ({c: F.expr(f"(_cell.c{c} {ends}) * {size}") for c in "xy"} for ends in ("- 0.01D", "+ 2.01D"))
    part = {f"_p{c}{n}": f(f"_{c}{n}", edge[c]) for c in "xy" for n, f, edge in ((0, F.greatest, low), (1, F.least, high))}
    whole = F.lit(True)
    for c in "xy":
        whole = whole & (F.col(f"_p{c}0") == low[c]) & (F.col(f"_p{c}1") == high[c])
    same = [*on, "_cell", *group]
    alike = Window.partitionBy(*same, "_level", *part).orderBy("_rank")
    # dealt by the smaller key, which serves both windows
    cells = cells.withColumns(part).repartition(*same)
    first = cells.withColumn("_n", F.row_number().over(alike)).filter("_n = 1").withColumn("_whole", whole)
    best = F.min(F.when(F.col("_whole"), F.col("_rank"))).over(Window.partitionBy(*same))
    return (
        first.withColumn("_best", best)
        .filter(F.col("_best").isNull() | (F.col("_rank") <= F.col("_best")))
        .drop("_n", "_whole", "_best", "_rank", *part)
    )


def best_join(
    left: DataFrame,
    right: DataFrame,
    group: Sequence[str],
    rank: Column,
    on: Sequence[str] = (),
    smallest_cell: float = METRE_CELL,
) -> DataFrame:
    """Pairs of ``box_join`` among which is, for every left box and ``group`` (columns of the
    right side), one of lowest ``rank`` (not null) of all right boxes that touch it, and of
    all whose overlap with it exceeds any given area.

    The others may be missing, so that the pairs follow the groups a box meets and not the
    number of right boxes that lie on each other. A left box stands in the one cell of its
    lower-left corner; a right box is cut into the cells of at least the left box's level and
    of at most ``FINER`` levels below its own, a few hundred at most.
    """
    on, group = list(on), [c for c in group if c not in on]
    clash = (set(left.columns) & set(right.columns)) - set(BOX) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    ranked = right.withColumn("_rank", rank)
    rest = [c for c in right.columns if c not in (*on, *group, *BOX)]
    # boxes that are equal: the first stands for all, before they are multiplied
    ranked = (
        ranked.groupBy(*on, *group, *BOX)
        .agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), "_rank").alias("_row"), F.min("_rank").alias("_rank"))
        .select(*on, *group, *BOX, *[F.col(f"_row.{c}").alias(c) for c in rest], "_rank")
    )
    l_side = _with_level(left, None, smallest_cell)
    r_side = materialise(_with_level(ranked, None, smallest_cell), "box-ranked")
    l_counts, r_counts = _level_counts(l_side, r_side)
    l_levels, r_levels = sorted(l_counts), sorted(r_counts)
    if not l_levels or not r_levels:
        return box_join(left, right.limit(0), on, smallest_cell=smallest_cell)
    l_side = l_side.repartition(_tasks(sum(l_counts.values())))
    r_side = r_side.repartition(_tasks(CUT * sum(r_counts.values())))
    size = f"(double({smallest_cell}) * power({LEVEL_FACTOR}D, l))"
    l_cells = l_side.withColumn(
        "_cell",
        F.explode_outer(
            F.expr(
                f"transform({_levels(r_levels, f'greatest(_level, o - {FINER})')},"
                f" l -> struct(l as l, floor(_x0 / {size}) as cx, floor(_y0 / {size}) as cy))"
            )
        ),
    )
    across = [f"sequence(floor(_{c}0 / {size} - 0.01D) - 1, floor(_{c}1 / {size}))" for c in "xy"]
    r_cells = r_side.withColumn(
        "_cell",
        F.explode_outer(
            F.expr(
                f"flatten(transform({_levels(l_levels, f'greatest(o, _level - {FINER})')}, l -> flatten(transform({across[0]},"
                f" cx -> transform({across[1]}, cy -> struct(l as l, cx as cx, cy as cy))))))"
            )
        ),
    )
    r_cells = materialise(_leaders(r_cells, on, group, smallest_cell), "box-leaders").select(
        *right.columns, "_x0", "_y0", "_x1", "_y1", "_level", "_cell"
    )
    once = F.greatest(F.col("_level"), F.col("_rlevel") - FINER) == F.col("_cell.l")
    return _pairs(l_cells, r_cells, on, once).select(*_kept(left, right, on))
