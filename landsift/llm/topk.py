"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard builds a tree
of median splits whose nodes keep tight bounding boxes. A query goes through a tree best
node first: the bound of a node is the largest inner product that its box allows, and the
search ends at the first bound that cannot beat the k-th score known so far. That score is
handed on: every query first searches one shard, its k-th score there prunes all others.
Queries and shards meet in blocks, so neither is ever held whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import written

#: Vectors of a shard, about; queries of a block; vectors of a leaf.
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF_ROWS = 64
#: Components are floor(SCALE * x).
SCALE = 1024
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component as double; null if one is null or not finite."""
    x = lambda v: v.cast("double")
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda v: _floor(x(v) * SCALE)))


def _floor(x: Column) -> Column:
    """floor as a double, also beyond the range of long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


class Tree:
    """A KD-tree over the rows of a matrix: median splits of the widest side, tight boxes."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._grow(rows, 0, len(rows), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, a: int, z: int, leaf: int) -> int:
        mine = rows[self.order[a:z]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        node = len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, z))
        self.children.append(())
        axis = int(np.argmax(high - low))
        if z - a > leaf and high[axis] > low[axis]:
            middle = (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(mine[:, axis], middle)]
            self.children[node] = (self._grow(rows, a, a + middle, leaf), self._grow(rows, a + middle, z, leaf))
        return node

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """For each node the largest inner product that its box allows."""
        return np.maximum(self.low * query, self.high * query).sum(axis=1)


def search(tree: Tree, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int | None, k: int, floor: float) -> list[tuple[float, int]]:
    """The k best (score, id) of a shard, of those that can reach ``floor``; ties to smaller ids.

    Nodes are taken best bound first; a bound below the k-th score ends the search.
    """
    bound = tree.bounds(query)
    best: list[tuple[float, int]] = []  # (score, -id), the worst on top
    queue = [(-bound[0], 0)]
    while queue:
        top, node = heapq.heappop(queue)
        if -top < (best[0][0] if len(best) == k else floor):
            break
        if tree.children[node]:
            for child in tree.children[node]:
                heapq.heappush(queue, (-bound[child], child))
            continue
        a, z = tree.span[node]
        at = tree.order[a:z]
        scores = rows[at] @ query
        least = best[0][0] if len(best) == k else floor
        for i in np.flatnonzero(scores >= least).tolist():
            item = (float(scores[i]), -int(ids[at[i]]))
            if own is not None and -item[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _whole_scores(vectors: list[list[float]], ids: list[int], query: list[float], own, k: int) -> list[tuple[int, int]]:
    """As ``search``, over whole numbers of any size, without a tree."""
    q = [int(x) for x in query]
    found = [(sum(int(x) * y for x, y in zip(v, q, strict=False)), i) for v, i in zip(vectors, ids, strict=True) if i != own]
    return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1]))


_FOUND = "query_id long, vec_id long, score long"


def _search_all(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each (shard, query) that is asked; ``asked``: shard, query_id, q, floor."""

    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        widths = set(map(len, vectors.column("v").to_pylist()))
        flat = {}
        for w in widths:  # vectors of another length than the query's take no part
            ids, rows = zip(*[(i, v) for i, v in zip(vectors.column("vec_id").to_pylist(), vectors.column("v").to_pylist(), strict=True) if len(v) == w], strict=True)
            order = sorted(range(len(ids)), key=ids.__getitem__)
            matrix = np.array([rows[i] for i in order])
            flat[w] = (np.array([ids[i] for i in order]), matrix, Tree(matrix), np.abs(matrix).max())
        for qid, q, floor in zip(*(queries.column(c).to_pylist() for c in ("query_id", "q", "floor")), strict=True):
            if len(q) not in flat:
                continue
            ids, matrix, tree, most = flat[len(q)]
            query = np.array(q)
            if most * np.abs(query).max() * len(q) < EXACT:
                found = search(tree, matrix, ids, query, qid, k, float("-inf") if floor is None else float(floor))
            else:
                found = _whole_scores(matrix.tolist(), ids.tolist(), q, qid, k)
            out += [(qid, i, max(-(1 << 63), min((1 << 63) - 1, int(s)))) for s, i in found]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return shards.groupBy("shard", "copy").cogroup(asked.groupBy("shard", "copy")).applyInArrow(run, _FOUND)


def top_k(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of all others for every query row.

    Vectors that are null, empty or hold null or non-finite components take no part, and
    vectors of different lengths do not meet. Rows whose id is null take no part; rows that
    repeat an id are candidates each, but never of a query with that id. Ties go to smaller
    ids. A score beyond the range of long is its nearest end. An empty table gives no rows.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), scaled(F.col(vector)).alias("v"), is_query.alias("asks"))
    rows = written(rows.filter("vec_id IS NOT NULL AND v IS NOT NULL"), "topk-vectors")
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    n_shards, n_blocks = -(-counted["n"] // SHARD_ROWS) or 1, -(-counted["q"] // BLOCK_QUERIES) or 1
    shard = lambda c, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(seed))
    shards = rows.select("vec_id", "v", shard("vec_id", n_shards).alias("shard"))
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), shard("vec_id", n_blocks).alias("copy"))
    home = F.pmod(F.hash("query_id"), F.lit(n_shards)).cast("long")

    def every(count: int, name: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)

    # the first shard of a query: its k-th score bounds the search of the others
    first = _search_all(
        shards.withColumn("copy", F.lit(0).cast("long")),
        queries.select("query_id", "q", home.alias("shard"), F.lit(0).cast("long").alias("copy"), F.lit(None).cast("long").alias("floor")),
        k,
    )
    first = written(first, "topk-first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k)
    rest = (
        queries.join(kth.select("query_id", "floor"), "query_id", "left")
        .select("query_id", "q", "copy", "floor", home.alias("home"), every(n_shards, "shard"))
        .filter("shard <> home")
    )
    others = _search_all(shards.select("*", every(n_blocks, "copy")), rest.drop("home"), k)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return first.unionByName(others).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
