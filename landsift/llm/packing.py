"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt to shards of bounded size by a hash. A shard is packed by
several islands; each evolves its own population of packings, in which a gene is a whole
sequence with its pieces. Crossover injects well-filled sequences of one parent whole,
removes the sequences of the other that hold the same pieces, and best-fits what these
displaced. After every epoch the islands' tables are written, and each island's elite moves
to the next one. Only lengths are evolved; pieces get their places by rank at the end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import written
from landsift.llm.token_ids import slices, tokenizer

#: Tokens of a sequence; pieces of a shard, about.
CAPACITY = 1024
SHARD_PIECES = 20_000
#: Islands of a shard, packings of an island, epochs, and crossovers of an epoch.
ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 3, 4, 3, 12
#: Part of the sequences that a crossover injects at most.
INJECTED = 0.1

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, end: int = 2, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: its ids and an end id, cut only if over ``capacity``.

    The first piece takes what is left over, so that all others are full. Null and empty
    texts are one piece of the end id; repeated rows have pieces of their own.
    """
    def cut(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                ids, sizes = tokenizer(tokenizer_path).ids(some.column("t"), end)
                ids, at, rows = ids.astype("<u4"), 0, []
                for doc, n in zip(some.column("id").to_pylist(), sizes.tolist(), strict=True):
                    start, stop, k = 0, n - (n - 1) // capacity * capacity, 0
                    while start < n:
                        rows.append((doc, k, start, stop - start, zlib.crc32(ids[at + start : at + stop].data)))
                        start, stop, k = stop, stop + capacity, k + 1
                    at += n
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(cut, _PIECES)


class Space:
    """Sequences by the room they have left: the tightest that fits is found in a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, sequence: int, room: int) -> None:
        self.by_room[room].append(sequence)
        self.mask |= 1 << room

    def fit(self, length: int, new: int) -> int:
        """The sequence that takes a piece; ``new`` if none has the room."""
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            held = self.by_room[room]
            sequence = held.pop()
            if not held:
                self.mask ^= 1 << room
        else:
            room, sequence = self.capacity, new
        if room > length:
            self.add(sequence, room - length)
        return sequence


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, space: Space, new: int) -> int:
    """Put pieces into sequences in the given order; the number of sequences then."""
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = space.fit(length, new)
        new += at == new
        bins[i] = at
    return new


def packed(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> np.ndarray:
    """Sequence of each piece, by best fit; longest first unless an order is given."""
    bins = np.zeros(len(lengths), np.int32)
    best_fit(lengths, np.argsort(-lengths, kind="stable") if order is None else order, bins, Space(capacity), 0)
    return bins


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences are better, then fuller ones (mean square of how full they are)."""
    fill = np.bincount(bins, weights=lengths)
    return -len(fill), float(np.square(fill / capacity).mean()) if len(fill) else 0.0


def crossover(lengths: np.ndarray, into: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``into`` with well-filled sequences of ``other`` injected whole.

    Sequences of ``into`` that hold the same pieces go, as do some of the emptiest; the
    pieces they had besides are best-fitted, longest first with some disorder.
    """
    fill = np.bincount(other, weights=lengths)
    count = max(1, int(len(fill) * INJECTED * rng.random()))
    chosen = np.zeros(len(fill), np.bool_)
    good = np.argsort(-(fill + rng.random(len(fill)) * capacity * 0.02))[: 4 * count]
    chosen[rng.permutation(good)[:count]] = True
    injected = chosen[other]
    mine = np.bincount(into, weights=lengths)
    gone = np.zeros(len(mine), np.bool_)
    gone[into[injected]] = True
    gone[np.argsort(mine + rng.random(len(mine)) * capacity * 0.05)[: max(2, len(mine) // 50)]] = True
    stays = ~gone[into] & ~injected
    bins = np.full(len(into), -1, np.int32)
    kept, bins[stays] = np.unique(into[stays], return_inverse=True)
    new_ids, inside = np.unique(other[injected], return_inverse=True)
    bins[injected] = inside + len(kept)
    new = len(kept) + len(new_ids)
    room = capacity - np.bincount(bins[bins >= 0], weights=lengths[bins >= 0], minlength=new).astype(np.int64)
    space = Space(capacity)
    for at in np.flatnonzero(room).tolist():
        space.add(at, int(room[at]))
    left = np.flatnonzero(bins < 0)
    left = left[np.argsort(-(lengths[left] * (1 + 0.1 * rng.random() * rng.random(len(left)))))]
    best_fit(lengths, left, bins, space, new)
    return bins


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, crossovers: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A population after some crossovers, best first; a child replaces the worst if it is better."""
    if not population:
        population = [packed(lengths, capacity)]
        while len(population) < POPULATION:
            noisy = lengths * (1 + 0.15 * len(population) * rng.random(len(lengths)))
            population.append(packed(lengths, capacity, np.argsort(-noisy)))
    bound = -int(-(-int(lengths.sum()) // capacity))
    scored = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    for step in range(crossovers):
        if scored[0][0][0] >= bound or len(scored) < 2:  # no packing has fewer sequences
            break
        a, b = rng.permutation(len(scored))[:2]
        child = crossover(lengths, scored[min(a, b)][2], scored[max(a, b)][2], capacity, rng) if step % 2 else crossover(lengths, scored[0][2], scored[max(a, b)][2], capacity, rng)
        score = fitness(lengths, child, capacity)
        if score > scored[-1][0]:
            scored = sorted([*scored[:-1], (score, len(population) + step, child)], key=lambda x: x[0], reverse=True)
    return [p for _, _, p in scored]


_ISLANDS = "shard long, island int, lengths binary, bins binary"
_SLOTS = "shard long, length long, nth int, sequence int, offset long"


def _islands(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "island", "lengths", "bins"])


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, epochs: int = EPOCHS, crossovers: int = CROSSOVERS) -> DataFrame:
    """``parts`` (with ``length``) with sequence_id and offset; sequences hold up to ``capacity``.

    Full pieces are sequences by themselves. Of the others, only counts of lengths per shard
    (at most one row per length) reach the islands. An empty table gives no rows.
    """
    numbered = written(parts.withColumn("_id", F.monotonically_increasing_id()), "pack-pieces")
    open_count = numbered.filter(F.col("length") < capacity).count()
    shards = -(-open_count // shard_pieces) or 1
    some = numbered.filter(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)))
    counts = some.groupBy("shard", "length").agg(F.count("*").alias("n"))

    def settle(key, table):
        size, n = table.column("length").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(-size)
        lengths = np.repeat(size[order], n[order]).astype("<i4").tobytes()
        return _islands([(key[0].as_py(), i, lengths, b"") for i in range(ISLANDS)])

    def epoch(number: int):
        def run(key, table):
            shard, island = (k.as_py() for k in key)
            raw = table.column("lengths")[0].as_py()
            lengths = np.frombuffer(raw, "<i4")
            members = sorted({b for b in table.column("bins").to_pylist() if b})
            rng = np.random.default_rng([shard, island, number])
            found = evolve(lengths, [np.frombuffer(b, "<i4") for b in members], capacity, crossovers, rng)
            rows = [(shard, island, raw, p.astype("<i4").tobytes()) for p in found]
            return _islands([*rows, (shard, (island + 1) % ISLANDS, raw, rows[0][3])])

        return run

    def choose(key, table):
        lengths = np.frombuffer(table.column("lengths")[0].as_py(), "<i4")
        members = [np.frombuffer(b, "<i4") for b in sorted(set(table.column("bins").to_pylist()))]
        bins = max(members, key=lambda p: fitness(lengths, p, capacity))
        order = np.argsort(bins, kind="stable")
        placed = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = placed - placed[first][bins[order]]
        starts = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]]))
        nth = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
        return pa.table(
            [pa.array(np.full(len(bins), key[0].as_py(), np.int64)), pa.array(lengths.astype(np.int64)), pa.array((nth + 1).astype(np.int32)), pa.array(bins), pa.array(offset)],
            ["shard", "length", "nth", "sequence", "offset"],
        )

    state = written(counts.groupBy("shard").applyInArrow(settle, _ISLANDS), "pack-islands")
    for number in range(epochs):
        state = written(state.groupBy("shard", "island").applyInArrow(epoch(number), _ISLANDS), "pack-islands")
    slots = state.groupBy("shard").applyInArrow(choose, _SLOTS)
    nth = F.row_number().over(Window.partitionBy("shard", "length").orderBy("_id"))
    placed = some.withColumn("nth", nth).join(slots, ["shard", "length", "nth"])
    sequence = (F.shiftleft("shard", 32) + F.col("sequence")).alias("sequence_id")
    full = numbered.filter(F.col("length") >= capacity)
    return placed.select(*parts.columns, sequence, "offset").unionByName(
        full.select(*parts.columns, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
