"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams is that of their 64-bit hashes, so that it needs no pass
over the data and is uniform. It is cut into fragments; a document's set falls into one
segment per fragment. Overlaps are counted fragment by fragment and summed per pair.

1. Texts with equal sets are one class, found by a fingerprint of the set. Sets that link
   with d different n-grams agree on all but d fragments, so with more fragments than that
   they share an equal, non-empty segment: (fragment, segment) is the bucket of a candidate.
2. Each bucket's class of most copies (by powers of two) is its leader. Overlaps of each document with its
   leaders are counted per fragment of 16, with what differs, and summed.
3. Two documents of a bucket that both link with its leader need no test. For any other pair
   the sets of differences from the leader must overlap by more than half of the smaller
   kind; a prefix filter on these small sets, rarest differences first, finds such pairs
   without forming all pairs of a group, and their differences give the overlap exactly.
   Documents that share a rare difference first meet one of them, their hub; those that link
   with one hub are connected and meet each other no more.
4. Links become components by repeated minima over shared tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm.common import discard, small, written
from landsift.llm.token_ids import slices

#: Fragments in which overlaps are counted.
FRAGMENTS = 16
#: Rows of a few numbers that may be sent to every task instead of shuffling texts.
FEW = 500_000
#: Parts in which the leaders are dealt with, one after the other.
ROUNDS = 4
#: Other cuts for sets that leave too many fragments empty.
CUTS = 4

_BLANK = np.zeros(256, np.bool_)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Linking:
    """n-grams of ``n`` words; sets link at a Jaccard similarity of part / whole or more."""

    n: int = 3
    part: int = 90
    whole: int = 100

    def differing(self, sizes: int) -> int:
        """Most n-grams in which two linked sets of so many n-grams together differ."""
        return sizes * (self.whole - self.part) // (self.whole + self.part)

    def classes(self, most: int) -> list[int]:
        """Sizes at which classes begin; linked sets are in the same or in neighbouring classes."""
        begins = [1]
        while begins[-1] <= most:
            begins.append(begins[-1] * self.whole // self.part + 1)
        return begins


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words, A-Z in lower case.

    A word's hash is the sum of hashes of (byte, place); an n-gram's chains its words'. A
    text with fewer words is one n-gram of them all; without words its set is empty.
    """
    texts = pa.array(texts, pa.string()) if not isinstance(texts, pa.Array) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = ~_BLANK[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = bounds[(bounds < len(raw))]
    begin[cuts] = inside[cuts]  # a word does not run on from one text into the next
    at = np.flatnonzero(begin)
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(texts)
    places = np.flatnonzero(inside)
    word = np.cumsum(begin)[places] - 1
    keys = _LOWER[raw[places]].astype(np.uint64) + ((places - at[word]).astype(np.uint64) << np.uint64(8))
    words = _mix(np.add.reduceat(_mix((keys + np.uint64(1)) * _STEP), np.searchsorted(places, at)))
    first = np.searchsorted(at, bounds)
    grams = words.copy()
    for k in range(1, n):
        grams = grams[: len(words) - k] if k < len(words) else grams[:0]
        grams = _mix(grams * _STEP + words[k : k + len(grams)])
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        elif z > a:
            one = words[a : a + 1]
            for k in range(a + 1, z):
                one = _mix(one * _STEP + words[k : k + 1])
            out.append(_mix(one + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=None)
def _cuts(linking: Linking, smallest: int, largest: int) -> tuple[int, int]:
    """How many fragments a set must share, and into how many sets of such sizes are cut."""
    need = linking.differing(2 * largest) + 1
    m = need
    while need > 1 and m * (1 - np.exp(-smallest / m)) < need + 2 and m < need + smallest:
        m += 1
    return need, m


def buckets(grams: np.ndarray, linking: Linking, begins: list[int]) -> list[tuple[int, int, np.ndarray]]:
    """Keys of the segments by which a set can meet one that it links with: (part, spare, keys).

    A set is cut for its own size class and for the next, into more fragments than a linked
    pair there can differ in. Empty segments make no keys: a set has a spare fragment for
    each of them, or else it is cut again by other hashes (so is its partner if that lacks
    spares too, and one of both having them is enough); at last empty ones count.

    A part is one cut for one class. A set shares more than ``spare`` of a part's keys with
    each that it links with, if it does so by this part.
    """
    n, found = len(grams), []
    own = int(np.searchsorted(begins, n, side="right")) - 1
    for label in (own, own + 1):
        need, m = _cuts(linking, begins[max(label - 1, 0)], begins[label + 1] - 1)
        if need == 1:
            continue
        values = grams
        for cut in range(CUTS):
            if cut:
                values = np.sort(_mix(grams + np.uint64(cut * int(_STEP) % 2**64)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values + np.uint64(7)))])
            ends = np.searchsorted(values >> np.uint64(11), (np.arange(1, m, dtype=np.float64) * (2.0**53 / m)).astype(np.uint64))
            ends = np.concatenate([[0], ends, [n]])
            full = np.diff(ends) > 0
            named = _mix((np.arange(m, dtype=np.uint64) + np.uint64((label * CUTS + cut) << 32)) * _STEP)
            segment = _mix(np.diff(sums[ends]) + named)
            spare = int(full.sum()) >= need
            # by its own size a set may differ less from its partners than others of the class
            least = linking.differing(n + min(n * linking.whole // linking.part, begins[label + 1] - 1)) + 1
            more = int(full.sum()) - least if spare else 0
            found.append((label * CUTS + cut, more, segment[full] if spare or cut < CUTS - 1 else segment))
            if spare:
                break
    return found


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _print(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    if not len(s):
        return 0, 0
    both = np.array([np.bitwise_xor.reduce(_mix(s * _STEP)), np.add.reduce(_mix(s + _STEP))], np.uint64)
    return tuple(_signed(both).tolist())


def _prints(docs: DataFrame, linking: Linking, key: str, text: str) -> DataFrame:
    """id, size and fingerprint of every document's set."""
    n = linking.n

    def make(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                sets = gram_sets(some.column("t"), n)
                prints = np.array([_print(s) for s in sets], np.int64).reshape(-1, 2)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("id"), sizes, pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())], ["id", "n", "h1", "h2"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(make, "id long, n long, h1 long, h2 long")


def _firsts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the wanted classes (class, its smallest key and its fingerprint), read again.

    A text of a repeated key may be of another class; the fingerprint tells."""
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return texts.join(small(wanted, FEW), F.col("k").eqNullSafe(F.col("first"))).select("class", "h1", "h2", "t")


def _bucket_rows(docs: DataFrame, classes: DataFrame, linking: Linking, key: str, text: str) -> DataFrame:
    """id (of the class), part, spare and key of every bucket of a class; the keys go into the shuffle, not into a table."""
    n = linking.n

    def make(batches):
        begins = linking.classes(1 << 20)
        for batch in batches:
            for some in slices(batch, "t"):
                sets = gram_sets(some.column("t"), n)
                ids, parts, spares, keys, ends = [], [], [], [np.zeros(0, np.int64)], [0]
                for i, h1, h2, s in zip(*(some.column(c).to_pylist() for c in ("class", "h1", "h2")), sets, strict=True):
                    if _print(s) != (h1, h2):
                        continue
                    while begins[-2] <= len(s):
                        begins = linking.classes(2 * begins[-1])
                    for part, spare, segments in buckets(s, linking, begins):
                        ids.append(i)
                        parts.append(part)
                        spares.append(spare)
                        keys.append(_signed(segments))
                        ends.append(ends[-1] + len(segments))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                numbers = [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(spares, pa.int32())]
                yield pa.RecordBatch.from_arrays([*numbers, lists], ["id", "part", "spare", "keys"])

    chosen = _firsts(docs, classes.select("class", "first", "h1", "h2"), key, text)
    rows = chosen.mapInArrow(make, "id long, part int, spare int, keys array<long>")
    return rows.select("id", "part", "spare", F.explode("keys").alias("key"))


def _telling(rows: DataFrame) -> DataFrame:
    """id and key of the buckets by which a class must be met, without the most common ones.

    Two that link share more keys of a part than either's ``spare``. The rarest of these
    (in one order of all keys, by size and then by key) has at least ``spare`` others behind
    it in both, so it is not among the last ``spare`` keys of either and these can be left
    out. Buckets of one row come first and lead to no pair; they are not dealt out again."""
    shared = rows.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).filter("rows > 1")
    last = Window.partitionBy("id", "part").orderBy(F.desc("rows"), F.desc("key"))
    return shared.withColumn("place", F.row_number().over(last)).filter("place > spare").select("id", "key")


def _segments(docs: DataFrame, wanted: DataFrame, linking: Linking, key: str, text: str) -> DataFrame:
    """id, f, grams: the segments of the wanted classes' sets, one row per fragment."""
    n = linking.n

    def make(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                sets = gram_sets(some.column("t"), n)
                fragments, grams, ends, ids = [], [np.zeros(0, np.int64)], [0], []
                for i, h1, h2, s in zip(*(some.column(c).to_pylist() for c in ("class", "h1", "h2")), sets, strict=True):
                    if _print(s) != (h1, h2):
                        continue
                    cut = np.concatenate([[0], np.searchsorted(s, (np.arange(1, FRAGMENTS) * (2.0**64 / FRAGMENTS)).astype(np.uint64)), [len(s)]])
                    for f in range(FRAGMENTS):
                        ids.append(i)
                        fragments.append(f)
                        grams.append(_signed(s[cut[f] : cut[f + 1]]))
                        ends.append(ends[-1] + len(grams[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fragments, pa.int32()), lists], ["id", "f", "grams"])

    return _firsts(docs, wanted, key, text).mapInArrow(make, "id long, f int, grams array<long>").dropDuplicates(["id", "f"])


def _linked(d: str, sizes: str, linking: Linking):
    """Whether sets of so many n-grams together that differ in ``d`` link."""
    return F.expr(f"{d} * {linking.whole + linking.part} <= ({sizes}) * {linking.whole - linking.part}")


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of all ids in links (a, b).

    Every round each id takes the smallest id that it or a neighbour knows, and then what
    that one knows (pointer jumping); a round's table is written. Ends when nothing changes.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "component")
    while True:
        near = edges.join(state.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").groupBy("a").agg(F.min("d").alias("d"))
        step = state.join(near, "a").select("a", "c", F.least("c", "d").alias("d"))
        jump = step.join(state.select(F.col("a").alias("d"), F.col("c").alias("e")), "d", "left")
        after = written(jump.select("a", F.least("d", F.coalesce("e", "d")).alias("c"), (F.least("d", F.coalesce("e", "d")) < F.col("c")).alias("moved")), "component")
        state = after.select("a", "c")
        if after.filter("moved").limit(1).count() == 0:
            return state.select(F.col("a").alias("id"), F.col("c").alias("component"))


def link_classes(docs: DataFrame, linking: Linking, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all documents, the classes of equal sets, and every link components need.

    sets: id, n, h1, h2. classes: class (a number), first (its smallest key), n, h1, h2.
    links: a, b between classes.
    """
    made = written(_prints(docs, linking, key, text), "ngram-sets")
    same = ["h1", "h2", "n"]
    classes = made.filter("n > 0").groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # a number below 2^54 (for up to 2^21 partitions), behind one that puts many copies first
    rank = F.shiftleft(F.lit(63).cast("long") - F.floor(F.log2("copies")), 54)
    classes = written(classes.withColumn("class", rank + F.monotonically_increasing_id()).drop("copies"), "ngram-classes")
    rows = _telling(_bucket_rows(docs, classes, linking, key, text))
    # the rows of a bucket (two numbers each) come in order, its leader first
    leader = F.first("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    pairs = written(rows.withColumn("leader", leader).filter("id <> leader").select("id", "leader").distinct(), "ngram-pairs")

    ids = pairs.select(F.col("id").alias("class")).unionByName(pairs.select(F.col("leader").alias("class"))).distinct()
    wanted = written(classes.join(ids, "class").select("class", "first", "h1", "h2"), "ngram-wanted")
    segments = written(_segments(docs, wanted, linking, key, text), "ngram-segments")
    # leaders are dealt with in rounds: the differences of one round at a time are on disk
    rounds = [_round(pairs, segments, linking, k) for k in range(ROUNDS)]
    links = rounds[0]
    for more in rounds[1:]:
        links = links.unionByName(more)
    links = written(links.distinct(), "ngram-links")
    discard(pairs, wanted, segments, *rounds)
    return made, classes, links


def _round(pairs: DataFrame, segments: DataFrame, linking: Linking, k: int) -> DataFrame:
    """Links (a, b) around the leaders of round ``k``, as a written table."""
    due = F.pmod(F.xxhash64("leader"), F.lit(ROUNDS)) == k
    pairs = pairs.filter(due)
    mine = segments.select("id", "f", F.col("grams").alias("g"))
    theirs = segments.select(F.col("id").alias("leader"), "f", F.col("grams").alias("h")).filter(due)
    counted = (
        mine.join(small(pairs, FEW), "id")
        .join(theirs, ["leader", "f"])
        .select(
            "id", "leader",
            F.size("g").alias("n"), F.size("h").alias("m"),
            F.concat(F.array_except("g", "h"), F.array_except("h", "g")).alias("d"),
        )
        .groupBy("id", "leader")
        .agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.size("d")).alias("differ"), F.flatten(F.collect_list("d")).alias("d"))
        .withColumn("linked", _linked("differ", "n + m", linking))
    )
    counted = written(counted, "ngram-differences")
    direct = counted.filter("linked").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    around, tables = _around(counted, linking)
    links = written(direct.unionByName(around).distinct(), "ngram-round")
    discard(counted, *tables)
    return links


def _around(counted: DataFrame, linking: Linking) -> tuple[DataFrame, list[DataFrame]]:
    """Links and the tables that they are read from: links between documents of a leader of which at least one does not link with it.

    Not all of them: documents that link with one hub are connected, and their own links are left out.

    With x not linked to the leader, an x-y link needs more than half of y's differences to
    be shared; x shares all but as many as linked sets may differ in. The rarest differences
    of a leader's documents come first in both prefixes, so those of one document alone lead
    to no pair.
    """
    less, more = linking.whole - linking.part, linking.whole + linking.part
    # a leader with one document, or that all its documents link with, needs no test
    tested_leaders = counted.groupBy("leader").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("open")).filter("k > 1 AND open > 0")
    group = counted.join(tested_leaders.select("leader"), "leader", "left_semi")
    each = group.select("leader", "id", F.explode("d").alias("g"))
    # written, so that the files of this count are gone before the differences are dealt out again
    often = written(each.groupBy("leader", "g").agg(F.count("*").alias("often")).filter("often > 1"), "ngram-often")
    shared = each.join(often, ["leader", "g"]).groupBy("leader", "id").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("d"))
    ranked = group.select("leader", "id", "n", "m", "differ", "linked").join(shared, ["leader", "id"])
    # most by which y may miss: its differences less the overlap it must have with any x
    half = F.expr(f"differ - greatest(1, int(ceil((differ + (m - n) * {less} / {more}) / 2 - 0.000001))) + 1")
    most = F.expr(f"int(floor((n + n * {linking.whole} / {linking.part}) * {less} / {more} + 0.000001)) + 1")
    # x may differ from y by so many at most, which holds whether or not y links with the leader
    ranked = ranked.withColumns({"half": half, "most": F.least(most, F.col("differ"))})
    ranked = written(ranked.withColumn("short", F.least("half", "most")), "ngram-prefixes")

    def prefix(rows: DataFrame, length: str, a: str) -> DataFrame:
        """Differences in the prefix that others have too, each with how many it and its followers are.

        Those of the document alone come before them in the order."""
        some = F.slice("d", F.lit(1), F.greatest(F.lit(0), (F.col(length) - F.col("differ") + F.size("d")).cast("int")))
        taken = rows.select("leader", F.col("id").alias(a), F.col("n").alias(f"n{a}"), F.col("differ").alias(f"d{a}"), F.size("d").alias("held"), F.posexplode(some).alias("at", "t"))
        return taken.select("leader", F.col("t.g").alias("g"), a, f"n{a}", f"d{a}", (F.col("held") - F.col("at")).alias(f"r{a}"))

    # differences that two must share to link, against those that are left from here on
    enough = F.expr(f"2 * least(rx, ry) >= dx + dy - (nx + ny) * {less} div {more}")
    x_short, x_most = prefix(ranked.filter("NOT linked"), "short", "x"), prefix(ranked.filter("NOT linked"), "most", "x")
    y_linked = prefix(ranked.filter("linked"), "half", "y")
    side = lambda a: ranked.select("leader", F.col("id").alias(a), F.col("n").alias(f"n{a}"), F.col("differ").alias(f"z{a}"), F.transform("d", lambda t: t["g"]).alias(f"d{a}"))

    def test(tried: DataFrame) -> DataFrame:
        """Those of the pairs (leader, x, y) that link."""
        tested = tried.distinct().join(side("x"), ["leader", "x"]).join(side("y"), ["leader", "y"])
        tested = tested.withColumn("differ", F.col("zx") + F.col("zy") - 2 * F.size(F.array_intersect("dx", "dy")))
        return tested.filter(_linked("differ", "nx + ny", linking)).select("leader", "x", "y")

    # the smallest of a difference's documents is their hub
    order = Window.partitionBy("leader", "g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hub = F.first(F.struct("x", "nx", "dx", "rx")).over(order)
    to_hub = x_short.withColumn("hub", hub).select("*", F.col("hub.x").alias("y"), *[F.col(f"hub.{c}x").alias(f"{c}y") for c in "ndr"])
    stars = written(test(to_hub.filter(F.expr("y < x") & enough).select("leader", "x", "y")), "ngram-stars")
    # the smallest hub that a document links with stands for what it is connected to
    label = stars.groupBy("leader", "x").agg(F.min("y").alias("label"))
    named = x_short.join(label, ["leader", "x"], "left").withColumn("label", F.coalesce("label", "x"))
    parted = named.groupBy("leader", "g").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    parted = named.join(parted.hint("merge"), ["leader", "g"], "left_semi")
    others = parted.select("leader", "g", F.col("label").alias("other"), *[F.col(f"{c}x").alias(f"{c}y") for c in ("", "n", "d", "r")])
    meet = lambda x, y, also: x.alias("p").join(y.alias("q"), (F.col("p.leader") == F.col("q.leader")) & (F.col("p.g") == F.col("q.g")) & enough & also).select("p.leader", "x", "y")
    tried = meet(parted, others, F.expr("x < y AND label <> other")).unionByName(meet(x_most, y_linked, F.lit(True)))
    links = stars.unionByName(test(tried))
    return links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), [often, ranked, stars]


def join(docs: DataFrame, linking: Linking | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    component_id is the smallest key reachable by links. Texts that are null, empty or blank
    have an empty set and link with nothing; equal texts are one class without a test. Rows
    whose keys are null or repeated are documents like others (a component of null keys alone
    is null). An empty table gives no rows.
    """
    linking = linking or Linking()
    sets, classes, links = link_classes(docs, linking, key, text)
    found = classes.join(components(links).withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = found.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(found.join(smallest, "component").select("h1", "h2", "n", "component_id"), "ngram-components")
    out = sets.select("id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def first_of_each(docs: DataFrame, linking: Linking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that link, directly or through others, with a smaller key.

    Documents without words stay. Rows that share a key stay if one of them is the first of
    its component; of rows that repeat key and text one stays. Rows without a key stay.
    """
    found = written(join(docs, linking, key, text), "ngram-first")
    dropped = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.when((F.col("n_shingles") > 0) & (F.col("component_id") < F.col("doc_id")), 1).otherwise(0)).alias("later"),
        F.count("*").alias("rows"),
    )
    dropped = written(dropped.filter("later = 1 OR rows > 1"), "ngram-dropped")
    later = small(dropped.filter("later = 1").select(F.col("doc_id").alias("_k")), FEW)
    repeated = small(dropped.filter("later = 0").select(F.col("doc_id").alias("_k")), FEW)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    kept = rows.join(later, F.col("_key") == F.col("_k"), "left_anti")
    once = kept.join(repeated, F.col("_key") == F.col("_k"), "left_anti")
    more = kept.join(repeated, F.col("_key") == F.col("_k"), "left_semi").dropDuplicates(["_key", "_text"])
    return once.select("row.*").unionByName(more.select("row.*"))
