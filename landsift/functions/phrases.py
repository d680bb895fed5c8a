"""Many phrases in one pass over a text.

All phrases of a dictionary stand in one automaton (a trie with failure links), so a page is
read once however many phrases there are, and hits come back as positions, not as copies of
the text. The automaton is built once per worker and dictionary.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from landsift.functions import text as T

HITS = "array<struct<line:int,phrase:int,whole:boolean>>"
_KIND = pa.list_(pa.struct([("line", pa.int32()), ("phrase", pa.int32()), ("whole", pa.bool_())]))
_BUILT: dict[tuple, ahocorasick.Automaton] = {}


#: Rows of a batch that are Python objects at a time.
SLICE = 128


def in_slices(told: Callable[[list], pa.Array], column: pa.Array, kind: pa.DataType) -> pa.Array:
    """``told`` of a column, a slice of its rows at a time: a batch has thousands of pages, and
    as Python objects their texts and hits take many times the room of the columns."""
    parts = [told(column.slice(at, SLICE).to_pylist()) for at in range(0, len(column), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of non-empty phrases; equal ones share a place that holds all their numbers."""
    if phrases not in _BUILT:
        places: dict[str, list[int]] = {}
        for n, phrase in enumerate(phrases):
            if phrase:
                places.setdefault(phrase, []).append(n)
        made = ahocorasick.Automaton()
        for phrase, numbers in places.items():
            made.add_word(phrase, (len(phrase), numbers))
        made.make_automaton()
        _BUILT.clear()  # a worker mostly meets one dictionary
        _BUILT[phrases] = made
    return _BUILT[phrases]


def find(lines: Sequence[str | None], built: ahocorasick.Automaton) -> list[tuple[int, int, bool]]:
    """(line, phrase, is it the whole line) of every phrase that a line holds, in that order."""
    if not len(built):
        return []
    texts = [x or "" for x in lines]
    starts, at = [], 0
    for x in texts:
        starts.append(at)
        at += len(x) + 1
    found = set()
    # phrases hold no line feed, so none runs on from line to line
    for end, (size, numbers) in built.iter("\n".join(texts)):
        line = bisect_right(starts, end) - 1
        whole = size == len(texts[line])
        found.update((line, n, whole) for n in numbers)
    return sorted(found)


def phrase_hits(lines: Column, phrases: Sequence[str]) -> Column:
    """``array<struct<line, phrase, whole>>`` of an array of lines: which line (from 0) holds
    which phrase (its number), and whether it is the line. Null lines give no hits."""
    kept = tuple(phrases)
    if any("\n" in p for p in kept):
        raise ValueError("a phrase holds a line feed")

    def told(pages: list[list[str | None] | None]) -> pa.Array:
        built = automaton(kept)
        rows = [[{"line": n, "phrase": p, "whole": w} for n, p, w in find(page or (), built)] for page in pages]
        return pa.array(rows, _KIND)

    return F.arrow_udf(lambda pages: in_slices(told, pages, _KIND), HITS)(lines)


def folded(spark: SparkSession, phrases: Sequence[str]) -> list[str]:
    """The phrases as ``fold`` leaves texts; as many come back as went in."""
    rows = spark.createDataFrame(list(enumerate(phrases)), "n int, phrase string")
    known = dict(rows.select("n", T.fold(F.col("phrase"))).collect())
    return [known[n] for n in range(len(phrases))]
