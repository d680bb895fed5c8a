"""License scans: an exact set-similarity join of word windows with templates.

Tokens that templates use are counted in all documents; the order of rare tokens first is
the same for templates and texts. A window meets a template if it holds at least
``THRESHOLD`` of the template's distinct tokens, so its text must hold one of the template's
first tokens in that order (prefix filter), enough tokens of the template's vocabulary
(length filter), and behind the shared token both must have enough left (positional filter).
For what passes, a window slides over the whole text and begins at each token of the template,
with running counts: no place in the text is better than another, and the work grows with the
text. It has ``BLOCK`` words, or twice those of the template if these are more, so that every
template can be met. It must also say what tells the license from others (``must``), which a
part of the tokens alone does not: licenses differ by one word or number. The templates, their
tokens and their prefixes are a parameter of bounded size (``MOST_TOKENS``), which is checked;
documents are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of a template's distinct tokens that a window must hold.
THRESHOLD = Fraction(8, 10)
#: Least words of a window.
BLOCK = 64
#: Tokens of all templates together, which are sent to every task.
MOST_TOKENS = 100_000
#: Words (fixed value of the contract); A-Z count as lower case.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = re.compile("[A-Z]+")

#: Phrases whose words stand one after the other, and what they say (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


#: Other words that may stand between two words of what a window must say.
GAP = 2


@dataclass(frozen=True)
class Template:
    """A label, its text, and what a window must say to have the label.

    Each of ``must`` has to be found, as any of its ways of writing between bars: words in
    this order, with ``GAP`` others at most between two. Without it the tokens alone decide.
    """

    label: str
    text: str
    must: tuple[str, ...] = ()


#: Sentences by which texts state their license.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache license 2|apache license v2",)),
    Template("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE 2.0", ("apache",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", ("noncommercial|non commercial",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "license 3|license v3")),
    Template("gpl-3", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "license 2|license v2")),
)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text))


def template_sets(templates: tuple[Template, ...]) -> list[tuple[str, frozenset[str]]]:
    sets = [(t.label, frozenset(words(t.text))) for t in templates]
    if sum(len(s) for _, s in sets) > MOST_TOKENS:
        raise ValueError("too many template tokens to send to every task")
    return [(label, s) for label, s in sets if s]


def places(found: list[str], ways: str) -> tuple[list[int], list[int]]:
    """Where words in order begin, in any of their ways of writing, and the first end from there on."""
    out = []
    for parts in map(words, ways.split("|")):
        for start in (at for at, w in enumerate(found) if w == parts[0]):
            ends = {start}
            for part in parts[1:]:
                ends = {k for at in ends for k in range(at + 1, min(at + 2 + GAP, len(found))) if found[k] == part}
            if ends:
                out.append((start, min(ends)))
    out.sort()
    least = list(accumulate((end for _, end in reversed(out)), min))[::-1]
    return [start for start, _ in out], least


def best_window(found: list[str], held: list[tuple[int, int]], tokens: frozenset[int], need: int, window: int, must: tuple[str, ...]) -> int:
    """Most tokens of a template in one window that holds ``need`` and says all of ``must``, or 0.

    ``held``: place and rank of template tokens, in order of places.
    """
    mine = [(at, r) for at, r in held if r in tokens]
    said = [places(found, ways) for ways in must]
    inside: Counter[int] = Counter()
    best, end = 0, 0
    for at, r in mine:
        while end < len(mine) and mine[end][0] < at + window:
            inside[mine[end][1]] += 1
            end += 1
        if len(inside) >= need and len(inside) > best:
            firsts = [(ends, bisect_left(starts, at)) for starts, ends in said]
            if all(k < len(ends) and ends[k] < at + window for ends, k in firsts):
                best = len(inside)
        inside[r] -= 1
        if not inside[r]:
            del inside[r]
    return best


def frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """In how many documents each template token stands, over all of them.

    Tasks count the template tokens they meet; one row per token and task is summed, and at
    most ``MOST_TOKENS`` numbers come back.
    """
    known = frozenset().union(*(s for _, s in template_sets(templates)))

    def count(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column("t").to_pylist():
                if t:
                    total.update(known.intersection(words(t)))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Prefixes of the templates in the global order of tokens."""

    def __init__(self, templates: tuple[Template, ...], often: dict[str, int], threshold: Fraction = THRESHOLD):
        self.sets = template_sets(templates)
        self.must = [t.must for t in templates if words(t.text)]
        self.window = [max(BLOCK, 2 * len(words(t.text))) for t in templates if words(t.text)]
        tokens = frozenset().union(*(s for _, s in self.sets))
        order = sorted(tokens, key=lambda t: (often.get(t, 0), t))
        self.rank = {t: k for k, t in enumerate(order)}
        self.needed, self.sorted = [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (_, s) in enumerate(self.sets):
            need = -((-threshold * len(s)) // 1)
            ranks = sorted(self.rank[t] for t in s)
            self.needed.append(int(need))
            self.sorted.append(frozenset(ranks))
            for i, r in enumerate(ranks[: len(ranks) - int(need) + 1]):
                self.prefix.setdefault(r, []).append((k, i))

    def matches(self, block: list[int]) -> list[tuple[int, int]]:
        """(template, shared tokens) of the templates that a block's sorted ranks meet."""
        tried, found = set(), []
        for j, r in enumerate(block):
            for k, i in self.prefix.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)
                # the first shared token of both: what is left behind it must do
                need = self.needed[k]
                if len(block) < need or min(len(self.sorted[k]) - i, len(block) - j) < need:
                    continue
                shared = len(self.sorted[k].intersection(block))
                if shared >= need:
                    found.append((k, shared))
        return found


_ROWS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None,
    threshold: Fraction = THRESHOLD, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Words, phrase places and license labels of every document, from its whole text.

    n_base, first_word and last_word tell of the places where a phrase's words stand one
    after the other; base_labels of their labels, labels also of the templates that a window
    meets and whose ``must`` it says, each distinct, sorted and comma-joined (empty if none). score is 1 for a phrase,
    else the largest part of such a template's tokens that a window holds where that reaches
    the threshold, else 0. A null text counts as empty; null, repeated and tied keys stay as
    they are; an empty table gives no rows; other columns are not looked at.
    """
    index = Index(templates, frequencies(docs, templates, text), threshold)
    said = [(tuple(words(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    heads: dict[str, list] = {}
    for parts, label in said:
        heads.setdefault(parts[0], []).append((parts, label))
    names = [(label, len(s)) for label, s in index.sets]
    rank = index.rank

    def one(t: str) -> tuple:
        found = words(t)
        present = rank.keys() & set(found)
        starts, base = [], set()
        for head in heads.keys() & set(found):
            at = -1
            while True:
                try:
                    at = found.index(head, at + 1)
                except ValueError:
                    break
                for parts, label in heads[head]:
                    if tuple(found[at : at + len(parts)]) == parts:
                        starts.append(at)
                        base.add(label)
        labels, best = set(base), 1.0 if base else 0.0
        if any(rank[w] in index.prefix for w in present):
            held = [(at, r) for at, w in enumerate(found) if (r := rank.get(w)) is not None]
            for k, _ in index.matches(sorted(rank[w] for w in present)):
                shared = best_window(found, held, index.sorted[k], index.needed[k], index.window[k], index.must[k])
                if shared:
                    label, size = names[k]
                    labels.add(label)
                    best = max(best, shared / size)
        return (len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)

    def run(batches):
        for batch in batches:
            rows = [one(t or "") for t in batch.column("t").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [x.split()[0] for x in _ROWS.split(", ")],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, _ROWS)
