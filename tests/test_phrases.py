"""The automaton against looking for every phrase in every line."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landsift.functions import phrases as PH
from landsift.operators import conditions as C
from landsift.operators import documents as D


def brute(lines, phrases):
    return sorted((i, n, line == p) for i, line in enumerate(lines) if line for n, p in enumerate(phrases) if p and p in line)


letters = st.text("abč ", max_size=12)


@given(st.lists(letters | st.none(), max_size=6), st.lists(st.text("abč ", max_size=4), max_size=12))
@settings(max_examples=300, deadline=None)
def test_hits_equal_looking_for_each(lines, phrases):
    assert PH.find(lines, PH.automaton(tuple(phrases))) == brute(lines, phrases)


def test_column_of_hits(spark):
    phrases = ["velikost objektov", "objekt", "", "objekt", "odmiki"]
    pages = [["velikost objektov", "lega in odmiki objektov"], [], [None, "odmiki"], None, ["nič"]]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, lines array<string>")
    got = {r.k: [tuple(h) for h in r.h] for r in df.select("k", PH.phrase_hits(F.col("lines"), phrases).alias("h")).collect()}
    assert got == {k: brute(p or [], phrases) for k, p in enumerate(pages)}
    with pytest.raises(ValueError):
        PH.phrase_hits(F.col("lines"), ["a\nb"])
    assert PH.folded(spark, ["Velikost Objektov", "ŽIVA  meja"]) == ["velikost objektov", "ziva meja"]


def test_a_page_is_read_once_however_many_phrases():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvzčšž") for _ in range(r.randrange(3, 9)))
    page = [" ".join(word() for _ in range(12)) for _ in range(4000)]
    times = []
    for n in (50, 5000):
        built = PH.automaton(tuple(f"{word()} {word()}" for _ in range(n)))
        start = time.perf_counter()
        for _ in range(3):
            PH.find(page, built)
        times.append(time.perf_counter() - start)
    assert times[1] < 6 * times[0] + 0.2  # a hundred times the phrases


def test_topics_and_categories_by_the_automaton(spark):
    text = "Velikost objektov\nEtažnost je največ P+1.\nodmiki objektov in odmiki od meja\nprepoved gradnje v varovalnem pasu"
    lines = C.planning_lines(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string"))
    got = {(r.topic, r.line, r.alias, r.exact) for r in C.topic_hits(lines).collect()}
    want = set()
    folded = lines.first().folded
    for (topic, _, _, _), alias in zip(C.alias_table(), PH.folded(spark, [a for *_, a in C.alias_table()]), strict=True):
        want |= {(topic, i, alias, line == alias) for i, line in enumerate(folded) if alias in line}
    assert got == want and len(got) == 3
    found = D.classify_excerpts(spark.createDataFrame([(text,)], "text string"))
    low = text.lower()
    assert {r.category for r in found.collect()} == {k for k, words in D.CATEGORY_KEYWORDS.items() if any(w in low for w in words)}
