"""Mentions, sections, excerpts, topics and pre-emption against brute force."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landsift.operators import conditions as C
from landsift.operators import documents as D

KEY = "ko_id bigint, parcel_number string"


def by_pattern(text, number):
    """Hits of one number by its own pattern."""
    body = r"\s*/\s*".join(re.escape(p) for p in number.split("/"))
    return [m.span() for m in re.finditer(rf"(?<![\d/]){body}(?![\d/])", text)]


@given(st.text(alphabet="123/ a.\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_page_numbers_find_what_each_pattern_finds(text):
    found = D._page_numbers(text)
    for number in {"1", "12", "3", "1/1", "1/2", "12/3", "123", "3/3", "2/1"} | {n for _, _, n in found}:
        assert [(s, e) for s, e, n in found if n == number] == by_pattern(text, number), (text, number)


def test_mentions_of_a_parcel(spark):
    text = "1 SPLOŠNO\nParcela 123/4 in 123 / 4, ne 9123/4 ne 123/45."
    pages = spark.createDataFrame([(1, 1, text)], "doc_id bigint, page int, text string")
    targets = spark.createDataFrame([(1723, "123/4", 1)], KEY + ", doc_id bigint")
    found = D.find_mentions(pages, targets)
    rows = sorted((r.start, r.listed) for r in found.collect())
    assert [s for s, _ in rows] == [text.index("123/4"), text.index("123 / 4")]
    assert [v for _, v in rows] == [True, False]
    shown = D.excerpts(pages, found).collect()
    assert [r.section for r in shown] == ["1 SPLOŠNO"]
    assert shown[0].text == text.replace("\n", " ")
    s = D.mention_summary(found, D.excerpts(pages, found)).first()
    assert (s.mention_count, s.page_count, s.sections) == (2, 1, ["1 SPLOŠNO"])


def test_long_page_excerpts_are_cut_on_both_sides(spark):
    text = "x" * 500 + " 7 " + "y" * 700
    pages = spark.createDataFrame([(1, 1, text)], "doc_id bigint, page int, text string")
    found = D.find_mentions(pages, spark.createDataFrame([(1, "7", 1)], KEY + ", doc_id bigint"))
    t = D.excerpts(pages, found).first().text
    assert t.startswith("…") and t.endswith("…") and len(t) == 360 + 1 + 520 + 2


def test_categories(spark):
    df = spark.createDataFrame(
        [(7, 0, "Poplavno območje; prepoved gradnje."), (8, 0, "Prepoved."), (9, 0, "nič")], "page int, start int, text string"
    )
    got = {r.category: r for r in D.findings_by_category(D.classify_excerpts(df.withColumn("k", F.lit(1))), ["k"]).collect()}
    assert set(got) == {"Poplave in vode", "Omejitve"}
    assert got["Omejitve"].pages == [7, 8] and got["Omejitve"].importance == "high"
    assert got["Omejitve"].evidence == "Poplavno območje; prepoved gradnje."


def fold(text):
    text = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def major(line):
    letters = [c for c in line if c.isalpha()]
    loud = letters and sum(c.isupper() for c in letters) / len(letters) > 0.86
    return len(line) <= 150 and bool(loud or re.match(r"\d+(\.\d+){0,3}[.)]?\s+\S", line))


def brute_excerpt(lines, start):
    out = [lines[start]]
    for line in lines[start + 1 : start + 12]:
        if sum(len(x) + 1 for x in out) >= 1050 or major(line):
            break
        out.append(line)
    text = " ".join(out)
    return text if len(text) <= 1100 else text[:1097].rstrip() + "…"


PAGES = {
    (1, 1): ["2.1 Dopustne dejavnosti", "dovoljene so trgovina, obrt in bivanje " * 3, "3 VELIKOST", "konec"],
    (1, 2): ["besedilo o dopustne dejavnosti in EUP IL 1 " * 4, "NASLOV", "Občina uveljavlja predkupno pravico na stavbnih zemljiščih il 1", "dalje"],
    (2, 1): ["Dopustne dejavnosti", "kratko", "GABARITI OBJEKTOV", "višina do 9 metrov, " * 8],
    (3, 1): ["Odlok o predkupni pravici občine"],
}
TITLES = {1: "Odlok", 2: "Prečiščeno besedilo odloka", 3: "Spremembe"}


def inputs(spark):
    pages = spark.createDataFrame([(d, p, "\n".join(v)) for (d, p), v in PAGES.items()], "doc_id bigint, page int, text string")
    titles = spark.createDataFrame(list(TITLES.items()), "doc_id bigint, title string")
    parcels = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3")], KEY)
    links = spark.createDataFrame(
        [(1, "1", 1, 0), (1, "1", 2, 1), (1, "1", 3, 2), (1, "2", 2, 0)], KEY + ", doc_id bigint, source_ord bigint"
    )
    contexts = spark.createDataFrame([(1, "1", 1, "IL 1", None, None, "IK", 10.0)], KEY + ", ord int, planning_unit string, subunit string, land_use_description string, land_use_code string, parcel_share_percent double")
    return C.planning_lines(pages), titles, parcels, links, contexts


def brute_topics(docs, terms):
    best = {}
    for order, doc in enumerate(docs):
        title = fold(TITLES[doc])
        for (d, page), raw in sorted(PAGES.items()):
            if d != doc:
                continue
            lines = [" ".join(v.split()) for v in raw]
            for topic, (_, aliases) in C.TOPICS.items():
                for i, alias in enumerate(map(fold, aliases)):
                    for n, line in enumerate(lines):
                        text = brute_excerpt(lines, n)
                        if alias not in fold(line) or len(text) < 70:
                            continue
                        body = fold(text)
                        hits = sum(bool(re.search(rf"(?<!\w){re.escape(t)}(?!\w)", body)) if len(t) <= 3 else t in body for t in terms)
                        score = len(alias) / 20 + (len(aliases) - i) * 4 + 3 * hits + min(len(text), 900) / 900
                        score += 3 * (fold(line) == alias) + 1.5 * ("odlok" in title) + 4 * ("precisceno besedilo" in title) - 2 * ("spremembe" in title)
                        rank = (score, -order, -page, -i)
                        if topic not in best or rank > best[topic][0]:
                            best[topic] = (rank, doc, page, text)
                        break
    return best


def test_best_conditions_are_brute_force(spark):
    lines, titles, parcels, links, contexts = inputs(spark)
    got = C.best_conditions(parcels, links, contexts, C.topic_candidates(lines, titles)).collect()
    assert len(got) == 3 * 17
    for number, docs, terms in (("1", [1, 2, 3], ["il 1", "ik"]), ("2", [2], []), ("3", [], [])):
        want = brute_topics(docs, terms)
        mine = {r.topic: r for r in got if r.parcel_number == number}
        assert {t for t, r in mine.items() if r.available} == set(want)
        for topic, (rank, doc, page, text) in want.items():
            r = mine[topic]
            assert (r.doc_id, r.page, r.description) == (doc, page, text), topic
            assert abs(r.score - rank[0]) < 1e-9
        assert all(r.description == C.MISSING for t, r in mine.items() if t not in want)


def test_preemption_outcomes(spark):
    lines, titles, parcels, links, contexts = inputs(spark)
    found = C.preemption_candidates(lines, titles)
    got = {r.parcel_number: r for r in C.best_preemption(parcels, links, contexts, found).collect()}
    # 4 + length + 8 (phrase) + 4 (building land) + 3 (title) + 2 for the term on the page
    assert got["1"].status == "provision_found" and (got["1"].doc_id, got["1"].page) == (1, 2)
    assert got["1"].matched == ["il 1"] and got["1"].checked_document_count == 3
    assert got["1"].excerpt.startswith("NASLOV Občina")
    assert got["2"].status == "not_found" and got["3"].status == "unavailable"
    towns = parcels.withColumn("municipality", F.when(F.col("parcel_number") == "1", "Gorenja vas - Poljane").otherwise("Bled"))
    rules = spark.createDataFrame([("Gorenja vas–Poljane", "odlok")], "municipality string, rule_basis string")
    m = C.municipal_preemption(towns, contexts, rules).collect()
    assert [(r.status, r.uses) for r in m] == [("applies", "IK – stavbno zemljišče (10 % parcele)")]


def test_two_column_pages_and_broken_words(spark):
    def page_lines(text):
        return C.with_clean_lines(spark.createDataFrame([(text,)], "text string")).first().lines

    # the middle of the gap lies at character 53, within the range where columns part
    rows = [f"levo{i} {'a' * 40}".ljust(60) + f"desno{i}" for i in range(9)]
    lines = page_lines("\n".join(rows))
    assert lines[:9] == [f"levo{i} {'a' * 40}" for i in range(9)] and lines[9:] == [f"desno{i}" for i in range(9)]
    # a gap further left does not part a page
    near = [f"levo{i}".ljust(60) + f"desno{i}" for i in range(9)]
    assert page_lines("\n".join(near)) == [f"levo{i} desno{i}" for i in range(9)]
    assert page_lines("stano-\n  vanje\n\n x  y") == ["stanovanje", "x y"]


def test_fixed_width_rows_take_their_continuations(spark):
    text = [
        (1, " " * 10 + "zgoraj"),
        (2, "IL 1".ljust(10) + "sredina"),
        (3, " " * 10 + "spodaj"),
        (4, ""),
        (5, " " * 10 + "drugje"),
        (6, "IL 2".ljust(10)),
    ]
    df = spark.createDataFrame([(1, n, t) for n, t in text], "doc bigint, n int, line string")
    got = {r.row_key: r.cell for r in C.fixed_width_table(df, ["doc"], "n", [(0, 10)], (10, None)).collect()}
    assert got == {"IL 1": "zgoraj sredina spodaj", "IL 2": "drugje /"}
