"""Planning conditions and pre-emption passages from document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import phrases as PH
from landsift.functions import rules as R
from landsift.functions import text as T
from landsift.operators.scan import running

# The 17 topics, their titles, and the headings that announce them.
TOPICS = {
    "activities": ("Vrste dopustnih dejavnosti", [
        "vrste dopustnih dejavnosti", "dopustne dejavnosti", "dopustne namembnosti", "namembnosti oziroma dejavnosti"]),
    "construction": ("Vrste dopustnih gradenj in drugih del", [
        "vrste dopustnih gradenj in drugih del", "vrste dopustnih gradenj oziroma drugih del", "dopustne gradnje", "dopustni posegi"]),
    "objects": ("Vrste dopustnih objektov glede na namen", [
        "vrste dopustnih objektov glede na namen", "dopustni objekti in naprave", "dopustne vrste objektov", "vrste objektov"]),
    "functional_design": ("Osnovni funkcionalni in oblikovni pogoji", [
        "osnovni funkcionalni in oblikovni pogoji", "funkcionalna in oblikovna merila in pogoji", "funkcionalni in oblikovni pogoji",
        "splošni prostorski izvedbeni pogoji"]),
    "development_type": ("Tip in način zazidave", ["tip zazidave", "tipologija zazidave", "način zazidave"]),
    "size": ("Velikost in gabariti objektov", [
        "velikost in gabariti objektov", "gabariti objektov", "gabariti objekta", "pogoji glede velikosti objektov", "velikost objektov"]),
    "roof_facade": ("Strehe, fasade in zunanja podoba", [
        "strehe in fasade", "strehe objektov", "oblikovanje fasad", "zunanja podoba objektov", "oblikovanje zunanje podobe"]),
    "location_setbacks": ("Lega objektov in odmiki", [
        "lega objektov in odmiki", "lega objekta", "odmiki objektov", "odmiki od parcelnih mej", "odmiki od meja"]),
    "surroundings": ("Ureditev okolice in zelene površine", [
        "ureditev okolice in zelene površine", "ureditev okolice objektov", "ureditev okolice", "zelene površine"]),
    "utilization": ("Stopnja izkoriščenosti zemljišča", [
        "stopnja izkoriščenosti zemljišča", "stopnja izkoriščenosti", "dopustna izraba prostora", "faktor zazidanosti", "faktor izrabe"]),
    "building_plot": ("Velikost in oblika gradbene parcele", [
        "velikost in oblika gradbene parcele", "velikost in oblika parcele", "merila za parcelacijo", "parcelacija stavbnih zemljišč"]),
    "road_parking": ("Dostop do javne ceste, promet in parkiranje", [
        "priključevanje na javno cesto", "dostop do javne ceste", "prometno omrežje", "parkirne površine", "parkirna mesta"]),
    "utilities": ("Komunalna, energetska in komunikacijska infrastruktura", [
        "komunalna in energetska infrastruktura", "gospodarsko javno infrastrukturo", "komunalno opremljanje", "kanalizacijsko omrežje",
        "vodovodno omrežje"]),
    "heritage_nature": ("Varstvo kulturne dediščine in ohranjanje narave", [
        "varstvo kulturne dediščine in ohranjanje narave", "varstvo kulturne dediščine", "ohranjanje narave", "varstvo narave"]),
    "environment": ("Varstvo okolja in naravnih dobrin", [
        "varstvo okolja in naravnih dobrin", "varstvo okolja", "varstvo zraka", "varstvo tal", "varstvo voda"]),
    "hazards": ("Varstvo pred naravnimi in drugimi nesrečami", [
        "varstvo pred naravnimi in drugimi nesrečami", "naravne in druge nesreče", "poplavna območja", "erozijska območja",
        "varstvo pred požarom"]),
    "health": ("Varovanje zdravja ljudi", [
        "varovanje zdravja ljudi", "varstvo pred hrupom", "elektromagnetno sevanje", "svetlobno onesnaževanje", "zdravje ljudi"]),
}
MISSING = (
    "V pregledanem besedilu prostorskega akta ta sklop ni bil samodejno izluščen. "
    "Pogoje je treba preveriti v celotnem odloku oziroma pri občini."
)
# Excerpt sizes.
EXCERPT_LINES, SECTION_LINES, STOP_AT, CLIP_AT, SHORTEST = 12, 18, 1050, 1100, 70
SECTION_KEEP = 240
MAJOR_NUMBERED = r"(?U)^\d+(?:\.\d+){0,3}[.)]?\s+\S"
PREEMPTION_LINES = 10
# Pre-emption weights by phrase.
PREEMPTION_PHRASES = [
    ("obmocje predkupne pravice", 9), ("uveljavlja predkupno pravico", 8), ("odlok o predkupni pravici", 8), ("stavbn|ureditven", 4),
]
PREEMPTION_LABELS = {
    "applies": "Parcela posega v območje predkupne pravice občine",
    "rule_found": "Za občino je bil najden veljavni odlok o predkupni pravici",
    "provision_found": "V prostorskem aktu je zaznana določba o predkupni pravici",
    "not_found": "Določba v pregledanih dokumentih ni bila zaznana",
    "unavailable": "Samodejni pregled ni bil mogoč",
}
PREEMPTION_BASIS = "199.–201. člen Zakona o urejanju prostora (ZUreP-3) in veljavni občinski odlok"
# Columns gaps that split a page in two.
GAP_RANGE, GAP_COUNT = (45, 115), 8

GAP = " {8,}+"
BROKEN_WORD = "(?U)(?<=\\w)-\\s*\\n\\s*(?=\\w)"


def _gap_middles(line: Column) -> Column:
    """Middles of the wide gaps between the words of a line, as places from 0."""
    body = F.regexp_replace(line, "(?U)\\s+$", "")
    gaps, words = F.regexp_extract_all(body, F.lit(GAP), F.lit(0)), F.split(body, GAP, -1)
    walked = F.aggregate(
        F.arrays_zip(gaps.alias("g"), F.slice(words, F.lit(1), F.size(gaps)).alias("w")),
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("text"), F.array().cast("array<double>").alias("middles")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["w"]) + F.length(x["g"])).alias("at"),
            (a["text"] | x["w"].rlike("(?U)\\S")).alias("text"),
            F.when(
                a["text"] | x["w"].rlike("(?U)\\S"),
                F.concat(a["middles"], F.array((a["at"] + F.length(x["w"]) + F.length(x["g"]) / 2).cast("double"))),
            ).otherwise(a["middles"]).alias("middles"),
        ),
    )
    return walked["middles"]


def with_clean_lines(pages: DataFrame, text: str = "text", name: str = "lines") -> DataFrame:
    """``pages`` with the lines of each page without blank ones: two columns set one after
    the other, words broken at line ends joined, blanks collapsed.

    A page is two columns wide if enough of its lines have a wide gap in the middle range;
    it is cut at the median of these gaps."""
    low, high = GAP_RANGE
    pages = pages.withColumn("_raw", F.split(F.col(text), T.LINE_BREAK, -1))
    middles = F.filter(F.flatten(F.transform("_raw", _gap_middles)), lambda m: (m >= low) & (m <= high))
    pages = pages.withColumn("_middles", F.array_sort(middles))
    count = F.size("_middles")
    half = F.floor((count - 1) / 2).cast("int")
    median = (F.get("_middles", half) + F.get("_middles", F.floor(count / 2).cast("int"))) / 2
    pages = pages.withColumn("_cut", F.when(count >= GAP_COUNT, F.bround(median, 0).cast("int")))
    # blanks that end a half would come between a hyphen and its line end; the join allows them
    left = F.transform("_raw", lambda x: F.substr(x, F.lit(1), F.col("_cut")))
    right = F.transform("_raw", lambda x: F.substr(x, F.col("_cut") + 1))
    joined = F.array_join(F.when(F.col("_cut").isNotNull(), F.concat(left, right)).otherwise(F.col("_raw")), "\n")
    lines = F.split(F.regexp_replace(joined, BROKEN_WORD, ""), T.LINE_BREAK, -1)
    squeezed = F.filter(F.transform(lines, T.squeeze), lambda x: x != "")
    # as a row of its own, so that no filter on the lines works them out again
    return pages.withColumn(name, F.explode_outer(F.array(squeezed))).drop("_raw", "_middles", "_cut")


def is_major_heading(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    loud = F.coalesce(F.try_divide(capitals, letters) > 0.86, F.lit(False))
    return (F.length(line) <= 150) & (loud | line.rlike(MAJOR_NUMBERED))


def clip_excerpt(text: Column) -> Column:
    cut = F.concat(F.regexp_replace(F.substring(text, 1, CLIP_AT - 3), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(text) > CLIP_AT, cut).otherwise(text)


def excerpt(lines: Column, start: Column, count: int = EXCERPT_LINES, keep: int = 1) -> Column:
    """Lines from ``start`` (0-based) up to the next major heading or about 1,050 characters.

    A heading only ends the excerpt once ``keep`` characters are in it."""
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(acc, line):
        over = acc["done"] | ((acc["size"] >= keep) & is_major_heading(line))
        size = acc["size"] + F.length(line) + 1
        grown = F.struct(
            F.when(acc["size"] == 0, line).otherwise(F.concat(acc["text"], F.lit(" "), line)).alias("text"),
            size.alias("size"),
            (size >= STOP_AT).alias("done"),
        )
        stopped = F.struct(acc["text"].alias("text"), acc["size"].alias("size"), F.lit(True).alias("done"))
        return F.when(over, stopped).otherwise(grown)

    text = F.aggregate(F.slice(lines, start + 1, F.lit(count)), zero, step, lambda acc: acc["text"])
    return clip_excerpt(text)


def planning_lines(pages: DataFrame) -> DataFrame:
    """Pages of planning texts as cleaned and folded lines. ``pages``: ``doc_id, page, text``."""
    return (
        with_clean_lines(pages.select("doc_id", "page", "text")).select("doc_id", "page", "lines")
        .filter(F.size("lines") > 0)
        .withColumn("folded", F.transform("lines", T.fold))
    )


def alias_table() -> list[tuple[str, int, int, str]]:
    """(topic, number of aliases, position, alias) in reading order."""
    return [(k, len(a), i, alias) for k, (_, a) in TOPICS.items() for i, alias in enumerate(a)]


def _alias_hits(lines: DataFrame) -> tuple[DataFrame, Column]:
    """``lines`` with the phrase hits of every page, and the aliases they number."""
    rows = alias_table()
    names = PH.folded(lines.sparkSession, [alias for *_, alias in rows])
    told = ", ".join(
        f"named_struct('topic', '{t}', 'aliases', {n}, 'alias_index', {i}, 'alias', '{alias}')" for (t, n, i, _), alias in zip(rows, names, strict=True)
    )
    return lines.withColumn("hits", PH.phrase_hits(F.col("folded"), names)), F.expr(f"array({told})")


def topic_hits(lines: DataFrame) -> DataFrame:
    """Where page lines hold an alias of a topic, one row per line and alias; one pass per page."""
    found, aliases = _alias_hits(lines)
    return found.select("doc_id", "page", F.explode("hits").alias("h")).select(
        "doc_id", "page", F.col("h.line").alias("line"), F.get(aliases, F.col("h.phrase")).alias("a"), F.col("h.whole").alias("exact")
    ).select("doc_id", "page", "line", "a.*", "exact")


def topic_candidates(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """The candidate of each topic, page and alias: the first line whose excerpt is long
    enough, with the part of its score that no parcel changes. ``titles``: ``doc_id, title``.

    Excerpts are made on the page, once per line with a hit; the page itself does not travel."""
    longest = F.col("excerpt")
    found, aliases = _alias_hits(lines)
    at = F.array_distinct(F.col("hits.line"))
    texts = F.map_from_arrays(at, F.transform(at, lambda n: excerpt(F.col("lines"), n)))
    told = F.transform("hits", lambda h: F.struct(h["line"].alias("line"), h["phrase"].alias("phrase"), h["whole"].alias("exact"), F.element_at(F.col("texts"), h["line"]).alias("excerpt")))
    first = (
        found.filter(F.size("hits") > 0)
        .withColumn("texts", texts)
        .select("doc_id", "page", F.explode(told).alias("h"))
        .select("doc_id", "page", "h.*")
        .filter(F.length("excerpt") >= SHORTEST)
        .groupBy("doc_id", "page", "phrase")
        .agg(F.min_by(F.struct("excerpt", "exact", "line"), "line").alias("c"))
        .select("doc_id", "page", F.get(aliases, F.col("phrase")).alias("a"), "c.*")
        .select("doc_id", "page", "a.*", "excerpt", "exact", "line")
        .join(titles.select("doc_id", "title"), "doc_id")
    )
    title = T.fold(F.col("title"))
    base = (
        F.length("alias") / 20
        + (F.col("aliases") - F.col("alias_index")) * 4
        + F.least(F.length(longest), F.lit(900)) / 900
        + F.when(F.col("exact"), 3).otherwise(0)
        + F.when(title.contains("odlok"), 1.5).otherwise(0.0)
        + F.when(title.contains("precisceno besedilo"), 4).otherwise(0)
        - F.when(title.contains("spremembe"), 2).otherwise(0)
    )
    return first.select("doc_id", "page", "topic", "alias_index", "line", "excerpt", base.alias("base_score"), T.fold(longest).alias("folded")).withColumn(
        "words", word_text(F.col("folded"))
    )


def context_terms(contexts: DataFrame) -> DataFrame:
    """The searchable terms of each parcel's planning context, longest first."""
    folded = [T.fold(F.col(c)) for c in ("planning_unit", "subunit", "land_use_description")]
    texts = F.filter(F.array(*folded), lambda v: v.isNotNull() & (F.length(v) >= 3))
    tails = F.transform(
        F.filter(texts, lambda v: v.contains(" ")), lambda v: F.substring_index(v, " ", -2)
    )
    code = T.blank_to_null(F.trim("land_use_code"))
    codes = F.array_compact(F.array(F.when(F.length(code) >= 2, T.fold(code))))
    terms = contexts.select(*PARCEL_KEY, F.explode(F.concat(texts, tails, codes)).alias("term")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), F.col("term").alias("term"))))
    return terms.groupBy(*PARCEL_KEY).agg(F.transform(ordered, lambda t: t["term"]).alias("terms"))


def word_text(folded: Column) -> Column:
    """Text with everything but word characters blank, so that words stand between blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(folded, r"(?U)\W", " "), F.lit(" "))


def terms_in(text: Column, words: Column, terms: Column) -> Column:
    """The terms a folded text holds; those of up to three characters only as whole words.

    ``words`` is the text's ``word_text``; only a short term with other characters in it
    needs a pattern of its own."""
    def found(t):
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))
        short = F.when(t.rlike(r"(?U)^\w+$"), F.contains(words, F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.rlike(text, pattern))
        return F.when(F.length(t) <= 3, short).otherwise(F.contains(text, t))

    return F.filter(terms, found)


def _with_terms(links: DataFrame, contexts: DataFrame) -> DataFrame:
    """Parcel x document links with the parcel's terms. ``links``: parcel key, ``doc_id, source_ord``."""
    none = F.expr("cast(array() as array<string>)")
    return (
        links.select(*PARCEL_KEY, "doc_id", "source_ord")
        .join(context_terms(contexts), PARCEL_KEY, "left")
        .withColumn("terms", F.coalesce("terms", none))
    )


def best_conditions(parcels: DataFrame, links: DataFrame, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best passage of each of the 17 topics for every parcel; a topic without one
    keeps a fixed text.

    Scores depend on a document and a set of terms, not on the parcel itself, so they are
    worked out once per (document, terms); many parcels share them."""
    wanted = _with_terms(links, contexts)
    scored = (
        wanted.select("doc_id", "terms")
        .distinct()
        .join(candidates, "doc_id")
        .withColumn("score", F.col("base_score") + 3 * F.size(terms_in(F.col("folded"), F.col("words"), F.col("terms"))))
    )
    order = F.struct(F.col("score"), -F.col("page"), -F.col("alias_index"))
    per_doc = scored.groupBy("doc_id", "terms", "topic").agg(
        F.max_by(F.struct("score", "page", "excerpt"), order).alias("c")
    )
    best = (
        wanted.join(per_doc, ["doc_id", "terms"])
        .groupBy(*PARCEL_KEY, "topic")
        .agg(F.max_by(F.struct("doc_id", "c.page", "c.excerpt", "c.score"), F.struct("c.score", -F.col("source_ord"))).alias("b"))
        .select(*PARCEL_KEY, "topic", "b.*")
    )
    topics = ", ".join(f"'{t}'" for t in TOPICS)
    every = parcels.select(*PARCEL_KEY, F.explode(F.expr(f"array({topics})")).alias("topic"))
    titles = {k: v[0] for k, v in TOPICS.items()}
    return every.join(best, [*PARCEL_KEY, "topic"], "left").select(
        *PARCEL_KEY,
        "topic",
        T.label(F.col("topic"), titles).alias("title"),
        F.coalesce("excerpt", F.lit(MISSING)).alias("description"),
        F.col("excerpt").isNotNull().alias("available"),
        "doc_id",
        "page",
        "score",
    )


def apply_overrides(conditions: DataFrame, parcels: DataFrame, overrides: DataFrame) -> DataFrame:
    """A municipality's own wording replaces what was found.

    ``overrides``: ``municipality, topic, description``, one row each."""
    placed = conditions.join(parcels.select(*PARCEL_KEY, T.fold(F.col("municipality")).alias("_m")), PARCEL_KEY)
    rules = overrides.select(
        T.fold(F.col("municipality")).alias("_m"), "topic", F.trim("description").alias("override")
    )
    return (
        placed.join(rules, ["_m", "topic"], "left")
        .withColumns(
            {
                "available": F.col("available") | F.col("override").isNotNull(),
                "description": F.coalesce("override", "description"),
            }
        )
        .drop("_m", "override")
    )


def preemption_candidates(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines that speak of a pre-emption right, with their excerpt and parcel-free score."""
    page_text = F.array_join("folded", " ")
    hits = F.filter(
        F.transform(F.col("folded"), lambda line, i: F.when(line.contains("predkupn") & line.contains("pravic"), i)),
        lambda i: i.isNotNull(),
    )
    found = (
        lines.withColumn("line", F.explode(hits))
        .withColumn("page_text", page_text)
        .withColumn(
            "excerpt",
            clip_excerpt(
                F.array_join(
                    F.slice(
                        "lines",
                        F.greatest(F.col("line"), F.lit(1)),
                        F.least(F.col("line"), F.lit(1)) + PREEMPTION_LINES,
                    ),
                    " ",
                )
            ),
        )
        .withColumn("folded_excerpt", T.fold(F.col("excerpt")))
        .join(titles.select("doc_id", "title"), "doc_id")
    )
    base = F.lit(4) + F.least(F.length("excerpt"), F.lit(950)) / 950
    for phrase, weight in PREEMPTION_PHRASES:
        base = base + F.when(F.col("folded_excerpt").rlike(phrase), weight).otherwise(0)
    base = base + F.when(T.fold(F.col("title")).contains("odlok"), 3).otherwise(0)
    return found.select("doc_id", "page", "line", "excerpt", "page_text", base.alias("base_score"), word_text(F.col("page_text")).alias("words"))


def best_preemption(parcels: DataFrame, links: DataFrame, contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best pre-emption passage of each parcel: provision_found, not_found, or
    unavailable where no document could be read."""
    wanted = _with_terms(links, contexts)
    scored = (
        wanted.select("doc_id", "terms")
        .distinct()
        .join(candidates, "doc_id")
        .withColumn("matched", terms_in(F.col("page_text"), F.col("words"), F.col("terms")))
        .withColumn("score", F.col("base_score") + F.least(F.size("matched"), F.lit(3)) * 2)
    )
    order = F.struct(F.col("score"), -F.col("page"), -F.col("line"))
    row = F.struct("score", "page", "excerpt", F.slice("matched", 1, 4).alias("matched"))
    per_doc = scored.groupBy("doc_id", "terms").agg(F.max_by(row, order).alias("c"))
    best = (
        wanted.join(per_doc, ["doc_id", "terms"], "left")
        .groupBy(*PARCEL_KEY)
        .agg(
            F.count("*").alias("checked_document_count"),
            F.max_by(
                F.struct("doc_id", "c.page", "c.excerpt", "c.matched", "c.score"),
                F.when(F.col("c.score").isNotNull(), F.struct("c.score", -F.col("source_ord"))),
            ).alias("b"),
        )
        .select(*PARCEL_KEY, "checked_document_count", "b.*")
    )
    status = (
        F.when(F.col("checked_document_count").isNull(), "unavailable")
        .when(F.col("score").isNull(), "not_found")
        .otherwise("provision_found")
    )
    return (
        parcels.select(*PARCEL_KEY)
        .join(best, PARCEL_KEY, "left")
        .withColumn("status", status)
        .withColumn("label", T.label(F.col("status"), PREEMPTION_LABELS))
        .fillna(0, ["checked_document_count"])
    )


def municipal_preemption(parcels: DataFrame, contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of a municipality's own rule: it applies where a parcel has building land.

    ``rules``: ``municipality, rule_basis``, one row per municipality with such a rule."""
    code = F.upper(F.trim("land_use_code"))
    uses = contexts.filter(code.isin(R.BUILDING_LAND_CODES)).select(
        *PARCEL_KEY,
        F.struct(
            "ord",
            F.concat(
                code, F.lit(" – "), F.coalesce("land_use_description", F.lit("stavbno zemljišče")),
                F.coalesce(F.concat(F.lit(" ("), T.format_general(F.col("parcel_share_percent")), F.lit(" % parcele)")), F.lit("")),
            ).alias("text"),
        ).alias("use"),
    )
    per_parcel = uses.groupBy(*PARCEL_KEY).agg(F.array_sort(F.collect_list("use")).alias("uses"))
    town = F.replace(T.fold(F.col("municipality")), F.lit("–"), F.lit("-"))
    plain = F.regexp_replace(town, " ?- ?", "-")
    by_town = rules.withColumn("_m", F.regexp_replace(F.replace(T.fold(F.col("municipality")), F.lit("–"), F.lit("-")), " ?- ?", "-"))
    out = (
        parcels.select(*PARCEL_KEY, plain.alias("_m"))
        .join(by_town.select("_m", "rule_basis"), "_m")
        .join(per_parcel, PARCEL_KEY, "left")
    )
    applies = F.col("uses").isNotNull()
    return out.select(
        *PARCEL_KEY,
        F.when(applies, "applies").otherwise("provision_found").alias("status"),
        F.when(applies, PREEMPTION_LABELS["applies"]).otherwise(PREEMPTION_LABELS["rule_found"]).alias("label"),
        F.array_join(F.transform("uses", lambda u: u["text"]), "; ").alias("uses"),
        "rule_basis",
    )


def preemption(parcels: DataFrame, links: DataFrame, contexts: DataFrame, candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """The municipal rule decides where there is one; else the passages do."""
    municipal = municipal_preemption(parcels, contexts, rules).withColumnsRenamed({"status": "m_status", "label": "m_label"})
    found = best_preemption(parcels, links, contexts, candidates).join(municipal, PARCEL_KEY, "left")
    return found.withColumns(
        {
            "status": F.coalesce("m_status", "status"),
            "label": F.coalesce("m_label", "label"),
            "legal_basis": F.coalesce("rule_basis", F.lit(PREEMPTION_BASIS)),
        }
    ).drop("m_status", "m_label", "rule_basis")


def fixed_width_table(lines: DataFrame, keys: list[str], order: str, key_cuts: list[tuple[int, int]], cell_cut: tuple[int, int | None]) -> DataFrame:
    """Rows of a fixed-width table and one of their cells, with continuation lines.

    A line is a row when one of its key columns holds text. Unkeyed lines directly
    above and below whose cell holds text belong to the row, up to the next row or
    empty cell. Cuts are 0-based character positions."""
    def cut(bounds):
        lo, hi = bounds
        text = F.substr("line", F.lit(lo + 1)) if hi is None else F.substring("line", lo + 1, hi - lo)
        return T.squeeze(text)

    cells = lines.withColumns(
        {"row_key": cut(key_cuts[0]), "cell": cut(cell_cut), "_keyed": F.concat(*[cut(c) for c in key_cuts]) != ""}
    ).withColumn("_break", F.col("_keyed") | (F.col("cell") == ""))
    # the last break above and the next break below: their order and whether they are rows
    mark = F.when(F.col("_break"), F.struct(F.col(order).alias("at"), F.col("_keyed").alias("row")))
    marked = running(cells, keys, [order], {"_above": ("last", mark), "_below": ("next", mark)})
    owners = F.when(F.col("_keyed"), F.array(F.col(order))).when(
        ~F.col("_break"),
        F.array_compact(
            F.array(F.when(F.col("_above.row"), F.col("_above.at")), F.when(F.col("_below.row"), F.col("_below.at")))
        ),
    )
    part = F.struct(F.col(order).alias("at"), F.when(F.col("_keyed") & (F.col("cell") == ""), "/").otherwise(F.col("cell")).alias("text"))
    return (
        marked.withColumn("owner", F.explode(owners))
        .groupBy(*keys, "owner")
        .agg(
            F.max(F.when(F.col("_keyed"), F.col("row_key"))).alias("row_key"),
            F.array_sort(F.collect_list(part)).alias("parts"),
        )
        .select(*keys, F.col("owner").alias(order), "row_key", F.array_join(F.col("parts.text"), " ").alias("cell"))
    )
