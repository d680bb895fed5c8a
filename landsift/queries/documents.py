"""Mentions, excerpts, findings, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import text as T
from landsift.operators import documents as D
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.planning import KEY
from landsift.session import table


def targets(spark, folder):
    """Documents of a parcel: order lines link parcels and documents."""
    k = F.col("l_partkey")
    return (
        table(spark, folder, "lineitem")
        .select(
            (1000 + k % 50).alias("ko_id"),
            F.when(k % 5 == 0, k.cast("string"))
            .otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 7 + 1).cast("string")))
            .alias("parcel_number"),
            F.expr("l_orderkey div 15").alias("doc_id"),
        )
        .distinct()
    )


TARGETS = """targets AS (
    SELECT DISTINCT 1000 + l_partkey % 50 AS ko_id, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS VARCHAR)
      ELSE l_partkey || '/' || (l_partkey % 7 + 1) END AS parcel_number, l_orderkey // 15 AS doc_id FROM lineitem)"""
# numbers of a page with their positions, from the gaps between digit runs
MENTIONS = f"""{TARGETS},
  pieces AS (SELECT doc_id, page, string_split_regex(text, '[0-9]+') AS gaps, regexp_extract_all(text, '[0-9]+') AS runs FROM page_text),
  tokens AS (SELECT doc_id, page, i, run, gaps[i] AS before, gaps[i + 1] AS after, runs[i + 1] AS next_run, gaps[i + 2] AS after_next,
      CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda x: length(x))), 0) AS INT) AS start
    FROM (SELECT *, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS i FROM pieces)),
  numbers AS (
    SELECT doc_id, page, start, start + length(run) AS "end", run AS number FROM tokens WHERE right(before, 1) <> '/' AND left(after, 1) <> '/'
    UNION ALL SELECT doc_id, page, start, start + length(run) + length(after) + length(next_run), run || '/' || next_run FROM tokens
      WHERE next_run IS NOT NULL AND regexp_full_match(after, '\\s*/\\s*') AND right(before, 1) <> '/' AND left(after_next, 1) <> '/'),
  mentions AS (SELECT *, start >= 120 OR row_number() OVER (PARTITION BY {KEY}, doc_id, page ORDER BY start) = 1 AS listed
    FROM (SELECT ko_id, parcel_number, t.doc_id, page, start, "end" FROM targets t JOIN numbers n ON n.doc_id = t.doc_id AND n.number = t.parcel_number))"""
BASE = X.ctes("page_text") + f", {MENTIONS}"


def mentions(spark, folder):
    return D.find_mentions(X.page_text(spark, folder), targets(spark, folder))


@query("j22_find_mentions", BASE + f' SELECT {KEY}, doc_id, page, start, "end", listed FROM mentions')
def j22_find_mentions(spark, folder):
    return mentions(spark, folder).select(*PARCEL_KEY, "doc_id", "page", "start", "end", "listed")


@query("w6_listed_excerpts", BASE + f" SELECT {KEY}, doc_id, page, count(*) FILTER (WHERE listed) AS listed, count(*) AS hits FROM mentions GROUP BY ALL")
def w6_listed_excerpts(spark, folder):
    return mentions(spark, folder).groupBy(*PARCEL_KEY, "doc_id", "page").agg(F.count_if("listed").alias("listed"), F.count("*").alias("hits"))


@query("w7_sections")
def w7_sections(spark, folder):
    return D.excerpts(X.page_text(spark, folder), mentions(spark, folder)).select(*PARCEL_KEY, "doc_id", "page", "start", "section")


@query(
    "a15_mention_summary",
    BASE + f" SELECT {KEY}, doc_id, count(*) AS mention_count, count(DISTINCT page) FILTER (WHERE listed) AS page_count FROM mentions GROUP BY ALL",
)
def a15_mention_summary(spark, folder):
    found = mentions(spark, folder)
    return D.mention_summary(found, D.excerpts(X.page_text(spark, folder), found)).drop("sections")


@query(
    "x38_summary_sentence",
    BASE + f""" SELECT {KEY}, doc_id, 'Parcela ' || parcel_number || ' se v besedilu PDF-ja neposredno pojavlja ' || n || '-krat na ' || p || ' straneh.' AS opening
    FROM (SELECT {KEY}, doc_id, count(*) AS n, count(DISTINCT page) FILTER (WHERE listed) AS p FROM mentions GROUP BY ALL)""",
)
def x38_summary_sentence(spark, folder):
    found = mentions(spark, folder)
    s = D.mention_summary(found, D.excerpts(X.page_text(spark, folder), found))
    text = D.summary_sentence(F.col("parcel_number"), F.col("mention_count"), F.col("page_count"), F.col("sections"))
    return s.select(*PARCEL_KEY, "doc_id", F.regexp_extract(text, r"(?s)^.*? straneh\.", 0).alias("opening"))


def page_excerpts(spark, folder):
    """Every page as one excerpt."""
    return X.page_text(spark, folder).select("doc_id", "page", F.lit(0).alias("start"), "text")


def sql_hits():
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{name}' END" for name, words in D.CATEGORY_KEYWORDS.items()
    ) + "], lambda x: x IS NOT NULL)"


HITS = f"hits AS (SELECT doc_id, page, text, unnest({sql_hits()}) AS category FROM page_text)"


@query("j20_classify_excerpts", X.ctes("page_text") + f", {HITS} SELECT doc_id, page, category FROM hits")
def j20_classify_excerpts(spark, folder):
    return D.classify_excerpts(page_excerpts(spark, folder)).select("doc_id", "page", "category")


@query(
    "a16_findings_by_category",
    X.ctes("page_text")
    + f""", {HITS} SELECT doc_id, category, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages,
    regexp_replace(substr(arg_min(text, page), 1, 360), '[ …]+$', '') AS evidence,
    CASE WHEN category IN ('Poplave in vode', 'Dediščina in narava', 'Omejitve') THEN 'high' ELSE 'medium' END AS importance FROM hits GROUP BY 1, 2""",
)
def a16_findings_by_category(spark, folder):
    found = D.findings_by_category(D.classify_excerpts(page_excerpts(spark, folder)), ["doc_id"])
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(
    "a18_scan_quality",
    X.ctes("page_text")
    + r""", p AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 > 0 AND doc_id % 2 = 0 THEN '  ' ELSE text END AS text FROM page_text)
    SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE regexp_full_match(text, '\s*')) AS empty_pages,
      count(*) FILTER (WHERE regexp_full_match(text, '\s*')) / count(*) >= 0.6 AS scanned FROM p GROUP BY 1""",
)
def a18_scan_quality(spark, folder):
    blank = ((F.col("doc_id") + F.col("page")) % 3 > 0) & (F.col("doc_id") % 2 == 0)
    return D.scan_quality(X.page_text(spark, folder).withColumn("text", F.when(blank, "  ").otherwise(F.col("text"))))


@query(
    "w10_pack_context",
    X.ctes("page_lines") + " SELECT doc_id, i, used FROM (SELECT doc_id, i, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS used FROM page_lines) WHERE used <= 900",
)
def w10_pack_context(spark, folder):
    return D.pack_context(X.page_lines(spark, folder), ["doc_id"], ["i"], "line", 900).select("doc_id", "i", "used")


@query(
    "x42_context_block",
    X.ctes("page_text") + " SELECT doc_id, page, '[PDF page ' || page || '; section: unknown]' || chr(10) || text || chr(10) AS block FROM page_text",
)
def x42_context_block(spark, folder):
    block = D.context_block(F.col("page"), F.lit(None).cast("string"), F.col("text"))
    return X.page_text(spark, folder).select("doc_id", "page", block.alias("block"))


def document_paths(spark, folder):
    parts = ["OPN/Tekstualni_del/", "graficni_prikazi/EUP_NRP/", "x/EUP_GJI/namensk", "Graficni_prikazi/namenska_"]
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("a/"), X.pick(parts, "doc_id % 4"), F.when(F.col("doc_id") % 5 == 0, "Odlok").when(F.col("doc_id") % 5 == 1, "legenda").otherwise("karta"), F.lit("_"), F.col("doc_id"), F.when(F.col("doc_id") % 11 == 0, ".PNG").otherwise(".PDF")).alias("path"),
    )


PATHS = """paths AS (SELECT doc_id, 'a/' || ['OPN/Tekstualni_del/', 'graficni_prikazi/EUP_NRP/', 'x/EUP_GJI/namensk', 'Graficni_prikazi/namenska_'][CAST(doc_id % 4 AS INT) + 1]
    || CASE doc_id % 5 WHEN 0 THEN 'Odlok' WHEN 1 THEN 'legenda' ELSE 'karta' END || '_' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.PNG' ELSE '.PDF' END AS path FROM documents)"""


@query(
    "f10_document_paths",
    f"""WITH {PATHS} SELECT doc_id, lower(path) LIKE '%tekstualni_del%' OR doc_id % 5 = 0 AS textual,
    doc_id % 11 <> 0 AND doc_id % 4 IN (1, 3) AND doc_id % 5 <> 1 AS land_use_map FROM paths""",
)
def f10_document_paths(spark, folder):
    return document_paths(spark, folder).select("doc_id", D.is_textual(F.col("path")).alias("textual"), D.is_land_use_map(F.col("path")).alias("land_use_map"))


@query(
    "f13_condition_sources",
    f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE doc_id % 3 <> 0 AND (lower(path) LIKE '%tekstualni_del%' OR doc_id % 5 = 0)",
)
def f13_condition_sources(spark, folder):
    docs = document_paths(spark, folder).withColumn("preparation_state", F.when(F.col("doc_id") % 3 == 0, "in preparation").otherwise("completed"))
    return docs.filter((F.col("preparation_state") == "completed") & D.is_textual(F.col("path"))).select("doc_id", "path")


@query(
    "k4_documents_ordered",
    BASE + f""" SELECT {KEY}, doc_id, n AS mention_count, row_number() OVER (PARTITION BY {KEY} ORDER BY n DESC, 'Akt ' || (doc_id % 9), 'Dok ' || doc_id) AS position
    FROM (SELECT {KEY}, doc_id, count(*) AS n FROM mentions GROUP BY ALL)""",
)
def k4_documents_ordered(spark, folder):
    from landsift.queries.planning import P_window

    counts = mentions(spark, folder).groupBy(*PARCEL_KEY, "doc_id").agg(F.count("*").alias("mention_count"))
    named = counts.withColumns({"act_title": F.concat(F.lit("Akt "), F.col("doc_id") % 9), "pdf_title": F.concat(F.lit("Dok "), F.col("doc_id"))})
    w = P_window(F.desc("mention_count"), "act_title", "pdf_title")
    return named.select(*PARCEL_KEY, "doc_id", "mention_count", F.row_number().over(w).alias("position"))


REDACT = r"""regexp_replace(regexp_replace(regexp_replace(substr(line, 1, 8000), '\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}', 'sk-<redacted>', 'g'),
   '(?i)((?:authorization|api[_-]?key|secret|password|captcha_token|token)\s*[=:]\s*)[^\s&,;]+', '\1<redacted>', 'g'), '(?i)(response=)[^&\s]+', '\1<redacted>', 'g')"""


@query("x25_redact", X.ctes("page_lines") + f" SELECT doc_id, i, {REDACT} AS line FROM page_lines")
def x25_redact(spark, folder):
    return X.page_lines(spark, folder).select("doc_id", "i", T.redact(F.col("line")).alias("line"))


@query(
    "k8_log_tail",
    X.ctes("page_lines")
    + f""" SELECT source, doc_id, i, {REDACT} AS line FROM (SELECT d.source, l.*, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id DESC, i DESC) AS rn
    FROM page_lines l JOIN documents d USING (doc_id)) WHERE rn <= 40""",
)
def k8_log_tail(spark, folder):
    lines = X.page_lines(spark, folder).join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return D.redacted_tail(lines, ["source"], ["doc_id", "i"], 40).select("source", "doc_id", "i", "line")
