"""Topics, pre-emption, overrides, fixed-width tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import rules as R
from landsift.functions import text as T
from landsift.operators import conditions as C
from landsift.operators import sections as S
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.queries.documents import targets
from landsift.queries.planning import BASE, KEY, contexts
from landsift.session import table


def titles(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(X.pick(["Odlok", "Prečiščeno besedilo", "Spremembe akta"], "doc_id % 3"), F.lit(" "), F.col("doc_id")).alias("title")
    )


def links(spark, folder):
    return targets(spark, folder).withColumn("source_ord", F.col("doc_id"))


def lines(spark, folder):
    return C.planning_lines(X.page_text(spark, folder))


ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{a}')" for t, _, i, a in C.alias_table()) + ") v(topic, alias_index, alias))"
# No page here has two columns; only words broken at a line end would differ, and none is.
FOLDED = r"strip_accents(replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 'ß', 'ss'))"


@query(
    "j21_topic_hits",
    X.ctes("page_lines")
    + f""", {ALIASES} SELECT doc_id, page, topic, alias_index, count(*) AS lines, count(*) FILTER (WHERE l = strip_accents(alias)) AS exact
    FROM (SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, {FOLDED} AS l FROM page_lines) JOIN aliases ON contains(l, strip_accents(alias)) GROUP BY ALL""",
)
def j21_topic_hits(spark, folder):
    return C.topic_hits(lines(spark, folder)).groupBy("doc_id", "page", "topic", "alias_index").agg(
        F.count("*").alias("lines"), F.count_if("exact").alias("exact")
    )


@query("x36_topic_scores")
def x36_topic_scores(spark, folder):
    return C.topic_candidates(lines(spark, folder), titles(spark, folder)).select("doc_id", "page", "topic", "alias_index", "base_score")


def best(spark, folder):
    return C.best_conditions(
        X.parcels(spark, folder), links(spark, folder), contexts(spark, folder), C.topic_candidates(lines(spark, folder), titles(spark, folder))
    )


@query("w4_best_condition")
def w4_best_condition(spark, folder):
    return best(spark, folder).select(*PARCEL_KEY, "topic", "available", "doc_id", "page", "score")


@query(
    "x37_context_terms",
    BASE
    + f""", raw AS (SELECT {KEY}, strip_accents(lower(land_use_code)) AS code, list_filter([strip_accents(lower(planning_unit)), strip_accents(lower(subunit)),
        strip_accents(lower(land_use_description))], lambda x: length(x) >= 3) AS texts FROM context),
      terms AS (SELECT DISTINCT {KEY}, unnest(texts) AS term FROM raw UNION SELECT {KEY}, code FROM raw WHERE length(code) >= 2)
    SELECT {KEY}, string_agg(term, '|' ORDER BY length(term) DESC, term) AS terms FROM terms GROUP BY ALL""",
)
def x37_context_terms(spark, folder):
    out = C.context_terms(contexts(spark, folder))
    return out.select(*PARCEL_KEY, F.array_join("terms", "|").alias("terms")).filter("terms <> ''")


@query("w5_best_preemption")
def w5_best_preemption(spark, folder):
    found = C.best_preemption(
        X.parcels(spark, folder), links(spark, folder), contexts(spark, folder), C.preemption_candidates(lines(spark, folder), titles(spark, folder))
    )
    return found.select(*PARCEL_KEY, "status", "checked_document_count", "doc_id", "page", "score")


@query(
    "w5_preemption_lines",
    X.ctes("page_lines")
    + f""" SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, count(*) AS lines FROM page_lines WHERE contains({FOLDED}, 'predkupn') AND contains({FOLDED}, 'pravic') GROUP BY ALL""",
)
def w5_preemption_lines(spark, folder):
    found = C.preemption_candidates(lines(spark, folder), titles(spark, folder))
    return found.groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


def rules(spark):
    return spark.createDataFrame([("Gorenja vas – Poljane", "Odlok o predkupni pravici")], "municipality string, rule_basis string")


@query(
    "j23_municipal_preemption",
    BASE
    + f""", uses AS (SELECT {KEY}, count(*) AS n FROM context WHERE upper(land_use_code) IN ({", ".join(repr(c) for c in R.BUILDING_LAND_CODES)}) GROUP BY ALL)
    SELECT {KEY}, CASE WHEN n > 0 THEN 'applies' ELSE 'provision_found' END AS status, coalesce(n, 0) AS use_count
    FROM parcels LEFT JOIN uses USING (ko_id, parcel_number) WHERE municipality = 'Gorenja vas-Poljane'""",
)
def j23_municipal_preemption(spark, folder):
    out = C.municipal_preemption(X.parcels(spark, folder), contexts(spark, folder), rules(spark))
    return out.select(*PARCEL_KEY, "status", F.when(F.col("status") == "applies", F.size(F.split("uses", "; "))).otherwise(0).cast("bigint").alias("use_count"))


@query("j23_preemption")
def j23_preemption(spark, folder):
    found = C.preemption_candidates(lines(spark, folder), titles(spark, folder))
    out = C.preemption(X.parcels(spark, folder), links(spark, folder), contexts(spark, folder), found, rules(spark))
    return out.select(*PARCEL_KEY, "status", "label", "legal_basis", "checked_document_count")


@query(
    "j24_condition_overrides",
    X.ctes("parcels")
    + f""" SELECT {KEY}, topic, CASE WHEN municipality = 'Kranj' AND topic = 'size' THEN 'Velja občinska preglednica.' ELSE 'x' END AS description,
    municipality = 'Kranj' AND topic = 'size' AS available FROM parcels, (SELECT unnest(['size', 'health']) AS topic)""",
)
def j24_condition_overrides(spark, folder):
    parcels = X.parcels(spark, folder)
    base = parcels.select(*PARCEL_KEY, F.explode(F.expr("array('size', 'health')")).alias("topic"), F.lit("x").alias("description"), F.lit(False).alias("available"))
    own = spark.createDataFrame([("KRANJ", "size", " Velja občinska preglednica. ")], "municipality string, topic string, description string")
    return C.apply_overrides(base, parcels, own).select(*PARCEL_KEY, "topic", "description", "available")


def table_lines(spark, folder):
    """A fixed-width table from order lines: a key, a second key and a cell; some continue."""
    o = F.col("l_orderkey")
    return table(spark, folder, "lineitem").groupBy(o.alias("doc_id"), F.col("l_linenumber").alias("n")).agg(
        F.max("l_suppkey").alias("s")
    ).select(
        "doc_id", "n",
        F.concat(
            F.rpad(F.when(F.col("s") % 3 == 0, F.concat(F.lit("IL "), F.col("s"))).otherwise(""), 10, " "),
            F.rpad(F.when(F.col("s") % 9 == 0, "SK").otherwise(""), 5, " "),
            F.when(F.col("s") % 5 > 0, F.concat(F.lit("c"), F.col("n"))).otherwise(""),
        ).alias("line"),
    )


@query(
    "w13_fixed_width_table",
    """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_suppkey) % 3 = 0 AS keyed, max(l_suppkey) AS s, CASE WHEN max(l_suppkey) % 5 > 0 THEN 'c' || l_linenumber ELSE '' END AS cell
      FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM t),
    broken AS (SELECT * FROM r WHERE keyed OR cell = '')
    SELECT k.doc_id, k.n, 'IL ' || k.s AS row_key,
      (SELECT string_agg(CASE WHEN c.keyed AND c.cell = '' THEN '/' ELSE c.cell END, ' ' ORDER BY c.n) FROM r c WHERE c.doc_id = k.doc_id AND (c.n = k.n OR (NOT c.keyed AND c.cell <> ''
        AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.doc_id = k.doc_id AND b.n > least(c.n, k.n) AND b.n < greatest(c.n, k.n))))) AS cell
    FROM r k WHERE k.keyed""",
)
def w13_fixed_width_table(spark, folder):
    return C.fixed_width_table(table_lines(spark, folder), ["doc_id"], "n", [(0, 10), (10, 15)], (15, None))


@query(
    "x15_fold_text",
    X.ctes("page_lines") + f" SELECT doc_id, i, {FOLDED} AS folded FROM page_lines",
)
def x15_fold_text(spark, folder):
    return X.page_lines(spark, folder).select("doc_id", "i", T.fold(F.col("line")).alias("folded"))


@query("x34_clean_lines", X.ctes("page_lines") + r" SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, count(*) AS lines FROM page_lines WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' GROUP BY ALL")
def x34_clean_lines(spark, folder):
    return lines(spark, folder).select("doc_id", "page", F.size("lines").cast("bigint").alias("lines"))


#: Lines of pages without blank ones, numbered from 0, and whether they look like headings.
NUMBERED_LINES = f"""told AS (
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS n, t, strip_accents(replace(lower(t), 'ß', 'ss')) AS folded,
      length(t) <= 150 AND (regexp_matches(t, '^\\d+(?:\\.\\d+){{0,3}}[.)]?\\s+\\S')
        OR coalesce(length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) / nullif(length(regexp_replace(t, '\\P{{L}}', '', 'g')), 0) > 0.86, false)) AS heading
    FROM (SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM LINES) WHERE t <> '')"""


def excerpts_sql(hits: str) -> str:
    """Texts of both forms from the lines in ``hits`` (doc_id, page, n): ``texts (doc_id, page, n, short, long)``."""
    return f"""body AS (
    SELECT h.doc_id, h.page, h.n, l.n AS m, l.t, l.heading, sum(length(l.t) + 1) OVER (PARTITION BY h.doc_id, h.page, h.n ORDER BY l.n) - length(l.t) - 1 AS before
    FROM {hits} h JOIN told l ON l.doc_id = h.doc_id AND l.page = h.page AND l.n BETWEEN h.n AND h.n + 17),
  stops AS (
    SELECT doc_id, page, n, coalesce(min(m) FILTER (m > n AND heading OR before >= 1050 OR m >= n + 12), n + 99) AS a,
      coalesce(min(m) FILTER (heading AND before >= 240 OR before >= 1050), n + 99) AS b FROM body GROUP BY doc_id, page, n),
  joined AS (
    SELECT doc_id, page, n, string_agg(t, ' ' ORDER BY m) FILTER (m < a) AS x, string_agg(t, ' ' ORDER BY m) FILTER (m < b) AS y
    FROM body JOIN stops USING (doc_id, page, n) GROUP BY doc_id, page, n),
  texts AS (
    SELECT doc_id, page, n, CASE WHEN length(x) > 1100 THEN rtrim(substr(x, 1, 1097)) || '…' ELSE x END AS short,
      CASE WHEN length(y) > 1100 THEN rtrim(substr(y, 1, 1097)) || '…' ELSE y END AS long FROM joined)"""


@query(
    "x35_excerpts",
    X.ctes("page_lines") + f", {NUMBERED_LINES.replace('LINES)', 'page_lines)')}, {excerpts_sql('told')} SELECT doc_id, page, CAST(n AS INT) AS line, CAST(length(short) AS INT) AS size FROM texts",
)
def x35_excerpts(spark, folder):
    starts = lines(spark, folder).select("doc_id", "page", "lines", F.posexplode("lines").alias("line", "text"))
    return starts.select("doc_id", "page", "line", F.length(C.excerpt(F.col("lines"), F.col("line"))).alias("size"))


SECTIONS = (
    S.Section("utilization", ("2.1 Stopnja izkoriščenosti zemljišča",)),
    S.Section("setbacks", ("Odmiki od parcelnih mej", "varovalni pas"), 1, 4),
    S.Section("utilities", ("Komunalno opremljanje",), 2),
)
SECTION_ROWS = ", ".join(
    f"('{s.key}', {s.first or 'NULL'}, {s.stop or 'NULL'}, strip_accents(lower('{alias}')))" for s in SECTIONS for alias in s.aliases
)


@query(
    "x35_exact_section",
    X.ctes("page_lines")
    + f""", {NUMBERED_LINES.replace("LINES)", "page_lines)")}, sections(key, first, stop, alias) AS (VALUES {SECTION_ROWS}),
  hits AS (SELECT DISTINCT doc_id, page, n, key FROM told JOIN sections ON contains(folded, alias) WHERE page >= coalesce(first, page) AND page < coalesce(stop, page + 1)),
  places AS (SELECT DISTINCT doc_id, page, n FROM hits), {excerpts_sql("places")}
    SELECT doc_id, key, page, CAST(n AS INT) AS line, CASE WHEN length(short) < 70 THEN long ELSE short END AS excerpt
    FROM hits JOIN texts USING (doc_id, page, n) WHERE length(CASE WHEN length(short) < 70 THEN long ELSE short END) >= 70
    QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY page, n) = 1""",
)
def x35_exact_section(spark, folder):
    return S.exact_sections(X.page_text(spark, folder), SECTIONS)


def act_lines(spark, folder):
    """Lines of acts: some begin the section of a land use."""
    k = F.col("doc_id") + F.col("i")
    begins = F.concat(F.lit("("), F.col("i").cast("string"), F.lit(") "), X.pick(X.CODES, "(doc_id + i) % 10"), F.lit(" – "))
    return X.page_lines(spark, folder).withColumn("line", F.concat(F.when(k % 11 == 3, begins).otherwise(""), F.col("line")))


ACT_LINES = f"""act_lines AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 11 = 3 THEN '(' || i || ') ' || {X.sql_pick(X.CODES, "(doc_id + i) % 10")} || ' – ' ELSE '' END || line AS line FROM page_lines)"""


@query(
    "x35_land_use_section",
    X.ctes("page_lines")
    + f""", {ACT_LINES}, {NUMBERED_LINES.replace("LINES)", "act_lines)")}, wanted AS (SELECT unnest({X.sql_list(X.CODES)}) AS code),
  hits AS (SELECT doc_id, page, n, lower(code) AS code FROM told, wanted WHERE regexp_matches(folded, '^\\(\\d+\\)\\s+' || lower(code) || '\\s*[-–]')),
  places AS (SELECT DISTINCT doc_id, page, n FROM hits), {excerpts_sql("places")}
    SELECT doc_id, code, page, CAST(n AS INT) AS line, short AS excerpt FROM hits JOIN texts USING (doc_id, page, n)
    QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY page, n) = 1""",
)
def x35_land_use_section(spark, folder):
    codes = F.explode(F.array(*[F.lit(c) for c in X.CODES])).alias("code")
    return S.land_use_sections(X.page_text(spark, folder, act_lines(spark, folder)), table(spark, folder, "documents").select("doc_id", codes).distinct())


def unit_lines(spark, folder):
    """The table of planning units of two towns, one row per zone; the factor of some goes on below."""
    z = F.col("zone_id")
    texts = {
        "planning_unit": F.col("planning_unit"), "land_use": F.trim("land_use_code"), "max_fi": F.when(z % 3 > 0, (z % 3).cast("string")).otherwise("/"),
        "max_fz": F.concat(F.lit("0,"), (z % 5 + 2).cast("string")), "min_open_space": F.concat((z % 4 * 10).cast("string"), F.lit("%")),
        "max_floors": F.concat(F.lit("K+P+"), (z % 3).cast("string")), "urban_form": X.pick(["gručasta", "nizi", "bloki"], "zone_id % 3"), "regulation_method": F.lit("PIP"),
    }
    padded = lambda kept: F.concat(F.lit(" " * 20), *[F.rpad(texts[k] if k in kept else F.lit(""), hi - lo, " ") for k, (lo, hi) in S.UNIT_COLUMNS.items() if hi])
    kinds = (set(texts), {"max_fz"}, set())  # the row, what goes on below it, and a blank line
    three = F.array(*[F.struct((z * 3 + n).alias("n"), padded(kept).alias("line")) for n, kept in enumerate(kinds)])
    rows = X.zones(spark, folder).select("zone_id", F.explode(F.when(z % 4 == 1, three).otherwise(F.slice(three, 1, 1))).alias("r"))
    return rows.select((-1 - z % 2).alias("doc_id"), F.lit(1).alias("page"), "r.*")


@query(
    "j24_unit_overrides",
    BASE
    + f""", u AS (
      SELECT 'Kranj' AS town, * FROM zones WHERE zone_id % 2 = 0 UNION ALL SELECT 'Ljubljana', * FROM zones WHERE zone_id % 2 = 1),
    profile AS (
      SELECT town, planning_unit, zone_id, CASE WHEN zone_id % 3 = 0 THEN 'ni posebej določen' ELSE CAST(zone_id % 3 AS VARCHAR) END AS fi,
        '0,' || (zone_id % 5 + 2) || CASE WHEN zone_id % 4 = 1 THEN ' 0,' || (zone_id % 5 + 2) ELSE '' END AS fz,
        (zone_id % 4 * 10) || '%' AS obp, 'K+P+' || (zone_id % 3) AS floors, ['gručasta', 'nizi', 'bloki'][zone_id % 3 + 1] AS form
      FROM u QUALIFY row_number() OVER (PARTITION BY town, planning_unit ORDER BY zone_id) = 1),
    told AS (
      SELECT {KEY}, first(planning_unit ORDER BY zone_id) FILTER (WHERE planning_unit IS NOT NULL) AS planning_unit, first(land_use_code ORDER BY zone_id) FILTER (WHERE trim(land_use_code) <> '') AS code
      FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY {KEY}, act_id, land_use_code, planning_unit, subunit ORDER BY zone_id) = 1) GROUP BY ALL),
    k AS (SELECT {KEY}, p.* FROM told JOIN parcels USING (ko_id, parcel_number) JOIN profile p ON town = municipality AND p.planning_unit = told.planning_unit WHERE code IS NOT NULL)
    SELECT {KEY}, 'development_type' AS topic, replace({X.sql_list([S.UNIT_TEXTS["development_type"].replace("{planning_unit}", "@").replace("{urban_form}", "#")])}[1], '@', planning_unit).replace('#', form) AS description FROM k
    UNION ALL SELECT {KEY}, 'size', replace({X.sql_list([S.UNIT_TEXTS["size"].replace("{planning_unit}", "@").replace("{max_floors}", "#").replace("{fz}", "$")])}[1], '@', planning_unit).replace('#', floors).replace('$', fz) FROM k
    UNION ALL SELECT {KEY}, 'utilization', replace({X.sql_list([S.UNIT_TEXTS["utilization"].replace("{planning_unit}", "@").replace("{max_floors}", "#").replace("{fz}", "$").replace("{fi}", "&").replace("{min_open_space}", "^").replace("{regulation_method}", "PIP")])}[1], '@', planning_unit).replace('#', floors).replace('$', fz).replace('&', fi).replace('^', obp) FROM k""",
)
def j24_unit_overrides(spark, folder):
    """Values of the units alone are compared: the act's own sections have their own queries."""
    acts = spark.createDataFrame([("Kranj", -10, -1), ("Ljubljana", -11, -2)], "municipality string, act_doc long, unit_doc long")
    own = S.unit_overrides(X.parcels(spark, folder), contexts(spark, folder), acts, X.page_text(spark, folder), unit_lines(spark, folder))
    return own.select(*PARCEL_KEY, "topic", "description")
