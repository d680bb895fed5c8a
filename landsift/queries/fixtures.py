"""Inputs derived from the given tables, in Spark and as SQL common table expressions.

Both forms are written separately, so that the SQL check also checks the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.session import table  # noqa: F401

CODES = ["SS", "SK", "A", "CU", "K1", "K2", "G", "VC", "PC", "X9"]
MUNICIPALITIES = ["Ljubljana", "Kranj", "Radovljica", "Gorenja vas-Poljane"]
THEMES = [1100, 2100, 2200, 2300, 3100, 3200, 6100]
VOLTAGES = ["0,4 kV", "20 kV", "110 kV", "400 kV"]
POSITIONS = ["podzemni kablovod", "nadzemni vod", "ni podatka"]
ROADS = ["avtocesta", "hitra cesta", "glavna cesta", "regionalna cesta", "lokalna cesta"]
KINDS = ["prenosni vod", "distribucijski vod", "", "vod"]
STATUSES = ["queued", "running", "completed", "failed", "completed"]
AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Safari/604.1",
    "ExampleBot/1.0 (+http://example.org/bot)",
    "curl/8.0",
]
MODELS = ["model-a", "model-b", None]
PHRASES = [
    "Dopustne dejavnosti",
    "velikost objektov in gabariti objektov se določijo po preglednici",
    "ODMIKI OD PARCELNIH MEJ",
    "uveljavlja predkupno pravico na stavbnih zemljiščih",
    "poplavna območja in erozijska območja",
    "2.1 Stopnja izkoriščenosti zemljišča",
    "varovalni pas, prepoved gradnje objekt",
    "Komunalno opremljanje in vodovodno omrežje",
    "kulturna dediščina in spomenik, dostop do ceste",
    "investitor mora urediti hrup in odpadke",
    "parkirna mesta",
]


def pick(values, index: str):
    """values[index] for a non-negative SQL index expression."""
    items = ", ".join("null" if v is None else "'" + v + "'" if isinstance(v, str) else str(v) for v in values)
    return F.expr(f"element_at(array({items}), cast({index} as int) + 1)")


def sql_list(values) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return "[" + ", ".join(quoted) + "]"


def sql_pick(values, index: str) -> str:
    return f"{sql_list(values)}[CAST({index} AS INT) + 1]"


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles from ``part``."""
    k = F.col("p_partkey")
    return (
        table(spark, folder, "part")
        .select(
            k.alias("k"),
            (1000 + k % 50).alias("ko_id"),
            F.when(k % 5 == 0, k.cast("string"))
            .otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 7 + 1).cast("string")))
            .alias("parcel_number"),
            F.concat(F.lit("E"), k.cast("string")).alias("eid"),
            pick(MUNICIPALITIES, "p_partkey % 4").alias("municipality"),
            ((k * 37) % 1000 * 10).cast("double").alias("x0"),
            ((k * 91) % 1000 * 10).cast("double").alias("y0"),
            (5 + F.col("p_size") % 20).cast("double").alias("w"),
            (5 + k % 13).cast("double").alias("h"),
            F.when(k % 9 == 0, "DA").otherwise("NE").alias("restriction_recorded"),
            pick(["urejena", "Ni  urejena", "v postopku"], "p_partkey % 3").alias("administrative_status"),
        )
        .withColumns(
            {
                "x1": F.col("x0") + F.col("w"),
                "y1": F.col("y0") + F.col("h"),
                "area_m2": (F.col("w") * F.col("h")).cast("bigint"),
            }
        )
        .drop("w", "h")
    )


PARCELS = f"""
    SELECT *, x0 + w AS x1, y0 + h AS y1, CAST(w * h AS BIGINT) AS area_m2 FROM (
    SELECT p_partkey AS k, 1000 + p_partkey % 50 AS ko_id,
      CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR)
           ELSE p_partkey || '/' || (p_partkey % 7 + 1) END AS parcel_number,
      'E' || p_partkey AS eid,
      {sql_pick(MUNICIPALITIES, "p_partkey % 4")} AS municipality,
      CAST((p_partkey * 37) % 1000 * 10 AS DOUBLE) AS x0,
      CAST((p_partkey * 91) % 1000 * 10 AS DOUBLE) AS y0,
      CAST(5 + p_size % 20 AS DOUBLE) AS w, CAST(5 + p_partkey % 13 AS DOUBLE) AS h,
      CASE WHEN p_partkey % 9 = 0 THEN 'DA' ELSE 'NE' END AS restriction_recorded,
      {sql_pick(["urejena", "Ni  urejena", "v postopku"], "p_partkey % 3")} AS administrative_status
    FROM part)"""


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Land-use rectangles from ``supplier``."""
    z = F.col("s_suppkey")
    return (
        table(spark, folder, "supplier")
        .select(
            z.alias("zone_id"),
            (z % 20).alias("act_id"),
            F.concat(F.lit("Akt "), (z % 20).cast("string")).alias("act_title"),
            F.when(z % 11 == 0, F.concat(F.lit(" "), pick(CODES, "s_suppkey % 10"), F.lit(" ")))
            .otherwise(pick(CODES, "s_suppkey % 10"))
            .alias("land_use_code"),
            F.when(z % 3 == 0, F.concat(F.lit("Raba "), (z % 6).cast("string"))).alias("land_use_description"),
            F.concat(F.lit("EUP-"), (z % 8).cast("string")).alias("planning_unit"),
            F.when(z % 4 == 1, F.concat(F.lit("P"), (z % 2).cast("string"))).alias("subunit"),
            ((z * 53) % 100 * 100).cast("double").alias("x0"),
            ((z * 17) % 100 * 100).cast("double").alias("y0"),
            (400 + z % 5 * 150).cast("double").alias("w"),
            (400 + z % 3 * 200).cast("double").alias("h"),
            F.col("s_name"),
            F.col("s_nationkey"),
        )
        .withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")})
        .drop("w", "h")
    )


ZONES = f"""
    SELECT *, x0 + w AS x1, y0 + h AS y1 FROM (
    SELECT s_suppkey AS zone_id, s_suppkey % 20 AS act_id, 'Akt ' || (s_suppkey % 20) AS act_title,
      CASE WHEN s_suppkey % 11 = 0 THEN ' ' || {sql_pick(CODES, "s_suppkey % 10")} || ' '
           ELSE {sql_pick(CODES, "s_suppkey % 10")} END AS land_use_code,
      CASE WHEN s_suppkey % 3 = 0 THEN 'Raba ' || (s_suppkey % 6) END AS land_use_description,
      'EUP-' || (s_suppkey % 8) AS planning_unit,
      CASE WHEN s_suppkey % 4 = 1 THEN 'P' || (s_suppkey % 2) END AS subunit,
      CAST((s_suppkey * 53) % 100 * 100 AS DOUBLE) AS x0,
      CAST((s_suppkey * 17) % 100 * 100 AS DOUBLE) AS y0,
      CAST(400 + s_suppkey % 5 * 150 AS DOUBLE) AS w, CAST(400 + s_suppkey % 3 * 200 AS DOUBLE) AS h,
      s_name, s_nationkey
    FROM supplier)"""


def network_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Axis-parallel 60 m lines from ``customer``."""
    c = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .select(
            c.alias("line_id"),
            F.when(c % 10 != 9, (c % 100).cast("string")).alias("line_eid"),
            pick(THEMES, "c_custkey % 7").cast("string").alias("theme_code"),
            F.lit(None).cast("string").alias("theme_name"),
            pick(KINDS, "c_custkey % 4").alias("kind"),
            F.when(c % 7 == 0, pick(ROADS, "c_custkey % 5"))
            .otherwise(pick(POSITIONS, "c_custkey % 3"))
            .alias("attribute1"),
            pick(VOLTAGES, "c_custkey % 4").alias("attribute2"),
            F.when(c % 13 == 0, "Opuščeni vod").when(c % 13 == 1, "v uporabi").alias("abandonment"),
            ((c * 41) % 1000 * 10).cast("double").alias("x0"),
            ((c * 67) % 1000 * 10).cast("double").alias("y0"),
        )
        .withColumns(
            {
                "x1": F.col("x0") + F.when(F.col("line_id") % 2 == 0, 60.0).otherwise(0.0),
                "y1": F.col("y0") + F.when(F.col("line_id") % 2 == 0, 0.0).otherwise(60.0),
            }
        )
    )


LINES = f"""
    SELECT *, x0 + CASE WHEN line_id % 2 = 0 THEN 60.0 ELSE 0.0 END AS x1,
           y0 + CASE WHEN line_id % 2 = 0 THEN 0.0 ELSE 60.0 END AS y1 FROM (
    SELECT c_custkey AS line_id,
      CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey % 100 AS VARCHAR) END AS line_eid,
      CAST({sql_pick(THEMES, "c_custkey % 7")} AS VARCHAR) AS theme_code,
      CAST(NULL AS VARCHAR) AS theme_name,
      {sql_pick(KINDS, "c_custkey % 4")} AS kind,
      CASE WHEN c_custkey % 7 = 0 THEN {sql_pick(ROADS, "c_custkey % 5")}
           ELSE {sql_pick(POSITIONS, "c_custkey % 3")} END AS attribute1,
      {sql_pick(VOLTAGES, "c_custkey % 4")} AS attribute2,
      CASE c_custkey % 13 WHEN 0 THEN 'Opuščeni vod' WHEN 1 THEN 'v uporabi' END AS abandonment,
      CAST((c_custkey * 41) % 1000 * 10 AS DOUBLE) AS x0,
      CAST((c_custkey * 67) % 1000 * 10 AS DOUBLE) AS y0
    FROM customer)"""

PARCEL_KEYS = """
    SELECT p_partkey AS k, 1000 + p_partkey % 50 AS ko_id,
      CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR)
           ELSE p_partkey || '/' || (p_partkey % 7 + 1) END AS parcel_number
    FROM part"""


def direct_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects recorded on a parcel, one per order line."""
    k = F.col("l_partkey")
    return (
        table(spark, folder, "lineitem")
        .select(
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_suppkey")).alias("ord"),
            (1000 + k % 50).alias("ko_id"),
            F.when(k % 5 == 0, k.cast("string"))
            .otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 7 + 1).cast("string")))
            .alias("parcel_number"),
            F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey").cast("string")).alias("object_eid"),
            pick(THEMES, "l_suppkey % 7").cast("string").alias("theme_code"),
            pick(["Vodovod", "Kanalizacija", None], "l_orderkey % 3").alias("theme_name"),
            pick(KINDS, "l_suppkey % 4").alias("kind"),
            pick(POSITIONS, "l_orderkey % 3").alias("attribute1"),
            pick(VOLTAGES, "l_suppkey % 4").alias("attribute2"),
            (F.col("l_orderkey") % 3).cast("int").alias("relation"),
        )
    )


DIRECT = f"""
    SELECT (l_orderkey * 8 + l_linenumber) * 10000000 + l_suppkey AS ord, 1000 + l_partkey % 50 AS ko_id,
      CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS VARCHAR)
           ELSE l_partkey || '/' || (l_partkey % 7 + 1) END AS parcel_number,
      CASE WHEN l_suppkey % 17 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS object_eid,
      CAST({sql_pick(THEMES, "l_suppkey % 7")} AS VARCHAR) AS theme_code,
      {sql_pick(["Vodovod", "Kanalizacija", None], "l_orderkey % 3")} AS theme_name,
      {sql_pick(KINDS, "l_suppkey % 4")} AS kind,
      {sql_pick(POSITIONS, "l_orderkey % 3")} AS attribute1,
      {sql_pick(VOLTAGES, "l_suppkey % 4")} AS attribute2,
      CAST(l_orderkey % 3 AS INT) AS relation
    FROM lineitem"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request log from ``events``, before any normalising."""
    return requests_of(table(spark, folder, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """The same for a batch or a stream of events."""
    e = F.col("event_id")
    return events.select(
        F.concat(F.lit("R"), e.cast("string")).alias("request_id"),
        F.md5(e.cast("string")).alias("job_id"),
        F.col("ts").alias("requested_at"),
        F.concat((1000 + e % 50).cast("string"), F.lit(" "), (e % 500).cast("string")).alias("parcel_reference"),
        F.when(e % 3 != 0, F.concat(F.lit("visitor-"), F.col("user_id").cast("string"))).alias("visitor_id"),
        F.concat(F.lit("192.0.2."), (F.col("user_id") % 250).cast("string")).alias("ip_address"),
        pick(AGENTS, "event_id % 8").alias("user_agent"),
        pick(
            ["https://Search.Example.org/q?x=1", "", None, "not a url", "http://user@host.example.com:8080/p"],
            "event_id % 5",
        ).alias("referer"),
        F.lit("sl").alias("accept_language"),
        (e % 3 != 0).alias("analytics_consent"),
        F.when(e % 3 != 0, pick(["2026-01", "2025-01"], "event_id % 2")).alias("consent_version"),
        F.when(F.col("event_type") == "click", "running")
        .when(F.col("event_type") == "view", "completed")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("queued")
        .alias("status"),
    )


REQUESTS = f"""
    SELECT 'R' || event_id AS request_id, md5(CAST(event_id AS VARCHAR)) AS job_id, ts AS requested_at,
      (1000 + event_id % 50) || ' ' || (event_id % 500) AS parcel_reference,
      CASE WHEN event_id % 3 <> 0 THEN 'visitor-' || user_id END AS visitor_id,
      '192.0.2.' || (user_id % 250) AS ip_address,
      {sql_pick(AGENTS, "event_id % 8")} AS user_agent,
      {sql_pick(["https://Search.Example.org/q?x=1", "", None, "not a url", "http://user@host.example.com:8080/p"], "event_id % 5")} AS referer,
      'sl' AS accept_language, event_id % 3 <> 0 AS analytics_consent,
      CASE WHEN event_id % 3 <> 0 THEN {sql_pick(["2026-01", "2025-01"], "event_id % 2")} END AS consent_version,
      CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed'
        WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
      event_id, event_type, user_id, CAST(props->>'k' AS BIGINT) AS k
    FROM events"""


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines with planning phrases and parcel numbers mixed in; 20 lines a page."""
    d, i = F.col("doc_id"), F.col("i")
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .withColumn(
            "line",
            F.concat(
                F.when((d + i) % 9 == 4, F.concat(pick(PHRASES, f"(doc_id + i) % {len(PHRASES)}"), F.lit(" "))).otherwise(""),
                F.col("line"),
                F.when(
                    (d + i) % 7 == 0,
                    F.concat(
                        F.lit(" parcela "),
                        ((d * 13 + i) % 2000).cast("string"),
                        F.lit(" / "),
                        (((d * 13 + i) % 2000) % 7 + 1).cast("string"),
                        F.lit(" in "),
                        ((d + i) % 300).cast("string"),
                        F.lit("."),
                    ),
                ).otherwise(""),
            ),
        )
    )


PAGE_LINES = f"""
    SELECT doc_id, i,
      CASE WHEN (doc_id + i) % 9 = 4 THEN {sql_pick(PHRASES, f"(doc_id + i) % {len(PHRASES)}")} || ' ' ELSE '' END
      || line ||
      CASE WHEN (doc_id + i) % 7 = 0 THEN ' parcela ' || ((doc_id * 13 + i) % 2000) || ' / '
           || (((doc_id * 13 + i) % 2000) % 7 + 1) || ' in ' || ((doc_id + i) % 300) || '.' ELSE '' END AS line
    FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def page_text(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Pages of the documents, or of other lines of theirs: ``doc_id, page, text``."""
    lines = page_lines(spark, folder) if lines is None else lines
    return (
        lines.groupBy("doc_id", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))
        .select("doc_id", "page", F.array_join(F.col("lines.line"), "\n").alias("text"))
    )


PAGE_TEXT = """
    SELECT doc_id, CAST(i // 20 + 1 AS INT) AS page, string_agg(line, chr(10) ORDER BY i) AS text
    FROM page_lines GROUP BY ALL"""

CTES = {
    "parcels": (PARCELS, ()),
    "zones": (ZONES, ()),
    "lines": (LINES, ()),
    "direct": (DIRECT, ()),
    "requests": (REQUESTS, ()),
    "page_lines": (PAGE_LINES, ()),
    "page_text": (PAGE_TEXT, ("page_lines",)),
    "parcel_keys": (PARCEL_KEYS, ()),
}


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named inputs and what they need."""
    ordered: list[str] = []

    def add(name):
        body, needs = CTES[name]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered)
