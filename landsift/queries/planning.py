"""Land use, acts and the box join itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import geometry as G
from landsift.functions import rules as R
from landsift.operators import planning as P
from landsift.operators.spatial_join import box_join
from landsift.queries import fixtures as X
from landsift.queries import query
from landsift.session import table

KEY = "ko_id, parcel_number"
OVERLAP = "(least(p.x1, z.x1) - greatest(p.x0, z.x0)) * (least(p.y1, z.y1) - greatest(p.y0, z.y0))"
TOUCH = "p.x0 <= z.x1 AND z.x0 <= p.x1 AND p.y0 <= z.y1 AND z.y0 <= p.y1"


def even(expr: str, digits: int) -> str:
    """Half-even rounding of the decimal value."""
    return f"CAST(round_even(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def sql_map(values: dict, key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {cases} END"


def zones_in(spark, folder):
    return X.zones(spark, folder).select(
        F.col("zone_id").alias("ord"),
        "act_id",
        "act_title",
        "land_use_code",
        "land_use_description",
        "planning_unit",
        "subunit",
        "x0",
        "y0",
        "x1",
        "y1",
    )


def recorded(spark, folder):
    """Recorded land use, one share per order line."""
    k = F.col("l_partkey")
    names = [None, "gozdna zemljišča", "stanovanjska zemljišča", "kmetijska zemljišča"]
    return (
        table(spark, folder, "lineitem")
        .select(
            F.concat(F.lit("E"), k.cast("string")).alias("eid"),
            F.struct("l_orderkey", "l_suppkey", "l_linenumber").alias("ord"),
            F.coalesce(X.pick(names, "l_suppkey % 4"), F.lit("Unknown")).alias("name"),
            F.col("l_quantity").alias("share_percent"),
        )
    )


RECORDED = f"""recorded AS (
    SELECT 'E' || l_partkey AS eid, l_orderkey, l_suppkey,
      coalesce({X.sql_pick([None, "gozdna zemljišča", "stanovanjska zemljišča", "kmetijska zemljišča"], "l_suppkey % 4")}, 'Unknown') AS name,
      l_quantity AS share_percent, l_linenumber FROM lineitem)"""


@query(
    "j0_box_join",
    X.ctes("parcels", "zones")
    + f"SELECT p.k, z.zone_id, greatest(0, {OVERLAP}) AS overlap FROM parcels p JOIN zones z ON {TOUCH}",
)
def j0_box_join(spark, folder):
    p = X.parcels(spark, folder).select("k", "x0", "y0", "x1", "y1")
    z = X.zones(spark, folder).select("zone_id", "x0", "y0", "x1", "y1")
    return box_join(p, z).select("k", "zone_id", G.box_overlap().alias("overlap"))


@query(
    "f2_bbox_candidates",
    X.ctes("parcels", "lines")
    + "".join(
        f"{' UNION ALL ' if i else ''}SELECT {m} AS margin, p.k, z.line_id FROM parcels p JOIN lines z ON "
        f"p.x0 <= z.x1 + {m} AND z.x0 - {m} <= p.x1 AND p.y0 <= z.y1 + {m} AND z.y0 - {m} <= p.y1"
        for i, m in enumerate(["0.0::DOUBLE", "0.25::DOUBLE", "70.0::DOUBLE", "100.0::DOUBLE"])
    ),
)
def f2_bbox_candidates(spark, folder):
    p = X.parcels(spark, folder).select("k", "x0", "y0", "x1", "y1")
    lines = X.network_lines(spark, folder).select("line_id", "x0", "y0", "x1", "y1")
    # one join at the widest margin; the narrower answers are filters of it
    near = box_join(p, lines, margin=100.0)
    margins = F.array(*[F.lit(m) for m in (0.0, 0.25, 70.0, 100.0)])
    m = F.col("margin")
    return (
        near.withColumn("margin", F.explode(margins))
        .filter(
            (F.col("x0") <= F.col("r_x1") + m)
            & (F.col("r_x0") - m <= F.col("x1"))
            & (F.col("y0") <= F.col("r_y1") + m)
            & (F.col("r_y0") - m <= F.col("y1"))
        )
        .select("margin", "k", "line_id")
    )


@query(
    "f3_intersects",
    X.ctes("parcels", "zones") + f"SELECT p.k, z.zone_id FROM parcels p JOIN zones z ON {TOUCH}",
)
def f3_intersects(spark, folder):
    p = X.parcels(spark, folder)
    z = X.zones(spark, folder)
    p = p.select("k", "x0", "y0", "x1", "y1").withColumn("geom", G.box_geometry())
    z = z.select("zone_id", "x0", "y0", "x1", "y1").withColumn("geom", G.box_geometry())
    return P.touching(P.shape_join(p, z)).select("k", "zone_id")


def acts_of(spark, folder):
    """Completed and in-preparation act areas."""
    z = X.zones(spark, folder).select(
        F.col("zone_id").alias("ord"),
        F.when(F.col("zone_id") % 19 != 18, F.col("act_id")).alias("procedure_id"),
        (F.col("act_id") + 500).alias("act_ref"),
        F.when(F.col("zone_id") % 5 != 0, F.concat(F.lit("Akt "), F.col("zone_id"))).alias("title"),
        F.lit("OPN").alias("act_type"),
        F.when(F.col("zone_id") % 2 == 0, "sprejet").alias("status"),
        F.lit(None).cast("string").alias("page_url"),
        "x0",
        "y0",
        "x1",
        "y1",
    )
    return z.filter(F.col("ord") % 3 > 0), z.filter(F.col("ord") % 3 == 0)


ACTS = f"""acts AS (
    SELECT zone_id AS ord, act_id AS procedure_id, act_id + 500 AS act_ref,
      coalesce(CASE WHEN zone_id % 5 <> 0 THEN 'Akt ' || zone_id END, 'PIS act ' || act_id) AS title,
      CASE WHEN zone_id % 2 = 0 THEN 'sprejet' END AS status,
      CASE WHEN zone_id % 3 > 0 THEN 'completed' ELSE 'in preparation' END AS preparation_state, x0, y0, x1, y1
    FROM zones WHERE zone_id % 19 <> 18)"""
FOUND_ACTS = f"""found AS (
    SELECT {KEY}, procedure_id, act_ref, title, 'OPN' AS act_type, z.status, preparation_state
    FROM parcels p JOIN acts z ON {TOUCH}
    QUALIFY row_number() OVER (PARTITION BY {KEY}, procedure_id
      ORDER BY CASE WHEN preparation_state = 'completed' THEN 0 ELSE 1 END,
               CASE WHEN preparation_state = 'completed' THEN -ord ELSE ord END) = 1)"""


@query("j5_find_acts", X.ctes("parcels", "zones") + f", {ACTS}, {FOUND_ACTS} SELECT * FROM found")
def j5_find_acts(spark, folder):
    return P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder)).drop("page_url")


@query(
    "w1_priority_pick",
    X.ctes("parcels", "zones")
    + f", {ACTS}, {FOUND_ACTS} SELECT preparation_state, count(*) AS picked, count(DISTINCT procedure_id) AS procedures FROM found GROUP BY 1",
)
def w1_priority_pick(spark, folder):
    acts = P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder))
    return acts.groupBy("preparation_state").agg(
        F.count("*").alias("picked"), F.countDistinct("procedure_id").alias("procedures")
    )


@query(
    "k1_acts_ordered",
    X.ctes("parcels", "zones")
    + f""", {ACTS}, {FOUND_ACTS}
    SELECT {KEY}, procedure_id, title, row_number() OVER (PARTITION BY {KEY} ORDER BY preparation_state, title, procedure_id) AS position
    FROM found""",
)
def k1_acts_ordered(spark, folder):
    acts = P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder))
    w = P_window("preparation_state", "title", "procedure_id")
    return acts.select(*PARCEL_KEY, "procedure_id", "title", F.row_number().over(w).alias("position"))


def P_window(*order):
    from pyspark.sql import Window

    return Window.partitionBy(*PARCEL_KEY).orderBy(*order)


@query(
    "u1_tagged_acts",
    X.ctes("zones")
    + f", {ACTS} SELECT ord, procedure_id, preparation_state FROM acts",
)
def u1_tagged_acts(spark, folder):
    done, open_ = acts_of(spark, folder)
    return (
        done.withColumn("preparation_state", F.lit("completed"))
        .unionByName(open_.withColumn("preparation_state", F.lit("in preparation")))
        .filter(F.col("procedure_id").isNotNull())
        .select("ord", "procedure_id", "preparation_state")
    )


PAIRS = f"""pairs AS (
    SELECT {KEY}, p.area_m2, z.*, {OVERLAP} AS overlap FROM parcels p JOIN zones z
    ON p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1 WHERE {OVERLAP} > 0.01)"""
CONTEXT = f"""context AS (
    SELECT {KEY}, act_id, act_title, nullif(trim(land_use_code), '') AS land_use_code,
      nullif(trim(land_use_description), '') AS land_use_description, planning_unit, subunit,
      {even("100 * overlap / area_m2", 1)} AS parcel_share_percent
    FROM pairs QUALIFY row_number() OVER (PARTITION BY {KEY}, act_id, pairs.land_use_code, planning_unit, subunit ORDER BY zone_id) = 1)"""
SHARES = f"""shares AS (
    SELECT {KEY}, code, name, share_percent, {even("area_m2 * share_percent / 100", 1)} AS parcel_area_m2 FROM (
      SELECT {KEY}, upper(land_use_code) AS code,
        coalesce(land_use_description, {sql_map(R.LAND_USE_NAMES, "upper(land_use_code)")}, '{R.LAND_USE_DEFAULT_NAME}') AS name,
        least(100.0, CAST(sum(CAST(parcel_share_percent AS DECIMAL(14,1))) AS DOUBLE)) AS share_percent
      FROM context GROUP BY ALL) JOIN parcels USING (ko_id, parcel_number))"""


def sql_in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CLASS = f"""CASE
      WHEN code IN {sql_in(R.RESIDENTIAL_CODES)} OR lower(name) LIKE '%stanovanj%' THEN 'residential'
      WHEN code = 'A' OR lower(name) LIKE '%razpršene poselitve%' THEN 'dispersed'
      WHEN code IN {sql_in(R.CONDITIONAL_CODES)} OR lower(name) LIKE '%centralnih dejavnosti%' THEN 'conditional'
      WHEN code IN {sql_in(R.RESTRICTIVE_CODES)} OR regexp_matches(lower(name), '{"|".join(R.RESTRICTIVE_NAMES)}') THEN 'restrictive'
      ELSE 'other' END"""
TONE = f"CASE {CLASS} WHEN 'residential' THEN 'positive' WHEN 'dispersed' THEN 'caution' WHEN 'conditional' THEN 'caution' WHEN 'restrictive' THEN 'concern' ELSE 'unknown' END"
ITEMS = f"""items AS (
    SELECT *, {TONE} AS tone, {sql_map(R.LAND_USE_LABELS, CLASS)} AS label FROM (
      SELECT * FROM shares UNION ALL
      SELECT {KEY}, NULL AS code, r.name, r.share_percent, {even("area_m2 * r.share_percent / 100", 1)}
      FROM recorded r JOIN parcels USING (eid) ANTI JOIN context USING (ko_id, parcel_number)))"""
BASE = X.ctes("parcels", "zones") + f", {PAIRS}, {CONTEXT}"


def contexts(spark, folder, dedupe="first"):
    return P.planning_context(X.parcels(spark, folder), zones_in(spark, folder), dedupe)


def items(spark, folder):
    parcels = X.parcels(spark, folder)
    land = recorded(spark, folder).join(parcels.select("eid", *PARCEL_KEY).hint("merge"), "eid")
    return P.land_use_items(parcels, contexts(spark, folder), land)


@query("j6_planning_context", BASE + " SELECT * FROM context")
def j6_planning_context(spark, folder):
    return contexts(spark, folder).drop("ord")


@query(
    "j6_planning_context_sum",
    BASE
    + f""" SELECT {KEY}, act_id, trim(land_use_code) AS land_use_code, planning_unit, subunit,
    CAST(sum(CAST({even("100 * overlap / area_m2", 1)} AS DECIMAL(14,1))) AS DOUBLE) AS parcel_share_percent
    FROM pairs GROUP BY ALL""",
)
def j6_planning_context_sum(spark, folder):
    return contexts(spark, folder, "sum").drop("ord", "act_title", "land_use_description")


@query(
    "w2_keep_first",
    BASE + f" SELECT {KEY}, count(*) AS kept, count(DISTINCT act_id) AS acts FROM context GROUP BY ALL",
)
def w2_keep_first(spark, folder):
    return contexts(spark, folder).groupBy(*PARCEL_KEY).agg(
        F.count("*").alias("kept"), F.countDistinct("act_id").alias("acts")
    )


@query(
    "f7_select_props",
    "SELECT s_suppkey AS fid, s_name AS \"IME\", CAST(s_nationkey AS VARCHAR) AS \"KODA\", CAST(NULL AS VARCHAR) AS \"MANJKA\" FROM supplier",
)
def f7_select_props(spark, folder):
    from landsift.sources.features import select_props

    s = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("fid"),
        F.create_map(
            F.lit("IME"), F.col("s_name"), F.lit("KODA"), F.col("s_nationkey").cast("string"), F.lit("STANJE"), F.col("s_acctbal").cast("string")
        ).alias("props"),
    )
    return select_props(s, ["IME", "KODA", "MANJKA"]).drop("props")


@query("a4_land_use_shares", BASE + f", {SHARES} SELECT *, {TONE} AS tone, {sql_map(R.LAND_USE_LABELS, CLASS)} AS label FROM shares")
def a4_land_use_shares(spark, folder):
    return P.land_use_shares(X.parcels(spark, folder), contexts(spark, folder))


@query("x22_classify_land_use", BASE + f", {SHARES} SELECT code, name, {TONE} AS tone, count(*) AS n FROM shares GROUP BY ALL")
def x22_classify_land_use(spark, folder):
    return P.land_use_shares(X.parcels(spark, folder), contexts(spark, folder)).groupBy("code", "name", "tone").agg(
        F.count("*").alias("n")
    )


@query(
    "k2_land_use_ordered",
    BASE
    + f""", {SHARES}, {RECORDED}, {ITEMS}
    SELECT {KEY}, code, name, share_percent, row_number() OVER (PARTITION BY {KEY}
      ORDER BY share_percent DESC NULLS LAST, coalesce(code, ''), name) AS position FROM items""",
)
def k2_land_use_ordered(spark, folder):
    w = P_window(F.col("share_percent").desc_nulls_last(), F.coalesce("code", F.lit("")), "name")
    return items(spark, folder).select(
        *PARCEL_KEY, "code", "name", "share_percent", F.row_number().over(w).alias("position")
    )


@query(
    "a5_land_use_assessment",
    BASE
    + f""", {SHARES}, {RECORDED}, {ITEMS}, tones AS (
      SELECT {KEY}, count(i.tone) AS items,
        CASE WHEN count(i.tone) = 0 OR bool_and(i.tone = 'unknown') THEN 'unknown'
             WHEN bool_and(i.tone = 'positive') THEN 'positive'
             WHEN bool_and(i.tone = 'concern') THEN 'concern' ELSE 'caution' END AS tone
      FROM parcels LEFT JOIN items i USING (ko_id, parcel_number) GROUP BY ALL)
    SELECT *, {sql_map(R.OVERALL_LABELS, "tone")} AS label FROM tones""",
)
def a5_land_use_assessment(spark, folder):
    return P.overall_tone(X.parcels(spark, folder), items(spark, folder))


@query(
    "j14_zone_of_centre",
    X.ctes("parcels", "zones")
    + f""" SELECT {KEY}, first(upper(planning_unit) ORDER BY zone_id) AS zone_label
    FROM parcels p JOIN zones z ON p.municipality = {X.sql_pick(X.MUNICIPALITIES, "z.zone_id % 4")}
     AND (p.x0 + p.x1) / 2 BETWEEN z.x0 AND z.x1 AND (p.y0 + p.y1) / 2 BETWEEN z.y0 AND z.y1 GROUP BY ALL""",
)
def j14_zone_of_centre(spark, folder):
    z = X.zones(spark, folder).select(
        F.concat(F.lit(" "), X.pick(X.MUNICIPALITIES, "zone_id % 4")).alias("municipality"),
        F.col("zone_id").alias("ord"),
        F.lower("planning_unit").alias("zone_label"),
        "x0",
        "y0",
        "x1",
        "y1",
    )
    return P.zone_of_centre(X.parcels(spark, folder), z)


def act_documents(spark, folder):
    """Documents per act of a parcel: order lines stand for (parcel, document) rows."""
    k = F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        (1000 + k % 50).alias("ko_id"),
        F.when(k % 5 == 0, k.cast("string"))
        .otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 7 + 1).cast("string")))
        .alias("parcel_number"),
        (F.col("l_suppkey") % 20).alias("act_id"),
        F.col("l_quantity").cast("bigint").alias("mention_count"),
    )


ACT_DOCUMENTS = f"""docs AS (
    SELECT 1000 + l_partkey % 50 AS ko_id, CASE WHEN l_partkey % 5 = 0 THEN CAST(l_partkey AS VARCHAR)
      ELSE l_partkey || '/' || (l_partkey % 7 + 1) END AS parcel_number, l_suppkey % 20 AS procedure_id,
      CAST(l_quantity AS BIGINT) AS mention_count FROM lineitem)"""


@query(
    "j15_act_document_counts",
    X.ctes("parcels", "zones")
    + f""", {ACTS}, {FOUND_ACTS}, {ACT_DOCUMENTS}
    SELECT {KEY}, procedure_id, title, count(mention_count) AS document_count,
      CAST(coalesce(sum(mention_count), 0) AS BIGINT) AS literal_mention_count
    FROM found LEFT JOIN docs USING (ko_id, parcel_number, procedure_id) GROUP BY ALL""",
)
def j15_act_document_counts(spark, folder):
    acts = P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder))
    return P.act_document_counts(acts.select(*PARCEL_KEY, "procedure_id", "title"), act_documents(spark, folder))


@query(
    "a20_act_result_counts",
    X.ctes("parcels", "zones")
    + f""", {ACTS}, {FOUND_ACTS}, {ACT_DOCUMENTS}
    SELECT {KEY}, count(DISTINCT procedure_id) AS acts, count(mention_count) AS documents
    FROM found LEFT JOIN docs USING (ko_id, parcel_number, procedure_id) GROUP BY ALL""",
)
def a20_act_result_counts(spark, folder):
    acts = P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder))
    counted = P.act_document_counts(acts.select(*PARCEL_KEY, "procedure_id"), act_documents(spark, folder))
    return counted.groupBy(*PARCEL_KEY).agg(
        F.count("*").alias("acts"), F.sum("document_count").alias("documents")
    )


@query(
    "j16_act_contexts",
    BASE
    + f""", {ACTS}, {FOUND_ACTS}
    SELECT {KEY}, procedure_id, title, land_use_code, planning_unit, subunit, parcel_share_percent
    FROM found LEFT JOIN (SELECT * RENAME (act_id AS procedure_id) FROM context) USING (ko_id, parcel_number, procedure_id)""",
)
def j16_act_contexts(spark, folder):
    acts = P.find_acts(X.parcels(spark, folder), *acts_of(spark, folder)).select(*PARCEL_KEY, "procedure_id", "title")
    return P.act_contexts(acts, contexts(spark, folder)).select(
        *PARCEL_KEY, "procedure_id", "title", "land_use_code", "planning_unit", "subunit", "parcel_share_percent"
    )
