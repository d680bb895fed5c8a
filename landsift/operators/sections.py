"""Sections of a planning act by heading, by land-use code and by planning unit.

Pages are searched all at once: every page makes the excerpts of its own hits, and the first
place in reading order that holds is a minimum per document and section, so no task walks
through a document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift import PARCEL_KEY
from landsift.functions import phrases as PH
from landsift.functions import text as T
from landsift.operators import conditions as C


@dataclass(frozen=True)
class Section:
    """A section by its headings, on pages from ``first`` up to, without, ``stop`` (no bound: None)."""

    key: str
    aliases: tuple[str, ...]
    first: int | None = None
    stop: int | None = None


# Topics of one municipality's act, their headings, and the pages they stand on.
ACT_SECTIONS = (
    Section("construction", ("2.1.2 Dopustne vrste gradenj",), 20, 28),
    Section("functional_design", ("2.4.1.1 Urbanistično oblikovanje - splošni pogoji",), 27, 31),
    Section("surroundings", ("2.4.10 Pogoji za oblikovanje okolice objektov",), 39, 43),
    Section("building_plot", ("2.5.1 Pogoji za oblikovanje parcel, namenjenih gradnji",), 40, 44),
    Section("environment", ("2.7.3.1 Splošni pogoji",), 54, 59),
    Section("hazards", ("2.7.5.1 Splošni pogoji",), 59, 64),
)
# Columns of the table of planning units, as places of characters.
UNIT_COLUMNS = {
    "planning_unit": (20, 45), "land_use": (45, 67), "max_fi": (67, 80), "max_fz": (80, 104), "min_open_space": (104, 121),
    "max_floors": (121, 147), "urban_form": (147, 180), "regulation_method": (180, 202), "special_provision": (202, None),
}
# Topics that take the section of the land use, and the wording of a unit's values.
LAND_USE_TOPICS = ("activities", "objects")
NOT_SET = "ni posebej določen"
UNIT_TEXTS = {
    "development_type": (
        "Za EUP {planning_unit} je določen način urbanističnega oblikovanja »{urban_form}«. Pri gručasti zazidavi je treba "
        "ohranjati tradicionalni vzorec stavb v gručah, obstoječe dominante, značilne poglede in avtohtono vegetacijo na robu naselja."
    ),
    "size": (
        "Za EUP {planning_unit} je največja etažnost {max_floors}. Največji faktor zazidanosti (FZ): {fz}. Tlorisni gabarit je "
        "treba določiti glede na namen stavbe, velikost parcele in dovoljeno stopnjo izkoriščenosti."
    ),
    "utilization": (
        "Za EUP {planning_unit}: največji FI {fi}, največji FZ {fz}, najmanjši delež odprtih bivalnih površin (OBP) {min_open_space} "
        "in največja etažnost {max_floors}. Način urejanja: {regulation_method}."
    ),
}


def single_column_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page, lines, folded``: lines of pages that are one column wide, words joined."""
    whole = F.regexp_replace("text", C.BROKEN_WORD, "")
    lines = F.filter(F.transform(F.split(whole, T.LINE_BREAK, -1), T.squeeze), lambda x: x != "")
    # as a row of its own, so that no filter on the lines works them out again
    rows = pages.select("doc_id", "page", F.explode(F.array(lines)).alias("lines")).filter(F.size("lines") > 0)
    return rows.withColumn("folded", F.transform("lines", T.fold))


def section_excerpt(lines: Column, at: Column) -> Column:
    """Twelve lines from a heading; where that is short, 18 that headings end only late."""
    short = C.excerpt(lines, at)
    long = C.excerpt(lines, at, C.SECTION_LINES, C.SECTION_KEEP)
    return F.when(F.length(short) < C.SHORTEST, long).otherwise(short)


def exact_sections(pages: DataFrame, sections: Sequence[Section]) -> DataFrame:
    """The first long enough excerpt under a heading: ``doc_id, key, page, line, excerpt``.

    A heading is a line that holds one of the section's aliases."""
    told = [(n, alias) for n, s in enumerate(sections) for alias in s.aliases]
    names = PH.folded(pages.sparkSession, [alias for _, alias in told])
    column = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    of, keys = column([n for n, _ in told], "int"), column([s.key for s in sections], "string")
    first, stop = column([s.first for s in sections], "int"), column([s.stop for s in sections], "int")
    if all(s.first is not None and s.stop is not None for s in sections):
        pages = pages.filter((F.col("page") >= min(s.first for s in sections)) & (F.col("page") < max(s.stop for s in sections)))
    found = single_column_lines(pages).withColumn("hits", PH.phrase_hits(F.col("folded"), names))
    numbered = F.array_distinct(F.transform("hits", lambda h: F.struct(h["line"].alias("line"), F.get(of, h["phrase"]).alias("s"))))
    here = F.filter(
        numbered,
        lambda h: (F.col("page") >= F.coalesce(F.get(first, h["s"]), F.col("page")))
        & (F.col("page") < F.coalesce(F.get(stop, h["s"]), F.col("page") + 1)),
    )
    at = F.array_distinct(F.col("here.line"))
    rows = found.withColumn("here", here).filter(F.size("here") > 0)
    rows = rows.withColumn("texts", F.map_from_arrays(at, F.transform(at, lambda n: section_excerpt(F.col("lines"), n))))
    placed = F.transform("here", lambda h: F.struct(h["line"].alias("line"), h["s"].alias("s"), F.element_at(F.col("texts"), h["line"]).alias("excerpt")))
    each = rows.select("doc_id", "page", F.explode(placed).alias("h")).select("doc_id", "page", "h.*").filter(F.length("excerpt") >= C.SHORTEST)
    best = each.groupBy("doc_id", "s").agg(F.min_by(F.struct("page", "line", "excerpt"), F.struct("page", "line")).alias("b"))
    return best.select("doc_id", F.get(keys, F.col("s")).alias("key"), "b.*")


def land_use_sections(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The excerpt from the first line ``(n) CODE - ...`` of each wanted code.

    ``wanted``: ``doc_id, code``; comes back as ``doc_id, code, page, line, excerpt``, the code folded."""
    lines = single_column_lines(pages)
    body = lambda x: F.regexp_extract(x, r"^\(\d+\)\s+(.*)$", 1)

    def codes(x):
        """What stands before each dash, as a code may hold dashes itself."""
        parts = F.split(body(x), "[-–]", -1)
        ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(-1), lambda n, p: n + F.length(p) + 1))
        return F.when(F.size(parts) > 1, F.transform(ends, lambda n: F.rtrim(F.substr(body(x), F.lit(1), n))))

    hits = F.filter(F.transform("folded", lambda x, i: F.struct(i.alias("line"), codes(x).alias("codes"))), lambda h: h["codes"].isNotNull())
    rows = lines.withColumn("hits", hits).filter(F.size("hits") > 0)
    placed = F.transform("hits", lambda h: F.struct(h["line"].alias("line"), h["codes"].alias("codes"), C.excerpt(F.col("lines"), h["line"]).alias("excerpt")))
    each = rows.select("doc_id", "page", F.explode(placed).alias("h")).select("doc_id", "page", "h.line", "h.excerpt", F.explode("h.codes").alias("code"))
    asked = wanted.select("doc_id", T.fold(F.col("code")).alias("code")).filter(F.col("code") != "").distinct()
    best = each.join(asked, ["doc_id", "code"]).groupBy("doc_id", "code").agg(F.min_by(F.struct("page", "line", "excerpt"), F.struct("page", "line")).alias("b"))
    return best.select("doc_id", "code", "b.*")


def unit_profiles(lines: DataFrame) -> DataFrame:
    """Values of every planning unit in tables of fixed columns; the first row of a unit counts.

    ``lines``: ``doc_id, page, n, line``. The building factor may go on above and below its row;
    other empty values read ``/``. ``unit`` is the folded name."""
    def cut(bounds):
        lo, hi = bounds
        return T.squeeze(F.substr("line", F.lit(lo + 1)) if hi is None else F.substring("line", lo + 1, hi - lo))

    keys = [UNIT_COLUMNS["planning_unit"], UNIT_COLUMNS["land_use"]]
    rows = lines.select("doc_id", "page", "n", *[cut(v).alias(k) for k, v in UNIT_COLUMNS.items()]).filter("planning_unit <> ''")
    factor = C.fixed_width_table(lines, ["doc_id", "page"], "n", keys, UNIT_COLUMNS["max_fz"]).select("doc_id", "page", "n", F.col("cell").alias("max_fz"))
    whole = rows.drop("max_fz").join(factor, ["doc_id", "page", "n"])
    values = {k: F.when(F.col(k) == "", "/").otherwise(F.col(k)) for k in UNIT_COLUMNS if k != "planning_unit"}
    whole = whole.withColumns(values).withColumn("unit", T.fold(F.col("planning_unit")))
    row = F.struct("page", "n", *UNIT_COLUMNS)
    return whole.groupBy("doc_id", "unit").agg(F.min_by(row, F.struct("page", "n")).alias("r")).select("doc_id", "unit", "r.*")


def _shown(value: Column) -> Column:
    return F.when(F.trim(value) == "/", NOT_SET).otherwise(value)


def unit_overrides(
    parcels: DataFrame, contexts: DataFrame, acts: DataFrame, pages: DataFrame, unit_lines: DataFrame,
    sections: Sequence[Section] = ACT_SECTIONS, fixed: DataFrame | None = None,
) -> DataFrame:
    """A municipality's own conditions of a parcel, by its planning unit: ``parcel key, topic,
    description, doc_id, pages``.

    ``acts``: ``municipality, act_doc, unit_doc``, the act and its table of units, one row each.
    The first planning unit and the first land use (by ``ord``) of a parcel count. Without a row
    for the unit there is nothing; with one, the act's sections, the land use's section and the
    unit's values are there as far as they are found. ``fixed``: ``municipality, topic,
    description, pages``, wording for all units of a municipality."""
    told = contexts.groupBy(*PARCEL_KEY).agg(
        F.min_by("planning_unit", F.when(T.blank_to_null(F.col("planning_unit")).isNotNull(), F.col("ord"))).alias("planning_unit"),
        F.min_by("land_use_code", F.when(T.blank_to_null(F.col("land_use_code")).isNotNull(), F.col("ord"))).alias("code"),
    )
    town = T.fold(F.col("municipality"))
    placed = (
        parcels.select(*PARCEL_KEY, town.alias("town"))
        .join(told.select(*PARCEL_KEY, T.fold(F.col("planning_unit")).alias("unit"), T.fold(F.col("code")).alias("code")), PARCEL_KEY)
        .join(acts.select(town.alias("town"), "act_doc", "unit_doc"), "town")
        .filter("unit <> '' AND code <> ''")
    )
    profiles = unit_profiles(unit_lines).withColumnRenamed("doc_id", "unit_doc")
    known = placed.join(profiles, ["unit_doc", "unit"])
    fz = F.trim(F.regexp_replace("max_fz", "^[ ,]+|[ ,]+$", ""))
    both = F.contains(fz, F.lit("stan. hiše")) & F.contains(fz, F.lit("kmetije"))
    values = {c: F.col(c) for c in UNIT_COLUMNS} | {
        "fi": _shown(F.col("max_fi")),
        "fz": F.when(both, F.replace(fz, F.lit("stan. hiše"), F.lit("stanovanjske hiše"))).otherwise(_shown(fz)),
    }

    def filled(template: str) -> Column:
        parts = []
        for k, piece in enumerate(template.replace("}", "{").split("{")):
            parts.append(values[piece] if k % 2 else F.lit(piece))
        return F.concat(*parts)

    own = F.array(*[F.struct(F.lit(k).alias("topic"), filled(t).alias("description")) for k, t in UNIT_TEXTS.items()])
    out = known.select(*PARCEL_KEY, F.explode(own).alias("o"), F.col("unit_doc").alias("doc_id"), F.array("page").alias("pages"))
    out = out.select(*PARCEL_KEY, "o.*", "doc_id", "pages")
    asked = known.select(*PARCEL_KEY, "town", "act_doc", "code")
    act_pages = pages.join(acts.select(F.col("act_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = exact_sections(act_pages, sections).select(
        F.col("doc_id").alias("act_doc"), F.col("key").alias("topic"), F.col("excerpt").alias("description"), F.array("page").alias("pages")
    )
    columns = [*PARCEL_KEY, "topic", "description", F.col("act_doc").alias("doc_id"), "pages"]
    out = out.unionByName(asked.join(found, "act_doc").select(*columns))
    wanted = asked.select(F.col("act_doc").alias("doc_id"), "code").distinct()
    uses = land_use_sections(act_pages, wanted).select(
        F.col("doc_id").alias("act_doc"), "code", F.col("excerpt").alias("description"), F.array("page").alias("pages"),
        F.explode(F.array(*[F.lit(t) for t in LAND_USE_TOPICS])).alias("topic"),
    )
    out = out.unionByName(asked.join(uses, ["act_doc", "code"]).select(*columns))
    if fixed is not None:
        words = fixed.select(town.alias("town"), "topic", "description", "pages")
        out = out.unionByName(asked.join(words, "town").select(*columns))
    return out


def apply_unit_overrides(conditions: DataFrame, overrides: DataFrame) -> DataFrame:
    """``conditions`` (of ``best_conditions``) with what ``unit_overrides`` found in their place."""
    own = overrides.select(*PARCEL_KEY, "topic", F.struct("description", "doc_id", "pages").alias("own"))
    joined = conditions.join(own, [*PARCEL_KEY, "topic"], "left")
    here = F.col("own").isNotNull()
    return joined.withColumns(
        {
            "description": F.when(here, F.col("own.description")).otherwise(F.col("description")),
            "available": F.col("available") | here,
            "doc_id": F.when(here, F.col("own.doc_id")).otherwise(F.col("doc_id")),
            "page": F.when(here, F.col("own.pages")[0]).otherwise(F.col("page")),
        }
    ).drop("own")
