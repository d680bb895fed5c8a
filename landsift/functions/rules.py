"""Rule columns: land-use class, tones, network keys, band widths, ownership kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.functions import text as T

POSITIVE, CAUTION, CONCERN, UNKNOWN = "positive", "caution", "concern", "unknown"

# Land-use names by code.
LAND_USE_NAMES = {
    "S": "Območja stanovanj",
    "SS": "Stanovanjske površine",
    "SB": "Stanovanjske površine za posebne namene",
    "SK": "Površine podeželskega naselja",
    "A": "Površine razpršene poselitve",
    "K1": "Najboljša kmetijska zemljišča",
    "K2": "Druga kmetijska zemljišča",
    "G": "Gozdna zemljišča",
    "VC": "Površinske celinske vode",
    "PC": "Površine cest",
}
LAND_USE_DEFAULT_NAME = "Namenska raba brez opisa"
# Land-use codes and name parts by class.
RESIDENTIAL_CODES = ["S", "SS", "SB", "SK", "SP"]
CONDITIONAL_CODES = ["A", "C", "CU", "CD", "BT"]
RESTRICTIVE_CODES = [
    "K1", "K2", "G", "V", "VC", "VI", "Z", "ZD", "ZS", "ZP", "ZK", "I", "IP", "IG", "IK",
    "P", "PC", "PO", "PL", "T", "E", "O", "L", "N",
]
RESTRICTIVE_NAMES = ["kmetij", "gozd", "vodn", "zelene površine", "promet"]
# Codes of building land.
BUILDING_LAND_CODES = [
    "A", "B", "BC", "BD", "BT", "C", "CD", "CU", "E", "I", "IG", "IK", "IP", "O", "P", "PC", "PH",
    "PL", "PO", "PZ", "PŽ", "S", "SB", "SK", "SP", "SS", "T", "Z", "ZD", "ZK", "ZP", "ZS",
]
# Labels of the land-use classes and of the overall result.
LAND_USE_LABELS = {
    "residential": "Poselitvena / stanovanjska raba",
    "dispersed": "Razpršena poselitev – preverite pogoje",
    "conditional": "Pogojna združljivost",
    "restrictive": "Praviloma omejujoče za stanovanjsko gradnjo",
    "other": "Potrebna je razlaga občine",
}
OVERALL_LABELS = {
    UNKNOWN: "Ni dovolj podatkov",
    POSITIVE: "Ugodna indikacija za stanovanjsko gradnjo",
    CONCERN: "Omejujoča namenska raba",
    CAUTION: "Pogojno ali mešano stanje",
}


def any_part(c: Column, parts: list[str]) -> Column:
    """Does the text contain one of the parts?"""
    return c.rlike("|".join(parts))


def land_use_code(c: Column) -> Column:
    return F.upper(T.blank_to_null(F.trim(c)))


def land_use_name(code: Column, description: Column) -> Column:
    names = T.literal_map(LAND_USE_NAMES)
    return F.coalesce(
        T.blank_to_null(description), F.try_element_at(names, code), F.lit(LAND_USE_DEFAULT_NAME)
    )


def land_use_class(code: Column, name: Column) -> Column:
    """One of the keys of LAND_USE_LABELS; the first rule that fits wins."""
    code = F.coalesce(code, F.lit(""))
    name = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(code.isin(RESIDENTIAL_CODES) | any_part(name, ["stanovanj"]), "residential")
        .when((code == "A") | any_part(name, ["razpršene poselitve"]), "dispersed")
        .when(code.isin(CONDITIONAL_CODES) | any_part(name, ["centralnih dejavnosti"]), "conditional")
        .when(code.isin(RESTRICTIVE_CODES) | any_part(name, RESTRICTIVE_NAMES), "restrictive")
        .otherwise("other")
    )


def land_use_tone(land_class: Column) -> Column:
    return (
        F.when(land_class == "residential", POSITIVE)
        .when(land_class.isin("dispersed", "conditional"), CAUTION)
        .when(land_class == "restrictive", CONCERN)
        .otherwise(UNKNOWN)
    )


# Network by code prefix or by part of its name, in this order.
NETWORK_RULES = [
    ("31", "vodovod", "water"),
    ("32", "kanaliz", "sewer"),
    ("21", "električ", "electricity"),
    ("61", "komunik", "telecom"),
    ("22", "zemeljski plin", "gas"),
    ("23", "toplot", "district_heat"),
    ("11", "cest", "road"),
]
# Names of networks and their default object kinds.
NETWORK_NAMES = {
    "water": "Vodovod",
    "sewer": "Kanalizacija",
    "electricity": "Električna energija",
    "telecom": "Elektronske komunikacije",
    "gas": "Zemeljski plin",
    "district_heat": "Toplotna energija",
    "road": "Cesta",
}
DEFAULT_KINDS = {
    "road": "Javna cesta",
    "electricity": "Elektroenergetski vod ali objekt",
    "telecom": "Elektronska komunikacijska infrastruktura",
    "water": "Vodovodno omrežje",
    "sewer": "Kanalizacijsko omrežje",
    "gas": "Plinovodno omrežje",
    "district_heat": "Omrežje daljinskega ogrevanja",
}
# Theme codes of the lines that carry protection bands.
BAND_THEMES = ["1100", "2100", "2200", "2300", "3100", "3200", "6100"]


def network_key(code: Column, name: Column) -> Column:
    code = F.coalesce(code.cast("string"), F.lit(""))
    name = F.lower(F.coalesce(name, F.lit("")))
    key = F.lit(None).cast("string")
    for prefix, part, value in reversed(NETWORK_RULES):
        key = F.when(code.startswith(prefix) | F.contains(name, F.lit(part)), value).otherwise(key)
    return key


# Fixed patterns: position of an electricity line, and its voltage.
UNDERGROUND = "podzem|kablovod"
OVERHEAD = "nadzem|daljnovod"
VOLTAGE = r"(?i)(\d+(?:[.,]\d+)?)\s*k\s*v"


def voltage_kv(voltage: Column) -> Column:
    number = F.regexp_extract(voltage, VOLTAGE, 1)
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def electricity_band(kv: Column, underground: Column, overhead: Column) -> Column:
    """Band width in metres; null without a voltage or a known position."""
    below = F.when(kv >= 220, 10.0).when(kv >= 35, 3.0).otherwise(1.0)
    above = F.when(kv >= 220, 40.0).when(kv >= 35, 15.0).when(kv > 1, 10.0).otherwise(1.5)
    return F.when(kv.isNull(), None).when(underground, below).when(overhead, above)


# Road band widths in metres by class.
ROAD_BANDS = [
    ("avtocest", 40.0),
    ("hitra cest", 35.0),
    ("glavna cest", 25.0),
    ("regionalna cest", 15.0),
    ("državna kolesars", 5.0),
]


def road_band(road_class: Column) -> Column:
    width = F.lit(None).cast("double")
    for part, metres in reversed(ROAD_BANDS):
        width = F.when(F.contains(F.lower(road_class), F.lit(part)), metres).otherwise(width)
    return width


# Finding categories and legal bases of the bands.
BAND_CATEGORY = {
    "electricity": "Varovalni pas elektroenergetskega omrežja",
    "telecom": "Varovalni pas elektronskih komunikacij",
    "water": "Varovalni pas vodovodnega omrežja",
    "sewer": "Varovalni pas kanalizacijskega omrežja",
    "road": "Varovalni pas javne ceste",
    "gas": "Varovalni pas sistema zemeljskega plina",
    "district_heat": "Varovalni pas omrežja daljinskega ogrevanja",
}
BAND_BASIS = {
    "electricity": "112. člen Energetskega zakona (EZ-2)",
    "telecom": "17. člen Zakona o elektronskih komunikacijah (ZEKom-2)",
    "water": "Veljavni občinski prostorski akt in pogoji upravljavca vodovoda",
    "sewer": "Veljavni občinski prostorski akt in pogoji upravljavca kanalizacije",
    "gas": "113. člen Energetskega zakona (EZ-2)",
    "district_heat": "Veljavni občinski prostorski akt in pogoji upravljavca omrežja",
}
ROAD_BASIS = "76. člen Zakona o cestah (ZCes-2)"
ROAD_BASIS_LOCAL = "Zakon o cestah (ZCes-2) in veljavni občinski odlok o občinskih cestah"


def with_band_profile(df: DataFrame) -> DataFrame:
    """Adds network, category, name, legal basis and width of a network object; the
    object is described by ``theme_code, theme_name, kind, attribute1, attribute2``.

    Done in steps, so that no cleaned text is worked out more than once per row."""
    key, kind, first, second = (F.col(c) for c in ("network", "_kind", "_first", "_second"))
    voltage, road = F.col("_voltage"), F.col("_road")
    under, over = F.col("_under"), F.col("_over")
    name = (
        F.when(
            key == "electricity",
            F.when(under, F.concat_ws(" ", F.lit("Podzemni kabelski vod"), voltage))
            .when(over, F.concat_ws(" ", F.lit("Nadzemni elektroenergetski vod"), voltage))
            .otherwise(kind),
        )
        .when(key == "telecom", F.concat_ws(" – ", F.lit("Elektronske komunikacije"), F.lower(kind), F.lower(first)))
        .when(key == "water", F.concat(F.lit("Vodovod – "), F.lower(kind)))
        .when(key == "sewer", F.concat(F.lit("Kanalizacija – "), F.lower(kind)))
        .when(key == "road", F.concat(F.upper(F.substring(road, 1, 1)), F.substr(road, F.lit(2))))
        .when(key.isin("gas", "district_heat"), kind)
    )
    width = (
        F.when(key == "electricity", electricity_band(F.col("_kv"), under, over))
        .when(key == "telecom", 3.0)
        .when(key == "road", road_band(road))
        .when(key == "gas", F.when(F.col("_text").contains("prenos"), 65.0).when(F.col("_text").contains("distrib"), 5.0))
    )
    road_basis = F.when(F.col("width").isNotNull(), ROAD_BASIS).otherwise(ROAD_BASIS_LOCAL)
    basis = F.when(key == "road", road_basis).otherwise(F.try_element_at(T.literal_map(BAND_BASIS), key))
    return (
        df.withColumns(
            {
                "network": network_key(F.col("theme_code"), F.col("theme_name")),
                "_kind": T.clean_value(F.col("kind")),
                "_first": T.clean_attribute(F.col("attribute1")),
                "_second": T.clean_attribute(F.col("attribute2")),
            }
        )
        .withColumns(
            {
                "_kind": F.coalesce(kind, F.try_element_at(T.literal_map(DEFAULT_KINDS), key)),
                "_voltage": F.when(F.contains(F.lower(second), F.lit("kv")), second),
            }
        )
        .withColumns({"_text": F.lower(F.concat_ws(" ", kind, first, second)), "_road": F.coalesce(first, kind)})
        .withColumns(
            {
                "_kv": voltage_kv(voltage),
                "_under": F.col("_text").rlike(UNDERGROUND),
                "_over": F.col("_text").rlike(OVERHEAD),
            }
        )
        .withColumns({"name": name, "width": width, "category": F.try_element_at(T.literal_map(BAND_CATEGORY), key)})
        .withColumn("legal_basis", basis)
        .drop("_kind", "_first", "_second", "_text", "_voltage", "_road", "_kv", "_under", "_over")
    )


# What marks an owner entry as hidden.
HIDDEN_NAMES = ["***", "/"]
HIDDEN_PART = "ni javen"


def is_hidden_name(cleaned: Column) -> Column:
    """Does a cleaned owner name (null if empty) stand for a hidden owner?"""
    text = F.lower(cleaned)
    return cleaned.isNull() | text.isin(HIDDEN_NAMES) | F.contains(text, F.lit(HIDDEN_PART))


def is_hidden_owner(name: Column) -> Column:
    return is_hidden_name(T.clean_text(name))


def owner_kind(named: Column, hidden: Column) -> Column:
    """From the numbers of distinct named and of hidden holders."""
    return (
        F.when((named > 0) & (hidden == 0), "publicly_named")
        .when((hidden > 0) & (named == 0), "private_person")
        .when((hidden > 0) | (named > 0), "mixed")
        .otherwise("unknown")
    )


def boundary_status(raw: Column, total: Column, ordered: Column, complete: Column) -> Column:
    """Seven rules, first match wins."""
    raw = F.lower(T.squeeze(F.coalesce(raw, F.lit(""))))
    total = F.greatest(F.lit(0), total)
    ordered = F.greatest(F.lit(0), F.least(ordered, total))
    full = complete & (total > 0)
    return (
        F.when(full & (ordered == total), "ordered")
        .when(full & (ordered > 0), "partially_ordered")
        .when(full, "not_ordered")
        .when(raw == "urejena", "ordered")
        .when((raw == "ni urejena") & (ordered > 0), "partially_ordered")
        .when(raw == "ni urejena", "not_ordered")
        .otherwise("unknown")
    )


# Labels of the boundary statuses.
BOUNDARY_LABELS = {
    "ordered": "Urejena",
    "partially_ordered": "Delno urejena",
    "not_ordered": "Ni urejena",
    "unknown": "Ni mogoče določiti",
}


def road_tone(distance: Column) -> Column:
    return (
        F.when(distance.isNull(), CONCERN)
        .when(distance <= 1, POSITIVE)
        .when(distance <= 10, CAUTION)
        .otherwise(CONCERN)
    )


def grade(concerns: Column, cautions: Column) -> Column:
    """1 (worst) to 5."""
    return (
        F.when(concerns >= 2, 1).when(concerns == 1, 2).when(cautions >= 2, 3).when(cautions == 1, 4).otherwise(5)
    )
