"""Event logs and web pages as text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.functions import text as T

EVENT_FIELDS = "recorded_at string, visitor_id string, event_type string, parcel_reference string, consent_version string"


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON lines; malformed lines and bad timestamps drop out."""
    event = F.from_json(F.col(column), EVENT_FIELDS, {"mode": "PERMISSIVE"})
    moment = F.col("recorded_at").try_cast("timestamp").cast("timestamp_ntz")
    return (
        lines.select(F.inline(F.array(event))).withColumn("recorded_at", moment).filter(F.col("recorded_at").isNotNull())
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_lines(spark.read.text(path))


def _plain(html: Column) -> Column:
    """Text of a piece of HTML."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return T.squeeze(text)


def html_table_value(pages: DataFrame, label: str, column: str = "html") -> DataFrame:
    """The cell next to the first cell that reads ``label``, in any case; null without one."""
    rows = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1))
    pairs = F.filter(
        F.transform(rows, cells), lambda c: (F.size(c) >= 2) & (F.lower(_plain(F.get(c, 0))) == label.lower())
    )
    return pages.withColumn("value", _plain(F.get(F.get(pairs, 0), 1)))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))


def html_form_fields(pages: DataFrame, form_id: str, column: str = "html") -> DataFrame:
    """Name to value of the inputs of one form; of inputs with one name the last counts."""
    form = F.regexp_extract(
        F.col(column), rf"""(?is)<form\b[^>]*\bid\s*=\s*["']{re.escape(form_id)}["'][^>]*>(.*?)</form>""", 1
    )
    tags = F.filter(
        F.regexp_extract_all(form, F.lit(r"(?is)<input\b[^>]*>"), F.lit(0)), lambda t: _attribute(t, "name") != ""
    )
    names = F.transform(tags, lambda t: _attribute(t, "name"))
    rows = F.arrays_zip(names.alias("name"), F.transform(tags, lambda t: _attribute(t, "value")).alias("value"))
    staged = pages.withColumn("_rows", rows)
    last = F.filter(
        F.col("_rows"),
        lambda r, i: ~F.exists(
            F.slice(F.col("_rows"), i + 2, F.greatest(F.size("_rows") - i - 1, F.lit(0))), lambda o: o["name"] == r["name"]
        ),
    )
    return staged.withColumn("fields", F.map_from_entries(last)).drop("_rows")
