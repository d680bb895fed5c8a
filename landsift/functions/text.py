"""Text, number and date columns. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that lose their mark when text is folded (one to one).
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžơư"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrsssstt" + "uuuuuuuuuuwyyyzzzou"
# Combining marks that stand alone in decomposed text.
COMBINING = "[\\u0300-\\u036f]"
# Words that mean "no value".
NULL_WORDS = ["null", "none", "nan"]
NO_DATA = ["ni podatka", "ni določeno"]
# Fixed value: what Python's str.splitlines() breaks at.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]"
# Unicode blanks, as Python's \\s and str.split() see them.
BLANKS = "(?U)\\s+"

assert len(MARKED) == len(PLAIN)


def squeeze(c: Column) -> Column:
    """Runs of blanks to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def squeeze_ends(c: Column) -> Column:
    """Blanks at both ends trimmed, of any kind."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Empty text to null."""
    return F.nullif(c, F.lit(""))


def fold(c: Column) -> Column:
    """Case-folded text without marks, blanks collapsed (a searchable form)."""
    lowered = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    bare = F.regexp_replace(F.translate(lowered, MARKED, PLAIN), COMBINING, "")
    return squeeze(bare)


def clean_text(c: Column) -> Column:
    return blank_to_null(squeeze(c.cast("string")))


def _without(c: Column, words: Sequence[str]) -> Column:
    """Cleaned text; the given words, in any case, become null."""
    text = F.regexp_replace(squeeze(c.cast("string")), "^(-?\\d+)\\.0$", "$1")
    return blank_to_null(F.regexp_replace(text, "(?iu)^(" + "|".join(words) + ")$", ""))


def clean_value(c: Column) -> Column:
    """Cleaned text; whole floats lose their ``.0``; null words become null."""
    return _without(c, NULL_WORDS)


def clean_attribute(c: Column) -> Column:
    """As clean_value, and the "no data" phrases become null too."""
    return _without(c, [*NULL_WORDS, *NO_DATA])


def first_value(props: Column, fields: Sequence[str]) -> Column:
    """First usable value among the named entries of a property map."""
    if not fields:
        return F.lit(None).cast("string")
    return F.coalesce(*[clean_value(F.try_element_at(props, F.lit(f))) for f in fields])


def join_present(separator: str, *parts: Column) -> Column:
    """Present, non-empty parts joined; null if there is none."""
    return blank_to_null(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator))


# Fixed pattern: municipality number, then a blank, dash or colon, then the parcel number.
PARCEL_REFERENCE = r"(?U)^\s*(\d{1,4})\s*(?:[-: ]|\s)\s*(\d+(?:\s*/\s*\d+)?)\s*$"


def parse_parcel_reference(c: Column) -> Column:
    """struct(ko_id, parcel_number), null for anything that is not a reference."""
    ko = F.regexp_extract(c, PARCEL_REFERENCE, 1).try_cast("bigint")
    number = F.regexp_replace(F.regexp_extract(c, PARCEL_REFERENCE, 2), BLANKS, "")
    return F.when(
        c.rlike(PARCEL_REFERENCE), F.struct(ko.alias("ko_id"), number.alias("parcel_number"))
    )


def share_percent(c: Column) -> Column:
    """``1 / 6`` -> 16.67; plain decimals are allowed; bad text or /0 -> null."""
    text = F.regexp_replace(c, BLANKS, "")
    whole = text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    ratio = text.rlike(r"^[-+]?\d+/\d+$")
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    low = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    value = F.when(ratio, F.try_divide(100 * top, low)).when(whole, 100 * text.try_cast("double"))
    return F.bround(value, 2)


def format_record_date(c: Column) -> Column:
    """ISO date -> ``d. m. yyyy``; other text unchanged; empty -> null."""
    text = clean_value(c)
    part = lambda g: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", g)
    day = F.concat(
        part(3).try_cast("int").cast("string"), F.lit(". "), part(2).try_cast("int").cast("string"), F.lit(". "), part(1)
    )
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), day).otherwise(text)


def clip(c: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, cut with an ellipsis."""
    text = squeeze(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def format_percentage(c: Column) -> Column:
    """12.5 -> ``12,5 %``."""
    text = F.format_string("%.2f", F.bround(c.cast("double"), 2))
    return F.when(
        c.isNotNull(),
        F.concat(F.translate(F.regexp_replace(text, r"\.?0+$", ""), ".", ","), F.lit(" %")),
    )


def format_general(c: Column) -> Column:
    """A number as Python's ``:g`` writes it for the shares and widths used here."""
    return F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", "")


def is_affirmative(c: Column) -> Column:
    # Words for yes.
    return F.coalesce(F.lower(F.trim(c)).isin(["da", "yes", "true", "1", "y"]), F.lit(False))


def literal_map(values: Mapping[str, str]) -> Column:
    """A fixed dictionary as a map column."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in values.items()) + ")")


def label(c: Column, labels: Mapping[str, str]) -> Column:
    """Dictionary lookup; an unknown code stays as it is."""
    return F.coalesce(F.try_element_at(literal_map(labels), c), c)


def nonnegative(c: Column) -> Column:
    """Whole number of at least 0; text that is no number counts 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint")))


def optional_nonnegative(c: Column) -> Column:
    return F.when(c.isNotNull(), nonnegative(c))


def normalise_domain(c: Column, allowed: Sequence[str], default: str | None) -> Column:
    return F.when(c.isin(list(allowed)), c).otherwise(F.lit(default))


def safe_filename(name: Column, digest: Column) -> Column:
    """Last path element, unsafe characters to ``_``, at most 100, with a digest tail."""
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"(?U)[^\w .()-]+", "_")
    stem = F.substring(F.regexp_replace(stem, "^[ .]+|[ .]+$", ""), 1, 100)
    stem = F.coalesce(blank_to_null(stem), F.lit("document"))
    return F.concat(stem, F.lit("-"), F.substring(digest, 1, 10), F.lit(".pdf"))


def report_filename(prefix: str, ko_id: Column, parcel_number: Column) -> Column:
    raw = F.concat_ws("-", F.lit(prefix), ko_id.cast("string"), parcel_number)
    safe = F.regexp_replace(raw, "[^a-zA-Z0-9._-]+", "-")
    return F.concat(F.regexp_replace(safe, "^[-.]+|[-.]+$", ""), F.lit(".pdf"))


def redact(line: Column) -> Column:
    """Log line without keys, tokens and passwords, at most 8,000 characters."""
    # Fixed patterns.
    text = F.substring(line, 1, 8000)
    text = F.regexp_replace(text, r"\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}", "sk-<redacted>")
    text = F.regexp_replace(
        text,
        r"(?i)((?:authorization|api[_-]?key|secret|password|captcha_token|token)\s*[=:]\s*)[^\s&,;]+",
        "$1<redacted>",
    )
    return F.regexp_replace(text, r"(?i)(response=)[^&\s]+", "$1<redacted>")


def normalise_reference(c: Column) -> Column:
    return F.lower(squeeze(c))


def cache_key(reference: Column, version: int = 8) -> Column:
    return F.sha2(F.concat(F.lit(f"v{version}:"), normalise_reference(reference)), 256)


def text_lines(c: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    return F.split(F.regexp_replace(c, f"({LINE_BREAK})$", ""), LINE_BREAK)
