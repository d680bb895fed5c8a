"""Quality rules as a ledger of failure bits.

``ledger`` evaluates every rule once for each document and stores its measurements and one
bit for each rule that failed. Policies are versioned masks of rules: ``apply_policy``
decides by one bitwise AND, and ``ablations`` works out from the counts of distinct masks
what each rule rejects alone and what would be kept without it. A new policy never reads
the texts again. Only built-in columns are used; the one shuffle is that of ``ablations``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import BLANKS, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measurements of the method's own rules.
MORE = ["n_lines", "n_letters", "n_upper"]


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurements) is true; null counts as passed."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(4, "upper_case", "n_letters >= 100 AND 10 * n_upper > 4 * n_letters"),
    Rule(5, "few_letters", "word_chars >= 100 AND 2 * n_letters < word_chars"),
    Rule(6, "word_length", "n_words >= 50 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words)"),
)
#: policy -> version -> names of the rules that reject.
POLICIES = {
    "base": {1: ("too_few_words", "repeated_windows")},
    "training": {
        1: ("too_few_words", "repeated_windows", "symbols"),
        2: tuple(r.name for r in RULES),
    },
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def _count_of(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every document, from its whole text.

    Null and empty texts measure 0 throughout. Columns of the same names are replaced.
    n_repeat_words: windows of three words are sorted with their places; equal neighbours
    are repeated windows, and the places they cover count once. A document whose windows
    have distinct 64-bit hashes has no repeated window and is not sorted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in MEASURES + MORE]
    bare = F.translate(t, BLANKS, "")
    made = docs.select(
        *kept,
        words(F.col(text)).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        F.length(bare).cast("long").alias("word_chars"),
        _count_of(t, "#*$%&|<>").alias("n_symbols"),
        F.regexp_count(t, F.lit("\\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
    )
    made = made.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= 4,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ).alias("_hashes"),
    ).drop("_lines")
    made = made.withColumn("_again", F.size(F.array_distinct("_hashes")) < F.size("_hashes")).drop("_hashes")
    made = made.withColumn(
        "_sorted",
        F.when(
            F.col("_again"),
            F.array_sort(
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.struct(
                        F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("t"),
                        i.alias("p"),
                    ),
                )
            ),
        ),
    ).drop("_w", "_again")
    same = lambda i, j: F.get("_sorted", i)["t"] == F.get("_sorted", j)["t"]
    made = made.withColumn(
        "_places",
        F.array_sort(
            F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.size("_sorted") - 1),
                    lambda i: F.when(
                        F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
                        F.get("_sorted", i)["p"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + (p + 3 - F.greatest(a["end"], p))).cast("long").alias("n"), (p + 3).alias("end")
        ),
    )["n"]
    made = made.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    # a filter on measurements must not be pushed below: it would evaluate them again per element
    both = F.explode_outer(F.array(F.struct(*MEASURES, *MORE))).alias("_m")
    return made.select(*kept, both).select(*kept, "_m.*")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measurements and ``failures``, the bits of the rules that failed."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules), F.lit(0))
    return measured(docs.drop("failures"), text).withColumn("failures", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str = "training", version: int = 2) -> DataFrame:
    """Ledger rows with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy][version]))) == 0)


def ablations(rows: DataFrame, policy: str = "training", version: int = 2, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, rejects alone, and kept without it.

    The documents are counted by mask first: at most 2 to the number of rules rows are left.
    """
    chosen = [r for r in rules if r.name in POLICIES[policy][version]]
    whole = mask(POLICIES[policy][version])
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in chosen]))
    counts = counts.select("m", "n", each.alias("r"))
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return counts.groupBy(F.col("r.rule").alias("rule")).agg(
        when(F.col("m").bitwiseAND(F.col("r.b")) != 0)("failed"),
        when(F.col("m") == F.col("r.b"))("rejected_alone"),
        when(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.b"))) == 0)("kept_without"),
    )
