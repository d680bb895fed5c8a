"""Personal data: candidates proposed by patterns, chosen by gradient-boosted trees.

Generators of high recall propose spans, which may overlap. Each candidate has a few coarse
features of its format and context. Candidates of all documents are counted by their
feature values (a table of bounded size, ``VECTORS`` rows at most per label and fold), and
trees are boosted on these counts against labels of the validators; thresholds per kind come
from the fold that the trees have not seen. A kind with too few held-out candidates for a
threshold is judged by its validator alone, so that small tables have their spans, too. Spans
of the base rules always stay; trees and validators add others. All work on texts is done by built-in columns, and nothing is shuffled but counts.

Patterns are written so that a run of characters is tried once and groups never recurse:
very long texts cost time in proportion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The base rules (fixed values), with possessive repeats and one try per run.
BASE = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?:(?<![0-9])|\\G)(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?:[ -][0-9]++)*+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: What texts must contain for a rule to be tried: all that the rules of a kind match has it.
HINTS = {"email": "@|[\\[(](?:at|AT)[\\])]", "ip": "[0-9]\\.[0-9]", "card": "[0-9][0-9 -]{11}", "phone": "\\+[0-9]|[0-9][ .-][0-9]{4}"}
#: Further generators: parts of longer runs, and other ways of writing.
MORE = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++ ?[\\[(](?:at|AT)[\\])] ?[A-Za-z0-9-]++(?: ?(?:\\.|[\\[(](?:dot|DOT)[\\])]) ?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{12,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": "(?<![0-9])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Words before a candidate that speak for its kind.
CONTEXT = {"email": "mail|contact|write", "ip": "\\bip\\b|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|tel|call|fax|mobile"}
#: Values of each feature, from 0; their product bounds the table of counts.
FEATURES = {"kind": 4, "digits": 6, "luhn": 2, "plus": 2, "paren": 2, "octets": 2, "before": 3, "after": 3, "context": 2, "whole": 2}
VECTORS = math.prod(FEATURES.values())
#: Rounds of boosting, step, smallest weight of a leaf, and precision that thresholds must reach.
ROUNDS, RATE, LEAF, PRECISION = 20, 0.3, 5.0, 0.98
#: Held-out candidates that a threshold needs above it. A kind that cannot have them, as fewer
#: held-out candidates pass its validator, is judged by the validator.
SUPPORT = 10


def _places(text: Column, pattern: str, hint: str) -> Column:
    """start, end and value of every match, leftmost first, without overlaps."""
    tried = F.when(text.rlike(hint), text).otherwise(F.lit(""))
    found = F.regexp_extract_all(tried, F.lit(pattern), F.lit(0))
    between = F.split(tried, pattern, -1)
    run = F.aggregate(
        F.arrays_zip(found.alias("f"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["p"] + F.length(x["b"]) + F.length(x["f"])).alias("p"),
            F.concat(
                a["out"],
                F.array(F.struct(
                    (a["p"] + F.length(x["b"])).alias("start"),
                    (a["p"] + F.length(x["b"]) + F.length(x["f"])).alias("end"),
                    x["f"].alias("value"),
                )),
            ).alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, run["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of up to 19 digits is right."""
    d = F.reverse(F.substring(digits, 1, 19))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.coalesce(F.try_to_number(F.substr(d, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)))
        .otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.try_to_number(F.substr(d, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)))),
    )
    return total % 10 == 0


def _octets(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255, leading zeros allowed."""
    return F.forall(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _side(text: Column, at: Column) -> Column:
    """0 for a blank or the text's end, 1 for a letter or digit, 2 for anything else."""
    c = F.substr(text, at, F.lit(1))
    return F.when((at < 1) | c.rlike("^\\s?$"), 0).when(c.rlike("^[\\p{L}\\p{N}]$"), 1).otherwise(2)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base (spans of the base rules) and more (other candidates with features).

    Spans are in code points, ends exclusive. A null text has neither. The columns of
    patterns are evaluated once, in a projection of their own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *keep, t.alias("_t"))
    rows = rows.select(
        "*",
        *[_places(F.col("_t"), BASE[k], HINTS[k]).alias(f"_b_{k}") for k in KINDS],
        *[_places(F.col("_t"), MORE[k], HINTS[k]).alias(f"_m_{k}") for k in KINDS],
    )
    span = lambda order: lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"))
    valid = lambda k: lambda x: _valid(k, x["value"])
    base = F.array_sort(F.concat(*[F.transform(F.filter(f"_b_{k}", valid(k)), span(i)) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("base", base)

    def features(i: int, k: str, whole: int):
        def make(x):
            value, digits = x["value"], _digits(x["value"])
            n = F.length(digits)
            before = F.substr(F.col("_t"), F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
            good = {
                "email": value.rlike("[.\\])] ?[A-Za-z]{2,}$"),
                "ip": _octets(value),
                "card": n.between(12, 19) & luhn(digits),
                "phone": n.between(9, 15) & value.rlike("[+(]"),
            }[k]
            return F.struct(
                x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"),
                F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n == 16, 3).when(n < 20, 4).otherwise(5).alias("digits"),
                (F.when(luhn(digits), 1).otherwise(0) if k == "card" else F.lit(0)).alias("luhn"),
                F.when(value.startswith("+"), 1).otherwise(0).alias("plus"),
                F.when(value.contains("("), 1).otherwise(0).alias("paren"),
                (F.when(_octets(value), 1).otherwise(0) if k == "ip" else F.lit(0)).alias("octets"),
                _side(F.col("_t"), x["start"]).alias("before"),
                _side(F.col("_t"), x["end"] + 1).alias("after"),
                F.when(F.lower(before).rlike(CONTEXT[k]), 1).otherwise(0).alias("context"),
                F.lit(whole).alias("whole"),
                F.when(good, 1).otherwise(0).alias("label"),
            )

        return make

    more = F.concat(
        *[F.transform(f"_b_{k}", features(i, k, 1)) for i, k in enumerate(KINDS)],
        *[F.transform(f"_m_{k}", features(i, k, 0)) for i, k in enumerate(KINDS)],
    )
    return rows.select("doc_id", *keep, "base", more.alias("more"))


@dataclass
class Model:
    """Boosted trees of two levels over the features, and a threshold for each kind.

    Kinds in ``validated`` have no threshold; their candidates are chosen by their label. A split is (feature, value): equal goes left. A tree is (split, left, right), where a
    side is (split, leaf, leaf) or a leaf.
    """

    prior: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    validated: tuple[int, ...] = ()

    def score(self, row: dict[str, int]) -> float:
        return self.prior + sum(_leaf(t, row) for t in self.trees)

    def column(self, of) -> Column:
        """The score as a column; ``of`` gives the column of a feature."""
        return sum((_tree_column(t, of) for t in self.trees), F.lit(float(self.prior)))

    def chosen(self, of) -> Column:
        out = F.lit(False)
        for kind, least in self.thresholds.items():
            out = out | ((of("kind") == kind) & (self.column(of) >= least))
        for kind in self.validated:
            out = out | ((of("kind") == kind) & (of("label") == 1))
        return out


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        (name, value), left, right = tree
        tree = left if row[name] == value else right
    return tree


def _tree_column(tree, of) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    (name, value), left, right = tree
    return F.when(of(name) == value, _tree_column(left, of)).otherwise(_tree_column(right, of))


def _grow(rows: list[dict], depth: int):
    """The tree that best fits gradients ``g`` with curvatures ``h`` of weighted rows."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best, gain = None, 1e-9
    if depth:
        for name, values in FEATURES.items():
            for value in range(values):
                left = [r for r in rows if r[name] == value]
                gl, hl, nl = sum(r["g"] for r in left), sum(r["h"] for r in left), sum(r["n"] for r in left)
                if nl < LEAF or sum(r["n"] for r in rows) - nl < LEAF:
                    continue
                new = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if new > gain:
                    best, gain = (name, value), new
    if best is None:
        return RATE * g / (h + 1)
    name, value = best
    return (best, _grow([r for r in rows if r[name] == value], depth - 1), _grow([r for r in rows if r[name] != value], depth - 1))


def fit(counted: list[dict]) -> Model:
    """Boost on counts of feature values, label and fold; thresholds from fold 1.

    A kind with fewer than ``SUPPORT`` held-out candidates of label 1 cannot have a threshold
    and is judged by its labels, as are all kinds if there is nothing to boost on. A kind whose
    held-out candidates are enough, but support no threshold of that precision, gets none, so
    that nothing is added to its base spans.
    """
    learn = [dict(r) for r in counted if r["fold"] == 0]
    if not learn or len({r["label"] for r in learn}) < 2:
        return Model(validated=tuple(range(len(KINDS))))
    ones, total = sum(r["n"] for r in learn if r["label"]), sum(r["n"] for r in learn)
    model = Model(prior=math.log(ones / (total - ones)))
    for r in learn:
        r["f"] = model.prior
    for _ in range(ROUNDS):
        for r in learn:
            p = 1 / (1 + math.exp(-r["f"]))
            r["g"], r["h"] = r["n"] * (r["label"] - p), r["n"] * p * (1 - p)
        tree = _grow(learn, 2)
        model.trees.append(tree)
        for r in learn:
            r["f"] += _leaf(tree, r)
    for kind in range(len(KINDS)):
        held = sorted(((model.score(r), r["label"], r["n"]) for r in counted if r["fold"] == 1 and r["kind"] == kind), reverse=True)
        good = seen = 0
        for k, (score, label, n) in enumerate(held):
            seen, good = seen + n, good + n * label
            if (k + 1 == len(held) or held[k + 1][0] < score) and seen >= SUPPORT and good >= PRECISION * seen:
                model.thresholds[kind] = score - 1e-9
        if sum(n * label for _, label, n in held) < SUPPORT and kind not in model.thresholds:
            model.validated += (kind,)
    return model


def train(found: DataFrame) -> Model:
    """Fit on all candidates: counts by feature values are all that reaches the driver."""
    each = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold"), F.explode("more").alias("c"))
    names = [*FEATURES, "label"]
    counts = each.groupBy("fold", *[F.col(f"c.{x}").alias(x) for x in names]).agg(F.count("*").alias("n"))
    return fit([r.asDict() for r in counts.orderBy("fold", *names).collect()])


def _all_spans(model: Model) -> Column:
    """base, and chosen candidates that overlap no base span of their kind, without repeats."""
    clear = lambda c: ~F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter("more", lambda c: model.chosen(lambda name: c[name]) & clear(c))
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.array_distinct(F.concat("base", added)))


def _written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans, of every document.

    ``model`` is trained on these documents if it is not given. Null and empty texts have no
    spans; rows with null or repeated keys stay; an empty table gives no rows.
    """
    found = written(candidates(docs, key, text), "pii-candidates")
    model = model or train(found)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"),
        _written_out(_all_spans(model)).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans in their texts replaced by their kind in brackets.

    Overlapping spans become one, under the kind of the first. Null texts stay null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = written(candidates(rows, "_key", "_text", keep=("_row",)), "pii-candidates")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    rows = found.select("_row", _all_spans(train(found)).alias("_spans"))
    t = F.col(f"_row.`{text}`")
    done = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            F.when(s["start"] < a["end"], a["out"])
            .otherwise(F.concat(a["out"], F.array(F.substr(t, a["end"] + 1, s["start"] - a["end"]), F.get(names, s["kind"]))))
            .alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(t, a["end"] + 1, F.length(t))),
    )
    clean = F.when(F.size("_spans") > 0, done).otherwise(t)
    return rows.select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
