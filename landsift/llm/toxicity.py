"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the letters they share in order: each triple of letters within
``SPAN`` places counts with ``DECAY`` to the power of the places it takes, so gaps and
inserted characters weaken a likeness but do not end it. Landmarks are words that tell
toxic sentences from others, and common words. The machine learns on words of labelled
sentences (a document's label holds for its sentences), then again with the clean words it
took for insults. Its decision is a sum over landmarks of kernel values, and as these are
sums over triples it comes down to one table of triples: a word is scored by lookups. A
document's highest word is calibrated to its score by a logistic fit on documents the
machine has not learned from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import BLANKS, written
from landsift.llm.token_ids import slices

SPAN, DECAY = 6, 0.6
#: Letters of a window; longer words are cut into overlapping ones.
WINDOW = 24
#: Documents, about, whose labels are learned from, a quarter of them for calibration.
LABELLED = 12_000
#: Landmarks of either kind; words that are learned from.
LANDMARKS, COMMON, OTHERS, HARD = 160, 96, 3000, 1500
#: Labels are learned only where the CRC-32 of the key leaves another remainder.
PARTS, HELD_OUT = 3, 1
CODES = 64
#: Words whose margins a worker keeps; when there are more, it starts anew.
KNOWN_WORDS = 500_000
_START, _END = 1, 2
#: Digits that stand for letters.
_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def code(letter: str) -> int:
    """3 to 63 for a letter, 0 for what only makes a gap."""
    letter = _LIKE.get(letter, letter)
    if "a" <= letter <= "z":
        return 3 + ord(letter) - 97
    return 29 + ord(letter) % 35 if letter.isalpha() else 0


_ASCII = np.array([code(chr(c).lower()) for c in range(128)], np.int32)


def letters(word: str) -> np.ndarray:
    """The codes of a word, without what stands before its first and after its last letter."""
    if word.isascii():
        c = _ASCII[np.frombuffer(word.encode(), np.uint8)]
    else:
        c = np.array([code(x) for x in word.lower()], np.int32)
    held = np.flatnonzero(c)
    return c[held[0] : held[-1] + 1] if len(held) else c[:0]


def windows(word: str) -> list[np.ndarray]:
    """The marked code sequences by which a word is compared."""
    c = letters(word)
    c = np.concatenate([[_START], c, [_END]]).astype(np.int32) if len(c) else c
    return [c] if len(c) <= WINDOW + 2 else [c[a : a + WINDOW] for a in range(0, len(c) - WINDOW // 2, WINDOW // 2)]


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple and weight of each place in a matrix of equally long sequences; 0 where there is none."""
    n = codes.shape[1]
    found, weights = [np.zeros((len(codes), 1), np.int32)], [np.zeros((len(codes), 1), np.float32)]
    for a, b in _OFFSETS:
        if n > b:
            x, y, z = codes[:, : n - b], codes[:, a : n - b + a], codes[:, b:]
            there = (x > 0) & (y > 0) & (z > 0)
            found.append(np.where(there, (x * CODES + y) * CODES + z, 0))
            weights.append(np.where(there, np.float32(DECAY ** (b + 1)), np.float32(0)))
    return np.concatenate(found, axis=1), np.concatenate(weights, axis=1)


def norms(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each row's kernel with itself: equal triples add up before they are squared."""
    order = np.argsort(found, axis=1)
    f, w = np.take_along_axis(found, order, 1), np.take_along_axis(weights, order, 1)
    run = np.cumsum(w, axis=1)
    last = np.ones(f.shape, np.bool_)
    last[:, :-1] = f[:, 1:] != f[:, :-1]
    ends = np.where(last, run, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(f), 1)), ends[:, :-1]], axis=1), axis=1)
    return np.sqrt(np.square(np.where(last, run - before, 0.0)).sum(axis=1))


def by_length(words: list[str]):
    """(places in ``words``, matrix of codes) of windows of equal length."""
    groups: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, word in enumerate(words):
        for c in windows(word):
            at = groups.setdefault(len(c), ([], []))
            at[0].append(i)
            at[1].append(c)
    for n, (places, rows) in groups.items():
        if n >= 3:
            yield np.array(places), np.array(rows)


@dataclass
class Machine:
    """Decision = table of triples, summed with weights, over the word's norm, plus bias."""

    table: np.ndarray
    bias: float
    logit: tuple[float, float] = (0.0, -4.0)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias, np.float64)
        for places, codes in by_length(words):
            for a in range(0, len(places), 20_000):
                found, weights = triples(codes[a : a + 20_000])
                size = norms(found, weights)
                value = (self.table[found] * weights).sum(axis=1) / np.where(size > 0, size, 1) + self.bias
                np.maximum.at(out, places[a : a + 20_000], value)
        return out


def kernel_rows(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Normalised triples of words over the given columns (sorted triples), one row per word."""
    out = np.zeros((len(words), len(columns)), np.float32)
    for places, codes in by_length(words):
        found, weights = triples(codes)
        size = norms(found, weights)
        at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
        good = (columns[at] == found) & (weights > 0)
        row = np.broadcast_to(places[:, None], found.shape)
        np.add.at(out, (row[good], at[good]), (weights / np.where(size > 0, size, 1)[:, None])[good])
    return out


def fit(bad: dict[str, float], good: dict[str, float], landmarks: list[str]) -> Machine:
    """Squared-hinge machine on Nyström features of weighted words."""
    seen = [triples(codes)[0].ravel() for _, codes in by_length(landmarks)]
    columns = np.unique(np.concatenate(seen)) if seen else np.zeros(1, np.int64)
    columns = columns[columns > 0]
    table = np.zeros(CODES**3, np.float32)
    if not bad or not good or not len(columns):
        return Machine(table, -1.0)
    z = kernel_rows(landmarks, columns)
    values, vectors = np.linalg.eigh(z.astype(np.float64) @ z.T)
    kept = values > 1e-4 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # K_zz to the power of -1/2
    words = [*bad, *good]
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    weight = np.array([*bad.values(), *good.values()])
    weight *= np.where(y > 0, 1 / weight[y > 0].sum(), 1 / weight[y < 0].sum()) * len(words) / 2
    x = np.concatenate([kernel_rows(words[a : a + 500], columns) @ z.T @ root for a in range(0, len(words), 500)])
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 0.5
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps on the active words
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x[active] + ridge, xa.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    table[columns] = (root @ w[:-1]) @ z
    return Machine(table, float(w[-1]))


def sentences(text: str) -> list[str]:
    """Sentences of a text, letters spelled out one by one joined to words."""
    for mark in ".!?\n":
        if mark in text:
            text = text.replace(mark + " ", "\x00") if mark != "\n" else text.replace(mark, "\x00")
    return text.split("\x00")


def spelled(words: list[str]) -> list[str]:
    """The words that runs of three or more single letters spell."""
    out, run = [], []
    for word in [*words, ""]:
        if len(word) == 1 and word.isalpha():
            run.append(word)
            continue
        if len(run) >= 3:
            out.append("".join(run))
        run = []
    return out


_SPLIT = "[" + BLANKS + "]+"


def _top(batch: pa.RecordBatch, machine: Machine, known: dict[str, float]) -> np.ndarray:
    """The margin of the highest word of each text in a batch with column ``t``."""
    texts = pc.fill_null(batch.column("t"), "")
    split = pc.split_pattern_regex(pc.utf8_lower(texts), _SPLIT)
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    words = list(coded.dictionary.to_numpy(zero_copy_only=False))
    if len(known) > KNOWN_WORDS:
        known.clear()
    new = [w for w in words if w not in known]
    known.update(zip(new, machine.margins(new).tolist(), strict=True))
    at = coded.indices.to_numpy()
    value = np.array([known[w] for w in words], np.float64)[at]
    top = np.full(len(batch), machine.bias)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        top[some] = np.maximum.reduceat(value, offsets[some])
    single = np.array([len(w) == 1 and w.isalpha() for w in words], np.bool_)[at]
    runs = np.flatnonzero(single[:-2] & single[1:-1] & single[2:])
    for i in np.unique(np.searchsorted(offsets, runs, side="right") - 1).tolist():
        joined = spelled([words[k] for k in at[offsets[i] : offsets[i + 1]].tolist()])
        top[i] = max([top[i], *machine.margins(joined).tolist()])
    return top


def _margins(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """``keep`` columns and the margin of the highest word of column ``t``."""
    spec = docs.sparkSession.sparkContext.broadcast((machine.table, machine.bias))

    def run(batches):
        table, bias = spec.value
        machine, known = Machine(table, bias), {}
        for batch in batches:
            for some in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(_top(some, machine, known))], [*keep, "top"])

    kinds = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select(*keep, "t").mapInArrow(run, f"{kinds}, top double")


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> DataFrame:
    """id, t, y and part (1 of a quarter, for calibration) of about ``bound`` documents whose labels may be learned.

    Null labels are left out; of several labels of a document the highest holds.
    """
    remainder = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(PARTS))
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (remainder != HELD_OUT))
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = written(known, "toxic-labels")
    n = known.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    known = known.filter(drawn * F.lit(float(max(n, 1))) < F.lit(1_000_000.0 * bound))
    part = F.when(F.pmod(F.xxhash64("id", F.lit("part")), F.lit(4)) == 0, 1).otherwise(0).alias("part")
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(known, "id").select("id", "t", "y", part)


def _word_counts(learned: DataFrame) -> DataFrame:
    """word, bad and good: in how many different sentences of either label a word stands."""
    def run(batches):
        for batch in batches:
            for some in slices(batch, "t"):
                words, hashes, ys = [], [], []
                for t, y in zip(some.column("t").to_pylist(), some.column("y").to_pylist(), strict=True):
                    for s in sentences((t or "").lower()):
                        parts = s.split()
                        own = {w.strip(".,;:!?*#$%&|\"'()") for w in parts} | set(spelled(parts))
                        own = [w for w in own if 3 <= len(w) <= 2 * WINDOW]
                        words += own
                        hashes += [zlib.crc32(s.encode())] * len(own)
                        ys += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(hashes, pa.int64()), pa.array(ys, pa.int32())], ["word", "s", "y"])

    each = learned.select("t", "y").mapInArrow(run, "word string, s long, y int").distinct()
    return each.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED) -> Machine:
    """Learn from labelled documents whose key's CRC-32 does not leave the held-out remainder.

    All that reaches the driver has a fixed size: landmarks, words learned from, and one
    margin for each of the labelled documents used for calibration.
    """
    learned = written(_labelled(docs, labels, key, text, label, bound), "toxic-learned")
    counts = written(_word_counts(learned.filter("part = 0")), "toxic-words")
    total = counts.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total["n"] or not total["bad"] or not total["good"]:
        return Machine(np.zeros(CODES**3, np.float32), -1.0)
    base = total["bad"] / (total["bad"] + total["good"])
    # so often in toxic sentences alone that not one word of all would be by chance
    least = int(np.ceil(np.log(0.5 / total["n"]) / np.log(base))) if base < 1 else 1
    surely = (F.col("bad") >= least) & (F.col("good") * 50 <= F.col("bad"))
    bad = {r["word"]: float(r["bad"]) for r in counts.filter(surely).orderBy(F.col("bad").desc(), "word").limit(LANDMARKS * 3).collect()}
    common = [(r["word"], r["good"]) for r in counts.filter("good > 0 AND bad <= good").orderBy(F.col("good").desc(), "word").limit(OTHERS).collect()]
    other = counts.filter("good > 0 AND bad <= good").orderBy(F.xxhash64("word"), "word").limit(OTHERS).collect()
    good = {w: 1.0 for w, _ in common} | {r["word"]: 1.0 for r in other}
    bad = {w: float(np.log1p(n)) for w, n in bad.items()}
    landmarks = [*list(bad)[:LANDMARKS], *[w for w, _ in common[:COMMON]]]
    machine = fit(bad, good, landmarks)
    for _ in range(2):  # clean words that look like insults, and rarer insults that look like others
        spec = machine

        def run(batches, spec=spec):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spec.margins(batch.column("word").to_pylist()))], ["word", "bad", "good", "m"])

        judged = written(counts.mapInArrow(run, "word string, bad long, good long, m double"), "toxic-judged")
        hard = judged.filter("good > 0 AND bad <= good").orderBy(F.col("m").desc(), "word").limit(HARD).collect()
        rare = judged.filter("good = 0 AND bad >= 2 AND m > 0.5").orderBy(F.col("bad").desc(), "word").limit(HARD).collect()
        good |= {r["word"]: 1.0 for r in hard}
        more = bad | {r["word"]: 0.5 for r in rare if r["word"] not in bad}
        machine = fit(more, good, landmarks)
    tried = _margins(learned.filter("part = 1").withColumn("y", F.col("y").cast("long")), machine, ["y"]).collect()
    machine.logit = calibrate(np.array([r["top"] for r in tried]), np.array([float(r["y"]) for r in tried]))
    return machine


def calibrate(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and constant of a logistic fit with a little shrinkage; (0, -4) without both labels."""
    if not len(y) or y.min() == y.max():
        return (0.0, -4.0)
    x = np.stack([top, np.ones(len(y))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(2), x.T @ (y - p) - 0.02 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its whole text.

    held_out: the CRC-32 of the key as text leaves the remainder whose labels are not learned.
    Null and empty texts get the score of a text without words; a null key counts as empty
    text; repeated rows stay. Without labels of both kinds every score is low. An empty table
    gives no rows.
    """
    machine = train(docs, labels, key, text, label)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    a, b = machine.logit
    out = _margins(rows, machine, ["doc_id"])
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(PARTS))
    value = 1 / (1 + F.exp(-(F.lit(a) * F.col("top") + F.lit(b))))
    out = out.select("doc_id", (part == HELD_OUT).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
