"""Repair of conversation structure by a dynamic program with square-root checkpoints.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``. Four states know
how far that is (start, after s, after u, after ua); a state-cost vector holds what the rest
costs from each. Going backward, vectors are stored only at every square root of the rows;
going forward, the vectors of one stretch at a time are computed again from its checkpoint,
and the least letter among the edits that keep the cost (the tight ones) is written.

Up to ``SEGMENT`` rows a conversation is repaired where its rows meet. A longer one is cut
into blocks of the square root of its rows (``SEGMENT`` at least), which are dealt to all
tasks: blocks become 4 x 4 cost tables, the tables give the vector at each block's end (the
checkpoints), blocks walk from all four states, and the states are chained from the first
block on. Only numbers of blocks meet per conversation, and at last the repaired texts in
order, as SHA-256 goes through them one after the other; they are streamed.

Defined results: a null counts as one space, also in the key of the damage; rows of one turn
come by role, then a hash of the text; conv_id null is a conversation; copies of rows are rows of their own;
empty texts are blank; other columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import written
from landsift.llm.order import numbered

#: Rows up to which a conversation is repaired in one piece, and least rows of a block.
SEGMENT = 1024
DELETE, RESTATE, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = 1 << 60
#: Per state: the role that comes next, and the state after it.
ROLE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}
VISIBLE = "[^\\x20\\x09-\\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (``g``, turn, role, text) after the damage that crc32 of ``conv_id:turn`` chooses.

    ``g`` stands for conv_id and is never null. 0 drops the row, 1 empties its text, 2 takes its
    ``.!?``, 3 doubles it, 4 makes its role user.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select(
        _group(F.col("`conv_id`")).alias("g"),
        F.col("`turn`").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("what"),
    ).filter("what <> 0")
    return rows.select(
        "g",
        "turn",
        F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _group(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv.cast("string")), F.lit("0"))


# The dynamic program. A code is (initial of the role, fault): b(lank), d(uplicate), t(runcated) or "".


def settle(v: list) -> list:
    """A vector after insertions before the next row are allowed."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + u), min(v[1], INSERT + u), u, a]


END = settle([0, FAR, FAR, 0])


def moves(state: int, code: tuple) -> list:
    """Edits of a row in ASCII order: (letter, cost, state after it)."""
    initial, fault = code
    found = [("D", DELETE, state)]
    if fault in ("", "t"):
        more = TRUNCATED if fault else 0
        if state == 0 and initial == "s":
            found.append(("K", more, 1))
        if initial == ROLE[state][0]:
            found.append(("K", more, NEXT[state]))
        else:
            found.append(("R", more + RESTATE, NEXT[state]))
    return found


MOVES = {(s, i, f): moves(s, (i, f)) for s in range(4) for i in ("s", "u", "a", "") for f in ("", "b", "d", "t")}


def before(code: tuple, after: list) -> list:
    """The vector before a row from the one after it."""
    return settle([min(cost + after[to] for _, cost, to in MOVES[s, *code]) for s in range(4)])


def vector(codes: list, end: list) -> list:
    for code in reversed(codes):
        end = before(code, end)
    return end


def walk(codes: list, end: list, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits of the rows from a state, and the state after the last row."""
    step = max(1, math.isqrt(len(codes)))
    marks, v = {len(codes): end}, end
    for k in range(len(codes) - 1, -1, -1):
        v = before(codes[k], v)
        if k % step == 0:
            marks[k] = v
    letters = []
    for start in range(0, len(codes), step):
        stop = min(start + step, len(codes))
        held = [marks[stop]]
        for k in range(stop - 1, start - 1, -1):
            held.append(before(codes[k], held[-1]))
        held.reverse()
        for k in range(start, stop):
            now, after = held[k - start], held[k - start + 1]
            while True:
                tight = [(letter, to) for letter, cost, to in MOVES[state, *codes[k]] if cost + after[to] == now[state]]
                if INSERT + now[NEXT[state]] == now[state] and not (tight and tight[0][0] == "D"):
                    letters.append("I")
                    state = NEXT[state]
                    continue
                letters.append(tight[0][0])
                state = tight[0][1]
                break
    return "".join(letters), state


def finish(state: int) -> tuple[str, int]:
    """Insertions after the last row."""
    letters = ""
    while END[state]:
        letters, state = letters + "I", NEXT[state]
    return letters, state


def lines(rows, audit: str, state: int):
    """The repaired ``role:text`` lines of (role, text) rows."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            yield f"{ROLE[state]}:"
            state = NEXT[state]
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        first = letter == "K" and state == 0 and role[0] == "s"
        yield f"{role if letter == 'K' else ROLE[state]}:{text}"
        state = 1 if first else NEXT[state]


def fault_of(text: str, seen: bool) -> str:
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    return "b" if not bare else "d" if seen else "" if bare[-1] in ".!?" else "t"


# What is counted, so that the counts of neighbouring blocks add up.


def counts(rows: list) -> dict:
    """Counts of consecutive rows (turn, initial, fault)."""
    turns = [t for t, _, _ in rows if t is not None]
    marks = [i for _, i, _ in rows]
    faults = [f for _, _, f in rows]
    return {
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "turns": len(set(turns)),
        **{name: faults.count(f) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))},
        "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(marks)),
        "head": marks[0],
        "tail": marks[-1],
    }


def added(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    both = a["high"] is not None and b["low"] is not None
    out = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= both and a["high"] == b["low"]
    out["illegal"] += a["tail"] + b["head"] not in LEGAL
    out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    return out | {"head": a["head"], "tail": b["tail"]}


def figures(c: dict) -> dict:
    gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]
    return {"gaps": gaps, **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def _schema(said: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in said.split(", "))])


def _grouped(df: DataFrame, keys: list[str], order: list, fn, schema: str) -> DataFrame:
    """``fn(key, rows)`` over the rows (dicts, in order, an iterator) of each key; it yields dicts.

    Rows stream: a group is never held whole by this function.
    """
    held = _schema(schema)

    def stream(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield from batch.slice(start, 256).to_pylist()

    def run(batches):
        out, size = [], 0
        for key, rows in itertools.groupby(stream(batches), key=lambda r: tuple(r[k] for k in keys)):
            for row in fn(key, rows):
                out.append(row)
                size += 64 + sum(len(x) for x in row.values() if isinstance(x, str))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, held)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of up to ``SEGMENT`` rows, each in one piece."""

    def repair(key, group):
        seen, held, codes = set(), [], []
        for r in group:
            pair = (r["role"], r["text"])
            held.append((r["turn"], r["role"][:1], fault_of(r["text"], pair in seen)))
            codes.append((_initial(r["role"]), held[-1][2]))
            seen.add(pair)
            held[-1] += (pair,)
        audit, state = walk(codes, END, 0)
        audit += finish(state)[0]
        hashed = hashlib.sha256("\n".join(lines((h[3] for h in held), audit, 0)).encode())
        total = figures(counts([h[:3] for h in held])) | {"cost": vector(codes, END)[0]}
        yield {"g": key[0], **total, "audit": audit, "repaired_sha256": hashed.hexdigest()}

    kept = rows.select("g", "i", "turn", "role", "text")
    return _grouped(kept, ["g"], ["i"], repair, f"g string, {FIGURES}, audit string, repaired_sha256 string")


def _long(rows: DataFrame) -> DataFrame:
    """Longer conversations, block by block (see above)."""
    block = F.greatest(F.lit(SEGMENT), F.ceil(F.sqrt("n")))
    rows = rows.withColumn("b", F.floor(F.col("i") / block))
    words = F.regexp_extract("text", f"({VISIBLE})[\\x20\\x09-\\x0D]*\\z", 1)
    told = rows.select(
        "g", "b", "i", "turn", F.left("role", F.lit(1)).alias("mark"), words.alias("last"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("key"),
    )
    first = told.groupBy("g", "key").agg(F.min("i").alias("i")).withColumn("first", F.lit(True))
    fault = F.when(F.col("last") == "", "b").when(F.col("first").isNull(), "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("")
    codes = written(told.join(first, ["g", "key", "i"], "left").select("g", "b", "i", "turn", "mark", fault.alias("fault")), "dialogue-codes")

    def code(r):
        return (_initial(r["mark"]), r["fault"])

    def table(key, group):
        held = [(r["turn"], r["mark"], r["fault"]) for r in group]
        known = [(_initial(m), f) for _, m, f in held]
        units = [vector(known, [0 if s == j else FAR for s in range(4)]) for j in range(4)]
        yield {"g": key[0], "b": key[1], **counts(held), "costs": [units[j][s] for s in range(4) for j in range(4)]}

    blocks = written(_grouped(codes, ["g", "b"], ["i"], table, f"g string, b long, {COUNTS}, costs array<long>"), "dialogue-blocks")

    def ends(key, group):
        v = END
        for r in group:
            yield {"g": key[0], "b": r["b"], "end": v}
            m = r["costs"]
            v = [min(FAR, *(m[4 * s + j] + v[j] for j in range(4))) for s in range(4)]
        yield {"g": key[0], "b": -1, "end": v}

    back = written(_grouped(blocks.select("g", "b", "costs"), ["g"], [F.desc("b")], ends, "g string, b long, end array<long>"), "dialogue-ends")

    def walks(key, group):
        head = next(group)
        known = [code(r) for r in group]
        found = [walk(known, head["end"], s) for s in range(4)]
        yield {"g": key[0], "b": key[1], "states": [s for _, s in found], "audits": [a for a, _ in found]}

    none = F.lit(None)
    dealt = codes.select("g", "b", "i", "mark", "fault", none.cast("array<long>").alias("end")).unionByName(
        back.filter("b >= 0").select("g", "b", F.lit(-1).cast("long").alias("i"), none.cast("string").alias("mark"), none.cast("string").alias("fault"), "end")
    )
    paths = _grouped(dealt, ["g", "b"], ["i"], walks, "g string, b long, states array<long>, audits array<string>")

    def chain(key, group):
        state, total, last = 0, None, None
        for r in group:
            if last is not None:
                yield last
            entry, audit, state = state, r["audits"][state], r["states"][state]
            total = added(total, r)
            last = {"g": key[0], "b": r["b"], "state": entry, "audit": audit}
        last["audit"] += finish(state)[0]
        yield last | figures(total)

    sums = FIGURES.removesuffix(", cost long")
    chained = written(_grouped(blocks.drop("costs").join(paths, ["g", "b"]), ["g"], ["b"], chain, f"g string, b long, state long, audit string, {sums}"), "dialogue-audits")

    def piece(key, group):
        head = next(group)
        told = ((r["role"], r["text"]) for r in group)
        yield {"g": key[0], "b": key[1], "audit": head["audit"], "piece": "\n".join(lines(told, head["audit"], head["state"]))}

    texts = rows.select("g", "b", "i", "role", "text", none.cast("string").alias("audit"), none.cast("long").alias("state")).unionByName(
        chained.select("g", "b", F.lit(-1).cast("long").alias("i"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", "state")
    )
    pieces = _grouped(texts, ["g", "b"], ["i"], piece, "g string, b long, audit string, piece string")

    def digest(key, group):
        hashed, audits, some = hashlib.sha256(), [], False
        for r in group:
            audits.append(r["audit"])
            if r["piece"]:
                hashed.update(("\n" if some else "").encode() + r["piece"].encode())
                some = True
        yield {"g": key[0], "audit": "".join(audits), "repaired_sha256": hashed.hexdigest()}

    whole = _grouped(pieces, ["g"], ["b"], digest, "g string, audit string, repaired_sha256 string")
    cost = back.filter("b = -1").select("g", F.col("end")[0].alias("cost"))
    total = chained.filter("gaps IS NOT NULL").select("g", *[x.split()[0] for x in sums.split(", ")])
    return total.join(cost, "g").join(whole, "g")


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired conversation, for every conv_id.

    Conversations without rows after the damage have zeros, no edits and the hash of nothing.
    """
    rows = numbered(damage(conversations), ["g"], ["turn", "role", "mark"], {"mark": F.xxhash64("text")})
    done, long = _short(rows.filter(F.col("n") <= SEGMENT)), rows.filter(F.col("n") > SEGMENT)
    if not long.isEmpty():
        done = done.unionByName(_long(long))
    every = conversations.select(F.col("`conv_id`").alias("conv_id")).distinct().withColumn("g", _group(F.col("conv_id")))
    sums = [F.coalesce(x.split()[0], F.lit(0).cast("long")).alias(x.split()[0]) for x in FIGURES.split(", ")]
    none = hashlib.sha256().hexdigest()
    return every.join(done, "g", "left").select(
        "conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256")
    )
