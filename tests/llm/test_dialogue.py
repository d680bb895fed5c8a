"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from landsift.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, g string, n string, i string"
VISIBLE = "[^\x20\x09-\x0d]"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if what == 0:
            continue
        role = "user" if what == 4 else role
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        found = re.findall(VISIBLE, text)
        out.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, edits, lines) by a search over places and emitted initials' states."""

    def after(word, initial):
        return {"s": "s", "u": "u", "su": "u", "ua": "a", "au": "u"}.get(word + initial) if initial else None

    @lru_cache(None)
    def best(k, state, inserted):
        options = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for role in ("user", "assistant"):
                to = after(state, role[0])
                if to:
                    c, e, t = best(k, to, inserted + 1)
                    options.append((c + 5, "I" + e, (f"{role}:", *t)))
        if k < len(rows):
            role, text = rows[k][2:]
            c, e, t = best(k + 1, state, 0)
            options.append((c + 2, "D" + e, t))
            if marks[k] in ("", "t"):
                more = 5 if marks[k] else 0
                for letter, to, cost in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    new = after(state, to[:1])
                    if new:
                        c, e, t = best(k + 1, new, 0)
                        options.append((c + cost + more, letter + e, (f"{to}:{text}", *t)))
        return min(options, key=lambda x: x[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damaged([r[:4] for r in rows if r[0] == conv])
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest(mine, marks)
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "cut", "", "  \n", "Ünï. \t", None, "a:b\nc.", "Long " * 2000 + "."]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "uncle"]
    rows = []
    for conv in [*range(60), None]:
        turns = sorted(r.randrange(0, 9) for _ in range(r.randrange(1, 8)))
        rows += [(conv, t if r.random() > 0.05 else None, r.choice(roles), r.choice(texts)) for t in turns]
    for conv in range(60, 75):  # mostly right ones
        for t in range(r.randrange(2, 12)):
            rows.append((conv, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}."))
    return settled(rows)


def settled(rows):
    """Without rows that share turn and, after the damage, role: a hash of the text orders those."""
    seen, out = set(), []
    for row in rows:
        now = damaged([(*row[:3], "x.")])
        key = (*row[:2], now[0][2] if now else "")
        if key not in seen:
            seen.add(key)
            out.append((*row[:4], "x", "y", "z"))
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in dialogue.repair(df).collect()}


def test_repair_equals_search(spark):
    rows = conversations()
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == {}


def test_blocks_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT", 3)
    rows = conversations()
    assert got(spark, rows) == brute(rows)
    hot = settled((1, t // 2 if t % 9 else None, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 50}.") for t in range(300))
    assert got(spark, hot) == brute(hot)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_edits_are_the_least_of_all(n):
    """Every word of edits is tried: cost first, then ASCII order."""
    for codes in itertools.product(itertools.product(("s", "u", "a", ""), ("", "b", "t")), repeat=n):
        found = []

        def spread(k, word, edits, cost):
            if len(edits) > n + 3 or cost > 2 * n:  # deleting all rows costs 2 each
                return
            if k == n and LEGAL.fullmatch(word):
                found.append((cost, edits))
            for initial in "ua":
                spread(k, word + initial, edits + "I", cost + 5)
            if k < n:
                initial, fault = codes[k]
                spread(k + 1, word, edits + "D", cost + 2)
                if fault != "b":
                    more = 5 if fault else 0
                    if initial:
                        spread(k + 1, word + initial, edits + "K", cost + more)
                    for to in "ua":
                        spread(k + 1, word + to, edits + "R", cost + more + 1)

        spread(0, "", "", 0)
        audit, state = dialogue.walk(list(codes), dialogue.END, 0)
        assert (dialogue.vector(list(codes), dialogue.END)[0], audit + dialogue.finish(state)[0]) == min(found)
