"""The manifest against trees built node by node."""

import hashlib
import zlib

from landsift.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, node string, i long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def fold(nodes):
    """Root and, per node, its siblings on the left and right level by level."""
    paths, spot = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for k, p in enumerate(spot):
            run = runs[p // 8]
            paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
            spot[k] = p // 8
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    rows = [tuple(r[:5]) for r in rows]
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: fold([h(*map(value, r)) for r in by[k]]) for k in langs}
    root, above = fold([trees[k][0] for k in langs]) if langs else (None, [])
    out = []
    for k, up in zip(langs, above, strict=True):
        for r, path in zip(by[k], trees[k][1], strict=True):
            leaf, t = h(*map(value, r)), r[4]
            if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            now = h(*map(value, (*r[:4], t)))
            for left, right in path + up:
                now = h(*left, now, *right)
            proof = h(*[x for left, right in path + up for x in left + right])
            out.append((r[0], leaf, trees[k][0], root, proof, now, now == root))
    return out


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


def row(k, lang, text="Some Text", source="web"):
    return (k, source, lang, None if k is not None and k % 7 == 0 else 9, text, "x", "y", 1)


def test_manifest_equals_trees(spark):
    rows = [row(k, "en", f"Text No {k}") for k in range(0, 1200, 2)]  # more than one tree of 512
    rows += [row(k, "de", "Ünï ß") for k in range(9)]  # a last run of one
    rows += [row(5001, None, None), row(5002, "", ""), row(5004, "zz", "A" * 100_000), row(5005, "Ä", "b"), row(5006, "fr", None, None)]
    rows += [row(None, "es", "X y"), row(None, "es", "X y"), row(6000, "es", "X y")] + [row(6001, "es")] * 20  # null and repeated keys
    rows += [row(7000 + k, f"l{k:02}") for k in range(11)]  # more languages than one run
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_small_manifests(spark):
    assert got(spark, []) == []
    for rows in ([row(3, "en")], [row(3, None), row(4, None)], [row(k, "en") for k in range(8)], [row(k, "en", None) for k in range(65)]):
        assert got(spark, rows) == sorted(brute(rows), key=str)


def test_blocks_of_a_window_do_not_mix(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [row(k, "en", f"t{k}") for k in range(150)]
    assert got(spark, rows) == sorted(brute(rows), key=str)
    assert any(not r[-1] for r in got(spark, [row(k, "en", "A") for k in range(20)]))
