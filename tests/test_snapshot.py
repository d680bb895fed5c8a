"""Keyed snapshots: what a batch writes, reads and leaves when it ends early."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from landsift.operators.snapshot import KeyedSnapshot

SCHEMA = ST.StructType([ST.StructField("k", ST.StringType()), ST.StructField("v", ST.LongType())])


def latest(rows):
    return rows.groupBy("k").agg(F.max("v").alias("v"))


def made(spark, path, buckets=8):
    return KeyedSnapshot(spark, str(path), "k", SCHEMA, latest, buckets)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(snapshot):
    return {r.k: r.v for r in snapshot.read().collect()}


def test_batches_equal_one_grouping(spark, tmp_path):
    s = made(spark, tmp_path / "s")
    assert content(s) == {} and s.manifest() == {}
    whole = {}
    for n in range(4):
        rows = [(f"k{(i * 7 + n) % 40}", n * 100 + i) for i in range(30)]
        assert s.apply(batch(spark, rows), n)
        for k, v in rows:
            whole[k] = max(v, whole.get(k, -1))
        assert content(s) == whole
    assert s.apply(batch(spark, [("k1", 10**6)]), 3) == []  # a batch that runs again
    assert content(s) == whole


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    s = made(spark, tmp_path / "s")
    s.apply(batch(spark, [(f"k{i}", i) for i in range(200)]), 0)
    before = s.manifest()
    touched = s.apply(batch(spark, [("k5", 999)]), 1)
    after = s.manifest()
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == [str(touched[0])]
    assert os.listdir(tmp_path / "s/data/1") != [] and content(s)["k5"] == 999 and len(content(s)) == 200
    # folders that the last two versions do not name go
    s.apply(batch(spark, [("k5", 1000)]), 2)
    s.apply(batch(spark, [("k5", 1001)]), 3)
    gone = f"_bucket={touched[0]}"
    assert gone not in os.listdir(tmp_path / "s/data/0") and gone in os.listdir(tmp_path / "s/data/3")
    assert s.versions() == [2, 3] and content(s)["k5"] == 1001


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = made(spark, tmp_path / "s")
    s.apply(batch(spark, [("a", 1), ("b", 2)]), 0)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(KeyedSnapshot, "_switch", crash)
    with pytest.raises(OSError):
        s.apply(batch(spark, [("a", 9)]), 1)
    assert content(s) == {"a": 1, "b": 2}
    monkeypatch.undo()
    s.apply(batch(spark, [("a", 9)]), 1)  # and runs again
    assert content(s) == {"a": 9, "b": 2}
