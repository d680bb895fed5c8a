"""Deep pages of the request log against sorting all of it."""

import datetime as dt
import random

import pytest

from landsift.operators import traffic as R

START = dt.datetime(2024, 1, 1)


def log_of(spark, rng, n):
    rows = [(f"R{k:05}", START + dt.timedelta(seconds=rng.choice([0, 7, rng.randrange(90_000), rng.randrange(10**8)])) if k % 50 else None) for k in range(n)]
    return rows, spark.createDataFrame(rows, "request_id string, requested_at timestamp_ntz")


@pytest.mark.parametrize(("rows_a_page", "buckets"), [(20, 4), (200, 1024)])
def test_pages_equal_sorting_everything(spark, monkeypatch, rows_a_page, buckets):
    monkeypatch.setattr(R, "PAGE_ROWS", rows_a_page)
    monkeypatch.setattr(R, "PAGE_BUCKETS", buckets)
    rows, df = log_of(spark, random.Random(5), 1500)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[0]), reverse=True)
    for offset in (0, 300, 1460, 1499, 1500, 5000):
        got = [r.request_id for r in R.request_page(df, 30, offset).collect()]
        assert got == [r[0] for r in ordered[offset : offset + 30]], offset
    assert R.request_page(df.limit(0), 10, 700).collect() == []


def test_a_deep_page_sorts_few_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE_ROWS", 100)
    rows = [(f"R{k}", START + dt.timedelta(seconds=k)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "request_id string, requested_at timestamp_ntz")
    held, rest = R.page_range(df, 15_000, 30)
    assert df.filter(held).count() <= 100 and rest < 100
