import random

from pyspark.sql import functions as F

from landsift.operators import spatial_join as S
from landsift.operators import usage as U


def boxes(spark, rng, n, side, name, wide):
    rows = [(i, x, y, x + rng.uniform(1, wide), y + rng.uniform(1, wide)) for i in range(n) for x, y in [(rng.uniform(0, side), rng.uniform(0, side))]]
    return rows, spark.createDataFrame(rows, f"{name} int, x0 double, y0 double, x1 double, y1 double").coalesce(1)


def test_a_crowded_place_is_dealt_over_tasks_and_nothing_is_broadcast(spark, monkeypatch):
    """All boxes in few cells, read by one task: the pairs still come from many tasks."""
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "TASK_PAIRS", 20_000)
    rng = random.Random(5)
    left, l = boxes(spark, rng, 700, 300, "a", 20)
    right, r = boxes(spark, rng, 300, 300, "b", 90)
    pairs = S.box_join(l, r)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 2  # the crowded cells alone
    sizes = [row["count"] for row in pairs.groupBy(F.spark_partition_id()).count().collect()]
    want = {(a[0], b[0]) for a in left for b in right if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = [(p.a, p.b) for p in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(sizes) >= 4 and max(sizes) < len(want) / 3


def test_job_states_are_not_broadcast(spark):
    """Files of repeated texts are small; the states read from them are not."""
    log = spark.createDataFrame([("a", "queued")], "job_id string, status string")
    from landsift.operators.traffic import conform_requests

    jobs = U.parse_jobs(spark.createDataFrame([('{"id": "a", "status": "failed", "updated_at": "2024-01-01T00:00:00"}',)], "value string"))
    plan = U.sync_job_state(conform_requests(log), jobs)
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [(r.job_id, r.status) for r in plan.collect()] == [("a", "failed")]
