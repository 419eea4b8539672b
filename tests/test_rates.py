import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilframe.operators import metrics, rates
from veilframe.operators.ordered import running_total, sequence_blocks, time_blocks

T0 = datetime(2024, 1, 1)


def at(us):
    return T0 + timedelta(microseconds=us)


def test_running_total_over_blocks_and_null_keys(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    blocked = sequence_blocks(df, "seq", rows=17)
    got = running_total(blocked, ["k"], ["seq"], F.col("v"), "total").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["total"] == sum((i * 7) % 5 for i in range(r["seq"] + 1))


def test_running_total_over_seconds_and_missing_times(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, at(rng.randrange(10**11)), at(i)]), rng.randint(-3, 3)) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, ts timestamp, v int")
    got = running_total(time_blocks(df, "ts"), [], ["ts", "i"], F.col("v"), "total").collect()
    total, want = 0, {}
    for i, ts, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        total += v
        want[i] = total
    assert {r["i"]: r["total"] for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_concurrency(spark, seed):
    rng = random.Random(seed)
    calls = []
    for i in range(400):
        start = rng.randint(0, 3000)
        calls.append((i, at(start), at(start + rng.choice([0, 1, 5, 200]))))
    df = spark.createDataFrame(calls, "i int, s timestamp, e timestamp")
    edges = sorted([(s, 1, i) for i, s, _ in calls] + [(e, -1, i) for i, _, e in calls])
    active, expected, peak = 0, {}, 0
    for _, d, i in edges:
        active += d
        peak = max(peak, active)
        if d > 0:
            expected[i] = active
    got = rates.over_concurrency(df, "s", "e", "i", cap=10).collect()
    assert {r["i"]: r["active"] for r in got} == {i: a for i, a in expected.items() if a > 10}
    assert rates.peak_concurrency(df, "s", "e", "i").first()["peak"] == peak


def test_failure_runs_with_one_dominant_provider(spark):
    rng = random.Random(4)
    log = [(i, rng.choice(["hot", "hot", "hot", "b", None]), at(i // 2), rng.random() < 0.7) for i in range(3000)]
    df = spark.createDataFrame(log, "i int, p string, ts timestamp, bad boolean")
    runs = []
    for p in ("hot", "b", None):
        run = []
        for i, q, ts, bad in log + [(-1, p, None, False)]:
            if q == p:
                if bad:
                    run.append(ts)
                else:
                    if len(run) >= 3:
                        runs.append((p, run[0], run[-1], len(run)))
                    run = []
    got = rates.failure_runs(df, "p", "ts", "i", "bad", at_least=3)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(runs, key=key)


@pytest.mark.parametrize("seconds", [1, 3])
def test_over_rate(spark, seconds):
    rng = random.Random(9)
    log, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1000, 90_000, 400_000, 1_000_000, 4_000_000])
        log.append((i, rng.choice(["hot"] * 6 + ["a", "b", None]), at(t)))
    df = spark.createDataFrame(log, "i int, who string, ts timestamp")
    got = rates.over_rate(df, "who", "ts", "i", limit=3, seconds=seconds).collect()
    assert len(got) == len(log)
    for r in got:
        near = [1 for _, w, ts in log
                if w == r["who"] and timedelta(0) <= r["ts"] - ts < timedelta(seconds=seconds)]
        assert (r["recent"], r["over"]) == (len(near), len(near) > 3)


def test_over_rate_of_a_busy_caller_is_a_running_sum(spark):
    df = spark.range(4000).selectExpr("id", "'hot' as who", "timestamp_micros((id div 2) * 600) as ts")
    rows = rates.over_rate(df, "who", "ts", "id", limit=100)
    window = 1_000_000
    times = [(i // 2) * 600 for i in range(4000)]
    for r in rows.collect():
        assert r["recent"] == sum(1 for t in times if 0 <= times[r["id"]] - t < window)
    # a frame that slides is counted anew for every row
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "unboundedpreceding$(), currentrow$()" in plan


def test_latency_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("G", "/", m) for m in (1, 5, 6, 100, 20_000)], "method string, path string, latency_ms bigint")
    rows = {r["le"]: r["cumulative"] for r in metrics.latency_histogram(df).collect()}
    assert rows[0.005] == 2 and rows[0.01] == 3 and rows[0.1] == 4 and rows[10.0] == 4 and rows[float("inf")] == 5
