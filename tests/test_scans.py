"""Prefix scans over partitions against plain loops: hot keys, keys at edges, nulls, ties, empty tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from routesift.operators import alerts as A
from routesift.operators import baselines as B
from routesift.operators import folds

T0 = datetime(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(microseconds=t) if t is not None else None, i, [1] * x if x is not None else None) for i, (k, t, x) in enumerate(rows)], "prefix string, timestamp timestamp_ntz, event_id long, as_path array<int>").repartition(3)


def slow_states(rows, alpha=0.1):
    out, held = {}, {}
    for i, (k, t, x) in sorted(enumerate(rows), key=lambda r: (r[1][0] or "", r[1][1], r[0])):
        ema, var, n = held.get(k, (0.0, 0.0, 0))
        before = ema, var, n
        if n == 0:
            ema, var = x, 0.0
        elif x is None or ema is None:
            ema = var = None
        else:
            delta = x - ema
            ema, var = ema + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
        held[k] = ema, var, n + 1
        out[i] = before, held[k]
    return out, held


def close(a, b):
    return a[2] == b[2] and all((x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-9)) for x, y in zip(a[:2], b[:2], strict=True))


@pytest.mark.parametrize("kind", ["hot", "few", "many", "nulls"])
def test_states_equal_a_loop(spark, kind):
    rng = random.Random(kind)
    keys = {"hot": ["p"], "few": ["p", "q", "r"], "many": [f"k{i}" for i in range(300)], "nulls": ["p", None, "q"]}[kind]
    n = 20_000 if kind == "hot" else 3000
    rows = [(rng.choice(keys), rng.randrange(10**9), rng.choice([3, 3, 4, 9, rng.randrange(1, 30)])) for _ in range(n)]
    if kind == "nulls":
        rows[1500] = ("q", rows[1500][1], None)
    e = rows_of(spark, rows)
    states, held = slow_states(rows)
    got = {r["event_id"]: (r["ema"], r["var"], r["n"]) for r in B.event_states(e, F.col("as_path").isNotNull().cast("int") * F.size("as_path") if kind != "nulls" else F.when(F.col("as_path").isNotNull(), F.size("as_path")), state="after").collect()}
    assert set(got) == set(states) and all(close(got[i], states[i][1]) for i in got)
    value = F.when(F.col("as_path").isNotNull(), F.size("as_path"))
    before = {r["event_id"]: (r["ema"], r["var"], r["n"]) for r in B.event_states(e, value).collect()}
    assert all(close(before[i], states[i][0]) for i in before)
    ends = {r["prefix"]: (r["ema"], r["var"], r["n"]) for r in B.ema_baseline(e, value).collect()}
    assert set(ends) == set(held) and all(close(ends[k], held[k]) for k in ends)


def test_a_hot_key_lies_in_all_partitions(spark):
    rows = spark.range(40_000).select(F.lit("p").alias("prefix"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("timestamp"), F.col("id").alias("event_id"), F.array(F.lit(1)).alias("as_path"))
    sizes = [r["count"] for r in B.event_states(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 20_000


def test_summaries_stand_for_their_runs():
    rng = np.random.default_rng(1)
    fold = folds.MovingAverage(0.1, False)
    for _ in range(50):
        values = rng.integers(1, 40, rng.integers(1, 200)).astype(float)
        for state in (None, (rng.random() * 50, rng.random() * 9, 7)):
            assert close(fold.enter(fold.summary(values), state), fold.run(values, state)[1])
    for ttl in (0, 1, 10, 1000):
        fold = folds.AnchoredTimes(ttl)
        for _ in range(100):
            values = np.sort(rng.integers(0, 500, rng.integers(1, 120)))
            values[: rng.integers(0, 2)] = fold.NONE
            for state in (None, -1, -ttl // 2, -ttl):
                assert fold.enter(fold.summary(values), state) == fold.run(values, state)[1]


@pytest.mark.parametrize(("span", "ttl"), [(10_000, 7), (60, 7), (3, 7), (10_000, 0)])
def test_new_ones_equal_a_loop(spark, span, ttl):
    rng = random.Random(span)
    rows = [(rng.choice(["f", "f", "f", "g", None]), None if rng.random() < 0.01 else rng.randrange(span * 1_000_000), None) for _ in range(8000)]
    got = {r["event_id"]: r["is_new"] for r in A.dedup_flags(rows_of(spark, rows), "prefix", "timestamp", "event_id", ttl).collect()}
    last, expected = {}, {}
    for i, (k, t, _) in sorted(enumerate(rows), key=lambda r: (r[1][1] is not None, r[1][1], r[0])):
        if t is None:
            expected[i] = None
            continue
        expected[i] = k not in last or t - last[k] >= ttl * 1_000_000
        if expected[i]:
            last[k] = t
    assert got == expected


def test_empty_tables_scan_to_nothing(spark):
    e = rows_of(spark, [("p", 1, 1)]).where("false")
    assert B.event_states(e).collect() == B.ema_baseline(e).collect() == A.dedup_flags(e, "prefix", "timestamp").collect() == []
