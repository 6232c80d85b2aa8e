"""Counters, merged states, stored activity, removal of partitions and the streams with timers, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from routesift.operators import activity as A
from routesift.operators import baselines as B
from routesift.operators import events as E
from routesift.operators import metrics as M
from routesift.operators import storage
from routesift.operators import waves as W
from routesift.streaming import operators as T

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# Counters


def slow_increase(samples, stop, span):
    held = sorted((t, v) for t, v in samples if stop - span < t <= stop)
    if len(held) < 2:
        return None
    up = sum(b if b < a else b - a for (_, a), (_, b) in zip(held, held[1:], strict=False))
    seen = held[-1][0] - held[0][0]
    mean = seen / (len(held) - 1)
    before, after = held[0][0] - (stop - span), stop - held[-1][0]
    before = mean / 2 if before >= mean * 1.1 else before
    after = mean / 2 if after >= mean * 1.1 else after
    if up > 0 and held[0][1] >= 0:
        before = min(before, seen * held[0][1] / up)
    return up * (seen + before + after) / seen


@pytest.mark.parametrize(("span", "step"), [(60, 15), (300, 60), (60, 60), (30, 60)])
def test_increases_equal_a_loop(spark, span, step):
    rng = random.Random(span)
    series = {}
    for label in "ab":
        t, v, out = 0, 0.0, []
        for _ in range(150):
            t += rng.choice([5, 15, 15, 15, 40])
            v = 0.0 if rng.random() < 0.05 else v + rng.randrange(20)
            out.append((t, v))
        series[label] = out
    rows = [(k, at(t), v) for k, s in series.items() for t, v in s] + [("a", None, 1.0), ("a", at(7), None), ("b", at(series["b"][3][0]), -1.0)]
    df = spark.createDataFrame(rows, "label string, timestamp timestamp_ntz, value double")
    got = {(r["label"], r["at"]): r["increase"] for r in M.counter_increase(df, span, step, ["label"]).collect()}
    rates = {(r["label"], r["at"]): r["rate"] for r in M.counter_increase(df, span, step, ["label"], per_second=True).collect()}
    want = {(k, at(stop)): x for k, s in series.items() for stop in range(step, 5000, step) if (x := slow_increase(s, stop, span)) is not None}
    assert set(got) == set(want) == set(rates) and all(got[k] == pytest.approx(want[k]) and rates[k] == pytest.approx(want[k] / span) for k in want)


def test_a_steady_counter_rises_by_its_rate(spark):
    df = spark.range(1000).select((F.col("id") * 15).alias("s"), (F.col("id") * 30.0).alias("value")).select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "value")
    rates = [r["rate"] for r in M.counter_increase(df, 300, 60, [], per_second=True).where("at between timestamp_ntz'1970-01-01 01:00:00' and timestamp_ntz'1970-01-01 03:00:00'").collect()]
    assert len(rates) == 121 and all(r == pytest.approx(2.0) for r in rates)


# Merged states


def test_merged_days_equal_one_build(spark):
    rng = random.Random(8)
    rows = [("p", 1, [1, 2], float(rng.gauss(5000, 900) if i % 3 else rng.expovariate(1 / 3000) + 1e6), [["a", "b"], ["b", "a", "c"], ["a", "c"]][rng.randrange(3)], float(rng.randrange(30) * 86_400_000 + 5)) for i in range(20_000)]
    rows += [("q", 2, [3], float(i), ["a", "b"], float(i * 86_400_000)) for i in range(40)]
    e = spark.createDataFrame(rows, "prefix string, origin_as long, as_path array<long>, spread_ms double, arrival_order array<string>, last_ms double")
    states = W.wave_states(e)
    merged = {r["prefix"]: r for r in W.merged_baseline(states, 30).collect()}
    whole = {r["prefix"]: r for r in W.build_baseline(e, 30).collect()}
    assert set(merged) == {"p", "q"}
    for k, m in merged.items():
        w = whole[k]
        assert all(m[c] == w[c] for c in ("sample_count", "min_spread_ms", "max_spread_ms", "expected_order", "data_cutoff_ms")) and m["std_dev"] == pytest.approx(w["std_dev"], rel=1e-9)
    values = sorted(r[3] for r in rows if r[0] == "p")
    for level in (0.5, 0.95, 0.99):
        share = sum(v <= merged["p"][f"p{round(level * 100)}_spread_ms"] for v in values) / len(values)
        assert abs(share - level) < 0.005
    assert W.merged_baseline(states.where("false")).count() == 0


def test_a_day_that_is_stored_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "states")
    day = lambda d, n: W.wave_states(spark.createDataFrame([("p", 1, [1], float(i), ["a"], float(d * 86_400_000)) for i in range(n)], "prefix string, origin_as long, as_path array<long>, spread_ms double, arrival_order array<string>, last_ms double"))
    for d, n in ((0, 5), (1, 7), (1, 9)):
        W.save_states(day(d, n), path)
    assert W.merged_moments(W.load_states(spark, path), ["prefix"]).first()["n"] == 14
    assert W.merged_moments(W.load_states(spark, path, "1970-01-02"), ["prefix"]).first()["n"] == 9
    assert W.merged_moments(W.load_states(spark, path, until="1970-01-01"), ["prefix"]).first()["n"] == 5


# Stored activity


def test_days_of_ranges_are_exact(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 90))) for _ in range(600)]
    path = str(tmp_path / "bits")
    A.save_days(A.day_bits(spark.createDataFrame(rows, "origin_as long, timestamp timestamp_ntz")), path)
    for since, until in (("2024-01-01", "2024-03-31"), ("2024-01-31", "2024-02-01"), ("2024-02-10", "2024-02-10"), ("2024-01-15", "2024-03-02")):
        got = {r["origin_as"]: r["days"] for r in A.days_between(A.load_days(spark, path, since[:7], until[:7], "month"), since, until).collect()}
        want = {}
        for k, t in rows:
            if since <= t.strftime("%Y-%m-%d") <= until:
                want.setdefault(k, set()).add(t.date())
        assert got == {k: len(v) for k, v in want.items()}


def test_sketches_are_within_their_error(spark):
    e = spark.range(200_000).select(F.lit("k").alias("origin_as"), F.timestamp_seconds(F.col("id") * 20).cast("timestamp_ntz").alias("timestamp"), (F.col("id") % 50_000).alias("prefix"))
    r = A.united(A.daily(e, "origin_as", "prefix"), "origin_as").first()
    assert r["events"] == 200_000 and abs(r["distinct"] - 50_000) < 50_000 * 0.05


# Removal


def test_expired_folders_are_gone_and_kept_ones_untouched(spark, tmp_path):
    path = str(tmp_path / "events")
    e = spark.range(240).select("id", (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("timestamp"))
    e.withColumn("day", A.day_of()).write.partitionBy("day").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "events").rglob("*.parquet")}
    gone = E.purge(spark, path, datetime(2024, 1, 11, 12), 5, "day")
    assert gone == [f"day=2024-01-0{i}" for i in range(1, 6)] and not (tmp_path / "events" / "day=2024-01-05").exists()
    left = spark.read.parquet(path)
    assert left.count() == 240 - 132 and left.agg(F.min("id")).first()[0] == 132
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items() if p.parent.name > "day=2024-01-06")
    assert E.purge(spark, path, datetime(2024, 1, 11, 12), 5, "day") == []
    assert storage.drop_partitions(spark, str(tmp_path / "none"), "day", "x") == []


def test_old_snapshots_are_deleted(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    for day in ("2024-01-01", "2024-01-09", "2024-01-10"):
        B.save_snapshot(spark.createDataFrame([("p", 1.0)], "prefix string, ema double"), path, day)
    assert B.remove_snapshots(spark, path, "2024-01-16") == ["snapshot_date=2024-01-01"]
    assert B.newest_snapshot(B.load_snapshots(spark, path)).first()["snapshot_date"] == "2024-01-10"


# Streams


def turns(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


EVENT = "event_id long, timestamp timestamp_ntz, event_type string, prefix string, origin_as long"


def test_known_origins_outlive_a_restart_and_expire(spark, tmp_path):
    T.use_rocksdb(spark)
    history = spark.createDataFrame([(0, at(0), "announce", "p", 1), (1, at(50), "announce", "p", 2), (2, at(60), "withdraw", "p", 9)], EVENT)
    seen = []
    run = lambda s: T.run_batches(T.known_origins(s, history, 3600), lambda b, n: seen.extend((r["event_id"], r["known"], r["details"]) for r in b.orderBy("event_id").collect()), str(tmp_path / "checkpoint"))
    run(turns(spark, tmp_path, [[(10, at(100), "announce", "p", 1), (11, at(110), "announce", "p", 3), (12, at(120), "withdraw", "p", 4), (13, at(130), "announce", "q", 1)]], EVENT))
    assert seen == [(11, [1, 2, 3], "AS3 announced p but known originators are: [1, 2, 3]"), (13, [1], "AS1 announced q but known originators are: [1]")]
    seen.clear()
    run(turns(spark, tmp_path, [[(20, at(3640), "announce", "p", 2), (21, at(3650), "announce", "p", 3)], [(22, at(9000), "announce", "p", 1)], [(23, at(9001), "announce", "p", 1), (24, at(9002), "announce", "p", None)]], EVENT))
    assert [(i, k) for i, k, _ in seen] == [(22, [1])]


def test_conditions_are_pending_firing_and_resolved(spark, tmp_path):
    T.use_rocksdb(spark)
    minutes = [0] * 5 + [1] * 5 + [2] * 5 + [3] * 1 + [4] * 5 + [20] * 5 + [21] * 5 + [40]
    batches = [[(i, at(60 * m + 1), "a", "p", 1) for i, m in enumerate(minutes) if lo <= m < hi] for lo, hi in ((0, 2), (2, 5), (5, 30), (30, 50))]
    s = turns(spark, tmp_path, batches, EVENT)
    T.run_to_folder(T.held_conditions(s, F.col("n") >= 5, 60, 2, ["event_type"], 4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r["state"], r["since"], r["until"], r["periods"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([
        ("pending", at(0), at(0), 1), ("firing", at(0), at(60), 2), ("resolved", at(0), at(120), 3), ("pending", at(240), at(240), 1),
        ("silent", at(300), at(540), 4), ("pending", at(1200), at(1200), 1), ("firing", at(1200), at(1260), 2), ("resolved", at(1200), at(1260), 2), ("silent", at(1320), at(1560), 4),
    ])


def test_buckets_in_a_stream_equal_the_batch(spark, tmp_path):
    from routesift.operators import logs as L

    T.use_rocksdb(spark)
    rng, t, rows = random.Random(4), 0.0, []
    for i in range(400):
        t += rng.choice((0, 0.1, 0.5, 1.0, 30))
        rows.append((i, rng.choice(["t", "u"]), at(t)))
    schema = "id long, tenant_id string, timestamp timestamp_ntz"
    s = turns(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], schema)
    T.run_to_folder(T.token_bucket(s, 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["id"]: r["conforming"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"]: r["conforming"] for r in L.gcra_limit(spark.createDataFrame(rows, schema), 2).collect()} and len(set(got.values())) == 2
