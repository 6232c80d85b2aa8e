"""What larger tables showed: state calls, addresses beyond 255, samples at one time, exact counts and joins that don't multiply rows."""

from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from routesift.functions import scalars as S
from routesift.operators import activity as A
from routesift.operators import joins as J
from routesift.operators import metrics as M
from routesift.operators import rpki as R
from routesift.operators import waves as W
from routesift.plans import fixtures as X
from routesift.plans import registry, streams
from routesift.streaming import processors as P

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that read the addresses of derived prefixes.
BEYOND = ["vrp_read", "anomaly_counts", "stream_rpki", "hijack_rpki_first", "hijack_enriched", "covering_keys", "rpki_validate", "prefix_bits"]


class Value:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Handle:
    """A processor's handle; any other kind of state than values is refused."""

    def __init__(self):
        self.states, self.timers = [], []

    def getValueState(self, name, schema):
        self.states.append(Value())
        return self.states[-1]

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def calls(self):
        return sum(s.calls for s in self.states) + len(self.timers)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def test_propagation_reads_and_stores_a_group_once_a_batch():
    processor, handle = started(P.Propagation(10, 3))
    rows = [SimpleNamespace(arrival_ms=g * 20_000 + i, collector=f"c{i % 5}") for g in range(50) for i in range(20)]
    out = list(processor.handleInputRows(("p", 1, "1 2"), iter(rows[::-1]), None))
    assert [r["first_ms"] for r in out] == [g * 20_000 for g in range(49)] and out[0]["arrival_order"] == [f"c{i}" for i in range(5)]
    assert handle.calls() == 3
    late = [SimpleNamespace(arrival_ms=49 * 20_000 + 500, collector="c9")]
    assert list(processor.handleInputRows(("p", 1, "1 2"), iter(late), None)) == []
    last = list(processor.handleExpiredTimer(("p", 1, "1 2"), None, SimpleNamespace(getExpiryTimeInMs=lambda: 49 * 20_000 + 10_000)))
    assert [(r["first_ms"], r["spread_ms"], len(r["arrival_order"])) for r in last] == [(49 * 20_000, 500, 6)] and handle.states[0].value is None


# Numbers beyond 255 in derived prefixes


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A folder whose events have users beyond 65,536, and DuckDB over it."""
    folder = str(tmp_path_factory.mktemp("wide"))
    con = duckdb.connect()
    con.sql(f"copy (select * replace (user_id * 6101 as user_id) from '{SF}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    assert con.sql("select max(user_id) > 70000 from events").fetchall()[0][0]
    return folder, con


@pytest.mark.parametrize("name", BEYOND)
def test_prefixes_beyond_the_address_space_are_read_as_in_sql(spark, wide, name):
    same_rows(QUERIES[name](spark, wide[0]), wide[1], SQL[name])


def test_invalid_routes_of_many_pairs_equal_sql(spark, tmp_path, monkeypatch):
    """As on large tables: users that share addresses, ranges cut by a sample, joins by salt."""
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(J.lookup_join, "__defaults__", (2, False))
    con = duckdb.connect()
    con.sql(f"copy (select event_id + i * 100000 as event_id, user_id + i * 100000 as user_id, * exclude (event_id, user_id) from '{SF}/events.parquet', range(4) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    same_rows(QUERIES["hijack_rpki_first"](spark, str(tmp_path)), con, SQL["hijack_rpki_first"])


def test_the_operator_takes_no_number_beyond_255(spark):
    df = spark.createDataFrame([("10.1.300.0/24",), ("10.1.255.0/24",), ("10.1.2109.0/20",), ("bad",)], "prefix string")
    rows = {r["prefix"]: (r["a"], r["b"]) for r in df.select("prefix", X.address(F.col("prefix")).alias("a"), S.prefix_bits(F.col("prefix")).alias("b")).collect()}
    assert {k: v[0] for k, v in rows.items()} == {"10.1.300.0/24": "10.1.150.0/24", "10.1.255.0/24": "10.1.255.0/24", "10.1.2109.0/20": "10.1.131.0/20", "bad": "bad"}
    assert rows["10.1.300.0/24"][1] is None and rows["10.1.255.0/24"][1] is not None


# Samples at one time


def test_every_sample_at_one_time_counts(spark):
    rows = [(0, 1.0), (0, 2.0), (30, 3.0), (30, 4.0), (30, 5.0), (600, 6.0), (600, 7.0)]
    df = spark.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "value")
    span, step = 100, 50
    got = {r["s"]: r["increase"] for r in M.counter_increase(df, span, step, [], ties="all").select(F.unix_seconds(F.col("at").cast("timestamp")).alias("s"), "increase").collect()}
    # 50: four gaps in 30 s, so 100 s before and 20 s after are beyond 1.1 gaps; the begin is held at zero
    assert got[50] == pytest.approx(4 * (30 + min(7.5 / 2, 30 * 1 / 4) + 7.5 / 2) / 30)
    assert set(got) == {0, 50, 100, 600, 650} and all(got[k] != got[k] for k in (0, 100, 600, 650))


# Distinct values of stored days


def test_stored_values_are_counted_exactly(spark, tmp_path):
    e = spark.range(60_000).selectExpr("1L as k", "cast(id % 20000 as string) as v", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 3 as int)) as timestamp")
    e = e.unionByName(spark.range(1).selectExpr("1L as k", "cast(null as string) as v", "timestamp_ntz'2024-01-02 00:00:00' as timestamp"))
    A.save_days(A.daily(e, "k", "v", exact=True), str(tmp_path / "days"))
    assert [tuple(r) for r in A.top(A.load_days(spark, str(tmp_path / "days"), "2024-01-01", "2024-01-03"), "k", "n").collect()] == [(1, 60_001, 20_000)]


# Joins of one row per key


def generated(df):
    """How many rows are multiplied: generators of the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate")


def test_merging_states_repeats_no_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(J.sized, "__defaults__", (2, False))
    monkeypatch.setattr(J.lookup_join, "__defaults__", (2, False))
    states = spark.range(60).selectExpr("cast(id % 20 as string) as prefix", "2L as n", "cast(id as double) as mean", "0.5D as m2", "0D as min", "9D as max", "1D as cutoff_ms")
    out = W.merged_moments(states, ["prefix"])
    assert generated(out) == 0 and {(r["prefix"], r["n"], r["mean"]) for r in out.collect()} == {(str(i), 6, i + 20.0) for i in range(20)}


def test_a_baseline_lookup_repeats_no_rows(spark, monkeypatch):
    monkeypatch.setattr(J.sized, "__defaults__", (2, False))
    monkeypatch.setattr(J.lookup_join, "__defaults__", (2, False))
    path = "array(1L, 2L) as as_path"
    baseline = spark.range(20).selectExpr("cast(id as string) as prefix", "id as origin_as", path, "id as sample_count", "1D as p50_spread_ms", "2D as p99_spread_ms", "0D as std_dev", "array('a') as expected_order")
    events = spark.range(30).selectExpr("cast(id as string) as prefix", "id as origin_as", path, "id as slot")
    out = W.lookup_baseline(events, baseline)
    assert generated(out) == 0 and {r["slot"]: r["sample_count"] for r in out.collect()} == {i: i if i < 20 else None for i in range(30)}


# Batches of a replay


def test_a_turn_has_a_bounded_number_of_rows(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as timestamp")
    streams.in_turns(spark, str(tmp_path), rows, "timestamp", 4, 100)
    files = [sorted(r[0] for r in spark.read.parquet(str(f)).select("id").collect()) for f in sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)]
    assert len(files) == 10 and [x for f in files for x in f] == list(range(1000)) and max(map(len, files)) <= 101


def test_a_bucket_takes_frames():
    processor, handle = started(P.TokenBucket(1.0, 1.0))
    frames = [pd.DataFrame({"at_us": [3_000_000, 0, 0], "event_id": [4, 1, 0]}), pd.DataFrame({"at_us": [0, 100_000], "event_id": [2, 3]})]
    out = pd.concat(processor.handleInputRows(("t",), iter(frames), None))
    assert dict(zip(out["event_id"], out["conforming"], strict=True)) == {0: True, 1: True, 2: False, 3: False, 4: True} and handle.calls() == 3


def test_an_escalation_reads_and_stores_an_alert_once():
    processor, handle = started(P.Escalation(300, 0.9, 0.15, 0.95))
    fired = SimpleNamespace(kind="fired", timestamp="2024-01-01", alert_type="flap", prefix="p", origin_as=1, confidence=0.75)
    ended = SimpleNamespace(kind="resolved", timestamp="2024-01-01 00:05:00", confidence=None)
    assert list(processor.handleInputRows(("a",), iter([fired, ended]), None)) == [] and len(handle.timers) == 2
    assert handle.calls() == 4
    due = handle.timers[0] if handle.timers[0] < handle.timers[1] else handle.timers[1]
    at = lambda ms: list(processor.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    assert [(r["id"], r["confidence"]) for r in at(due)] == [("a", 0.9)] and handle.states[0].value is not None
    assert at(due + 300_000) == [] and handle.states[0].value is None and handle.calls() == 8
