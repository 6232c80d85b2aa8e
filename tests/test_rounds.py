"""Timers of alerts, validation by intervals, rules by steps, storage that cleans up, against plain loops."""

import ipaddress
import os
import random
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from routesift.functions import scalars as S
from routesift.operators import alerts as A
from routesift.operators import collectors as C
from routesift.operators import joins as J
from routesift.operators import logs as L
from routesift.operators import rpki as R
from routesift.operators import storage
from routesift.operators import waves as W
from routesift.streaming import operators as T

T0 = datetime(2024, 1, 1)
ALERT = "id string, alert_type string, prefix string, origin_as long, confidence double, fired_at timestamp_ntz, resolved_at timestamp_ntz"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def turns(spark, folder, batches, schema):
    """A stream of one file for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_alerts_escalate_once_when_their_time_comes(spark, tmp_path):
    T.use_rocksdb(spark)
    fired = lambda i, t, c=0.6, kind="hijack": (i, kind, f"10.0.0.{i}/32", 1, c, at(t), None)
    ended = lambda i, t: (i, None, None, None, None, None, at(t))
    batches = [
        [fired("1", 0), fired("2", 0), fired("3", 10, 0.95), fired("4", 20, kind="odd"), fired("5", 30, 0.85, "flap"), ended("7", 50)],
        [fired("6", 200), ended("2", 299), fired("7", 40)],
        [fired("8", 450), ended("5", 331), ended("6", 499)],
        [fired("9", 900), ended("1", 900)],
        [fired("10", 1500)],
    ]
    s = turns(spark, tmp_path, batches, ALERT)
    due = T.escalations(s.where("fired_at is not null"), s.where("resolved_at is not null").select("id", "resolved_at"), delay="10 seconds")
    seen = []
    T.run_batches(due, lambda batch, n: seen.extend((n, r["id"], round(r["confidence"], 2), r["detected_at"], r["escalated_at"]) for r in batch.collect()), str(tmp_path / "checkpoint"))
    by_id = {i: (c, a, e) for _, i, c, a, e in seen}
    assert len(seen) == len(by_id)
    assert by_id == {"1": (0.75, at(0), at(300)), "5": (0.95, at(30), at(330)), "8": (0.75, at(450), at(750)), "9": (0.75, at(900), at(1200))}
    first = next(n for n, i, *_ in seen if i == "1")
    assert first >= 2  # two batches after it came
    flat = [r for b in batches for r in b]
    alerts, over = spark.createDataFrame([r for r in flat if r[5]], ALERT), spark.createDataFrame([r for r in flat if r[6]], ALERT).select("id", "resolved_at")
    batch = {r["id"]: (round(r["confidence"], 2), r["detected_at"], r["escalated_at"]) for r in A.escalations(alerts, over).collect() if r["escalated_at"] <= at(1490)}
    assert batch == by_id


def test_timers_survive_a_restart(spark, tmp_path):
    T.use_rocksdb(spark)
    schema, seen = ALERT, []
    run = lambda s: T.run_batches(T.escalations(s.where("fired_at is not null"), s.where("resolved_at is not null").select("id", "resolved_at"), delay="1 second"), lambda b, n: seen.extend(r["id"] for r in b.collect()), str(tmp_path / "checkpoint"))
    run(turns(spark, tmp_path, [[("a", "hijack", "p", 1, 0.6, at(0), None), ("b", "hijack", "q", 1, 0.6, at(0), None)]], schema))
    assert seen == []
    run(turns(spark, tmp_path, [[("b", None, None, None, None, None, at(100)), ("c", "hijack", "p", 1, 0.6, at(400), None)]], schema))
    assert seen == ["a"]


def test_silenced_escalations_are_held_back(spark):
    due = A.escalations(spark.createDataFrame([("a", "hijack", "p", 1, 0.6, at(0), None), ("b", "hijack", "q", 1, 0.6, at(0), None)], ALERT), spark.createDataFrame([], "id string, resolved_at timestamp_ntz"))
    silence = spark.createDataFrame([("s", at(200), at(400), True, "p")], "id string, silenced_at timestamp_ntz, expires_at timestamp_ntz, active boolean, prefix string")
    silence = silence.withColumn("fingerprint", S.alert_fingerprint(F.lit("hijack"), F.col("prefix"), F.lit(1))).drop("prefix")
    out = A.reroute(due, silence).collect()
    assert [(r["id"], r["level"]) for r in out] == [("b", "critical")]


# RPKI


def slow_status(prefix, origin, vrps, mode):
    try:
        net = ipaddress.ip_network(prefix, strict=False)
    except ValueError:
        return "NotFound"
    over = [(v, ipaddress.ip_network(v[0], strict=False)) for v in vrps if v[2] is not None]
    over = sorted(((-n.prefixlen, v[3], v) for v, n in over if n.version == net.version and net.subnet_of(n)), key=lambda x: x[:2])
    if origin is None or not over:
        return "NotFound"
    own = [v for _, _, v in over if v[2] == origin]
    good = [net.prefixlen <= v[1] for v in own]
    return "Valid" if own and (good[0] if mode == "first" else any(good)) else "InvalidLength" if own else "InvalidAsn"


@pytest.mark.parametrize("mode", ["first", "any"])
@pytest.mark.parametrize("few", [True, False])
def test_validation_equals_brute_force(spark, monkeypatch, mode, few):
    if not few:
        monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    rng = random.Random(3)

    def network(longest4, longest6):
        if rng.random() < 0.6:
            return f"{rng.choice([10, 11])}.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.randrange(longest4 + 1)}"
        tail = "::ffff:10.0.0.%d" % rng.randrange(256) if rng.random() < 0.3 else f"2001:db8:{rng.randrange(3):x}::{rng.randrange(65536):x}"
        return f"{tail}/{rng.randrange(longest6 + 1)}"

    vrps = [(network(28, 128), rng.randrange(8, 129), rng.randrange(1, 5), i) for i in range(400)] + [("10.0.0.0/8", 24, 1, -i) for i in range(3)] + [("bad", 8, 1, 0), ("10.0.0.0/8", 24, None, 0), ("10.0.0.0/33", 24, 1, 0)]
    asked = [(network(32, 128), rng.randrange(1, 7)) for _ in range(600)] + [("10.0.0.1/32", rng.randrange(1, 4)) for _ in range(200)] + [("bad", 1), (None, 1), ("10.0.0.0/8", None), ("10.0.0.0/8", 4200000001), ("01.2.3.4/8", 1), ("0.0.0.0/0", 1)]
    events = spark.createDataFrame([(i, p, o, "x") for i, (p, o) in enumerate(asked)], "event_id long, prefix string, origin_as long, part string").repartition(3)
    table = spark.createDataFrame(vrps, "prefix string, max_length int, asn long, ord long").repartition(4)
    got = {r["event_id"]: r["rpki"] for r in R.rpki_validate(events, table, mode).collect()}
    valid = [v for v in vrps if R.span(v[0])]
    assert got == {i: slow_status(p, o, valid, mode) if R.span(p) else "NotFound" for i, (p, o) in enumerate(asked)}
    assert len(set(got.values())) == 4
    assert {r["rpki"] for r in R.rpki_validate(events, table.limit(0), mode).collect()} == {"Unavailable"}
    assert {r["rpki"] for r in R.rpki_validate(events, spark.createDataFrame([("bad", 8, 1, 0)], table.schema), mode).collect()} == {"NotFound"}


def test_one_row_of_each_pair_is_shuffled(spark):
    pairs = spark.range(5000).select(F.concat(F.lit("10.0."), F.col("id") % 200, F.lit(".0/24")).alias("prefix"), (F.col("id") % 25).alias("origin_as")).distinct()
    networks = R.vrp_networks(spark.createDataFrame([(f"10.0.0.0/{n}", 24, n, n) for n in range(8, 25)], "prefix string, max_length int, asn long, ord long"))
    assert R.validated_pairs(storage.checkpointed(pairs), networks).count() == pairs.count()
    dealt = pairs.selectExpr("prefix", "origin_as as asn", "cast(null as long) as max_length", "cast(null as long) as ord").mapInArrow(R._dealt(1, np.array([b"\x04\x0a\x00\x05", b"\x04\x0a\x00\x63"], "S26")), R.SWEPT)
    assert dealt.count() == pairs.count()


def test_dotted_ends_of_addresses(spark):
    rows = [("::ffff:10.0.0.0/104",), ("::ffff:a00:0/104",), ("64:ff9b::1.2.3.4/96",), ("::1.2.3.256/96",), ("1.2.3.4::/32",)]
    bits = [r["b"] for r in spark.createDataFrame(rows, "prefix string").select(S.prefix_bits(F.col("prefix")).alias("b")).collect()]
    assert bits[0] == bits[1] and bits[0]["bits"][80:] == "1" * 16 + "00001010" + "0" * 24
    assert bits[2] is not None and bits[3] is None and bits[4] is None


# Rules


@pytest.mark.parametrize("steps", [1000, 2])
def test_rules_by_steps_equal_a_search(spark, monkeypatch, steps):
    monkeypatch.setattr(A, "STEPS", steps)
    rng = random.Random(steps)
    rules = [(f"r{i}", rng.choice([None, "", "t0", "t1", "t2"]), rng.choice([None, 0.0, 0.2, 0.5, 0.7, 0.9, rng.random()]), f"2024-{rng.randrange(1, 9)}", "n") for i in range(120)]
    found = [(e, k, rng.choice(["t0", "t1", "t3", None, ""]), rng.random() * 0.9) for e in range(150) for k in ("PossibleHijack", "PrefixFlapping")]
    a = spark.createDataFrame(found, "event_id long, anomaly_type string, tenant_id string, confidence double")
    got = {(r["event_id"], r["anomaly_type"]): r["rule_id"] for r in A.rule_match(a, spark.createDataFrame(rules, "id string, tenant_id string, threshold double, updated_at string, name string")).collect()}
    expected = {}
    for event, kind, tenant, confidence in found:
        fits = [(u, i) for i, t, least, u, _ in rules if (t or "") in ("", tenant or "") and least is not None and confidence >= least]
        if fits:
            expected[event, kind] = max(fits)[1]
    assert got == expected and len(got) > 200


def test_no_rules_match_nothing(spark):
    a = spark.createDataFrame([(1, "k", "t", 0.9)], "event_id long, anomaly_type string, tenant_id string, confidence double")
    assert A.rule_match(a, spark.createDataFrame([], "id string, tenant_id string, threshold double, updated_at string")).collect() == []


def test_false_positives_are_resolved_alerts(spark):
    a = spark.createDataFrame([("PossibleHijack", "p", 1, 0.85, at(0), "t", "Valid"), ("PossibleHijack", "q", 1, 0.85, at(0), "t", "Valid")], "anomaly_type string, prefix string, origin_as long, confidence double, detected_at timestamp_ntz, tenant_id string, rpki string")
    history = spark.createDataFrame([("hijack", "p", 1, "resolved", at(0)), ("hijack", "q", 1, "fired", at(0))], "alert_type string, prefix string, origin_as long, status string, fired_at timestamp_ntz")
    assert [(r["n"], r["false_positives"]) for r in A.outcome_counts(a, history).collect()] == [(2, 1)]
    assert [(r["n"], r["false_positives"]) for r in A.outcome_counts(a).collect()] == [(2, 0)]


# Smaller corrections


def test_large_as_numbers_have_names(spark):
    row = spark.range(1).select(S.as_name(F.lit(4200000001)).alias("a"), S.path_display(F.array(F.lit(4200000001), F.lit(15169)), F.lit(1)).alias("p")).first()
    assert row["a"] == "AS4200000001" and row["p"] == "4200000001 → Google"


def test_escapes_of_either_case(spark):
    text = spark.createDataFrame([("10.0.0.0%2f24",), ("2001%3adb8%3A%3a%2F32",), ("%2g",)], "t string")
    assert [tuple(r) for r in text.select(S.prefix_param(F.col("t")), S.prefix_param_valid(S.prefix_param(F.col("t")))).collect()] == [("10.0.0.0/24", True), ("2001:db8::/32", True), ("%2g", False)]


def test_a_registry_too_large_is_refused(spark):
    many = spark.range(1001).selectExpr("cast(id as string) as collector", "'c' as city", "'X' as country", "0.0D as lat", "0.0D as lon", "'i' as ixp", "'EU' as region")
    seen = spark.createDataFrame([("7",)], "collector string")
    with pytest.raises(ValueError, match="1000"):
        C.lookup(seen, many)
    assert C.lookup(seen, many.where("collector <> '9'")).first()["is_known"]


def test_far_pairs_of_many_collectors(spark, monkeypatch):
    pairs = C.pair_distances(C.registry(spark))
    e = spark.createDataFrame([(1, ["rrc00", "rrc11", "rrc00"]), (2, ["rrc00", "nowhere"]), (3, []), (4, ["rrc23", "rrc17", "rrc03"]), (5, ["rrc11", "rrc00"])], "k long, arrival_order array<string>")
    few = {r["k"]: r["km"] for r in W.far_pairs(e, pairs, ["k"]).collect()}
    monkeypatch.setattr(W, "MAX_PAIRS", 10)
    many = {r["k"]: r["km"] for r in W.far_pairs(e, pairs, ["k"]).collect()}
    assert few == many and few[1] == few[5] and few[2] is None and few[3] is None and few[4] > 10_000


def test_salts_follow_the_row(spark):
    table = spark.createDataFrame([(i, i * 10) for i in range(50)], "k int, v int")
    big = spark.range(5000).selectExpr("id", "cast(id % 60 as int) as k", "map('a', 1) as m")
    out = J.lookup_join(big, table, ["k"], max_rows=10)
    assert out.count() == 5000 and out.where("v = k * 10").count() == big.where("k < 50").count()
    assert J.salting(big, ["k"]) == ["id"] and J.salting(big.select("k"), ["k"]) == ["k"]


def test_the_report_ends_with_the_tenants(spark):
    cost = spark.createDataFrame([("a", 1, 1048576, 0), ("b", 2, 0, 3)], "tenant_id string, requests long, bytes long, pii_hits long")
    lines = {r["tenant_id"]: r["line"] for r in L.cost_report(cost).collect()}
    assert lines[None] == "Total tenants: 2" and lines["a"] == "Tenant: a Requests: 1 Bytes: 1.0 MB PII Hits: 0"


# Storage


def test_tables_are_reloaded_by_age(spark):
    now, fail = [0.0], [False]

    def load():
        if fail[0]:
            raise OSError
        return spark.createDataFrame([(now[0],)], "t double")

    table = T.Reloaded(load, 600, lambda: now[0])
    read = lambda: table.get().first()["t"]
    assert read() == 0
    now[0] = 599
    assert read() == 0 and table.loads == 1
    now[0], fail[0] = 600, True
    assert read() == 0
    fail[0] = False
    assert read() == 0  # tried again after the same time
    for t in (1200.0, 1800.0, 2400.0):
        now[0] = t
        assert read() == t
    assert len(table.folders) == 2 and table.loads == 4


def test_scratch_leaves_nothing(spark):
    with storage.scratch(spark) as folder:
        kept = storage.checkpointed(spark.range(10)).count()
        assert kept == 10 and storage.names_in(spark, folder)
    assert storage.names_in(spark, folder) == []


def test_snapshots_are_compared_by_their_own_folders(spark, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    each = T.roa_diff_batches(store, out)
    rows = lambda *r: spark.createDataFrame(list(r), "prefix string, snapshot int")
    each(rows(("a", 0), ("b", 0)), 0)
    each(rows(("b", 1), ("c", 1), ("c", 2)), 1)
    shutil.rmtree(f"{store}/snapshot=0")
    os.makedirs(f"{store}/snapshot=0")
    each(rows(("d", 2)), 2)  # needs snapshots 1 and 2 alone
    got = {(r["snapshot"], r["prefix"], r["action"]) for r in spark.read.parquet(out).where("snapshot > 0").collect()}
    assert got == {(1, "a", "removed"), (1, "c", "added"), (2, "b", "removed"), (2, "d", "added")}
