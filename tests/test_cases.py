"""Literal cases of detectors, validation, baselines and alerts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from routesift.functions import scalars as S
from routesift.operators import alerts as A
from routesift.operators import baselines as B
from routesift.operators import collectors as C
from routesift.operators import detectors as D
from routesift.operators import events as E
from routesift.operators import folds, storage
from routesift.operators import logs as L
from routesift.operators import rpki as R
from routesift.operators import waves as W
from routesift.sources import readers
from routesift.streaming import operators as T

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (id, seconds, type, prefix, origin)."""
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=s), k, p, o, [1, o]) for i, s, k, p, o in rows], "event_id long, timestamp timestamp_ntz, event_type string, prefix string, origin_as long, as_path array<long>")
    return df.withColumn("tenant_id", F.lit("t"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "redacted", "hits"),
    [
        ("user@example.com", "[EMAIL]", 1), ("from 192.168.1.1", "from [IPv4]", 1), ("SSN 123-45-6789", "SSN [SSN]", 1), ("call 555-867-5309", "call [PHONE]", 1),
        ("4111-1111-1111-1111", "[CREDIT_CARD]", 1), ("IBAN DE89370400440532013000", "IBAN [IBAN]", 1), ("nothing here", "nothing here", 0), ("", "", 0),
        ("a@b.co c@d.co e@f.co", "[EMAIL] [EMAIL] [EMAIL]", 3), ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "[IPv6]", 1),
    ],
)
def test_redaction(spark, text, redacted, hits):
    assert one(spark, S.pii_redact(F.lit(text))) == redacted
    assert one(spark, S.pii_hits(F.lit(text))[0]) == hits


def test_redaction_is_idempotent(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(S.pii_redact(F.col("text")).alias("a"))
    assert d.where(S.pii_redact(F.col("a")) != F.col("a")).count() == 0


def test_message_key(spark):
    assert one(spark, S.message_key(F.lit("  Hello "))) == one(spark, S.message_key(F.lit("hello")))
    assert len(one(spark, S.message_key(F.lit("x")))) == 64


@pytest.mark.parametrize(("text", "asn"), [("AS64500", 64500), (" as1 ", 1), ("4294967295", 4294967295), ("4294967296", None), ("ASX", None), ("", None), ("AS-1", None)])
def test_parse_asn(spark, text, asn):
    assert one(spark, S.parse_asn(F.lit(text))) == asn


def test_path_hash_wraps(spark):
    path = [4294967295] * 20
    want = 0
    for a in path:
        want = (want * 31 + a) % 2**64
    assert int(one(spark, S.path_hash(F.array(*map(F.lit, path))))) == want
    assert int(one(spark, S.path_hash(F.array().cast("array<bigint>")))) == 0


@pytest.mark.parametrize(
    ("prefix", "family", "ones"),
    [("10.0.0.0/8", 4, 2), ("2001:db8::/32", 6, 9), ("::1/128", 6, 1), ("::/0", 6, 0), ("1:2:3:4:5:6:7:8/64", 6, 13), ("1::2::3/64", None, 0), ("10.0.0.256/8", None, 0), ("10.0.0.0/33", None, 0), ("2001:db8/32", None, 0), ("10.0.0.0", None, 0), ("x/8", None, 0)],
)
def test_prefix_bits(spark, prefix, family, ones):
    b = one(spark, S.prefix_bits(F.lit(prefix)))
    assert (b is None) == (family is None)
    if b:
        assert b["family"] == family and len(b["bits"]) == (32 if family == 4 else 128) and b["bits"].count("1") == ones


VRPS = [("10.0.0.0/8", 16, 1), ("10.1.0.0/16", 16, 1), ("10.1.0.0/16", 24, 2), ("192.0.2.0/24", 24, 3), ("2001:db8::/32", 48, 4), ("bad", 8, 5)]


@pytest.mark.parametrize(
    ("prefix", "asn", "first", "any_"),
    [
        ("10.0.0.0/8", 1, "Valid", "Valid"), ("10.0.0.0/16", 1, "Valid", "Valid"), ("10.2.0.0/24", 1, "InvalidLength", "InvalidLength"), ("10.0.0.0/8", 9, "InvalidAsn", "InvalidAsn"),
        ("10.1.0.0/24", 2, "Valid", "Valid"), ("172.16.0.0/12", 1, "NotFound", "NotFound"), ("nonsense", 1, "NotFound", "NotFound"), ("2001:db8:1::/48", 4, "Valid", "Valid"),
        ("2001:db8::/64", 4, "InvalidLength", "InvalidLength"), ("10.1.2.3/24", 2, "Valid", "Valid"),
    ],
)
def test_rpki(spark, prefix, asn, first, any_):
    v = spark.createDataFrame([(*r, i) for i, r in enumerate(VRPS)], "prefix string, max_length int, asn long, ord long")
    e = events(spark, [(1, 0, "announce", prefix, asn)])
    assert R.rpki_validate(e, v).first()["rpki"] == first
    assert R.rpki_validate(e, v, mode="any").first()["rpki"] == any_


def test_rpki_modes_differ_and_empty_table(spark):
    v = spark.createDataFrame([("10.1.0.0/16", 16, 1, 0), ("10.0.0.0/8", 24, 1, 1)], "prefix string, max_length int, asn long, ord long")
    e = events(spark, [(1, 0, "announce", "10.1.1.0/24", 1)])
    assert R.rpki_validate(e, v).first()["rpki"] == "InvalidLength"
    assert R.rpki_validate(e, v, mode="any").first()["rpki"] == "Valid"
    assert R.rpki_validate(e, v.limit(0)).first()["rpki"] == "Unavailable"


def test_hijack_matrix(spark):
    rows, want = [], {}
    i = 0
    for rpki in ("Valid", "InvalidAsn", "InvalidLength", "NotFound", "Unavailable"):
        for irr in ("Inconsistent", "Consistent"):
            for known in (False, True):
                p = f"{rpki}{irr}{known}"
                if known:
                    rows.append((i, i, "announce", p, 7, "Valid", "Consistent"))
                    i += 1
                rows.append((i, i, "announce", p, 7, rpki, irr))
                bad, odd = rpki.startswith("Invalid"), irr == "Inconsistent"
                want[i] = (0.75 if odd else 0.6) if known and bad else None if known else 0.3 if rpki == "Valid" else (0.99 if odd else 0.97) if bad else 0.9 if odd else 0.85
                i += 1
    rows.append((i, i, "withdraw", "w", 7, "InvalidAsn", "Consistent"))
    df = spark.createDataFrame([(a, T0 + timedelta(seconds=b), c, d, e, f, g) for a, b, c, d, e, f, g in rows], "event_id long, timestamp timestamp_ntz, event_type string, prefix string, origin_as long, rpki string, irr string")
    got = {r["event_id"]: r["confidence"] for r in D.hijack_enriched(df).collect()}
    assert {k: got.get(k) for k in want} == want and i not in got


def test_first_origin_fires_and_history_silences(spark):
    e = events(spark, [(1, 0, "announce", "p", 1), (2, 1, "announce", "p", 1), (3, 2, "announce", "p", 2), (4, 3, "withdraw", "p", 3)])
    assert {r["event_id"] for r in D.hijack_first_seen(e).collect()} == {1, 3}
    assert {r["event_id"] for r in D.hijack_first_seen(e, e.where("event_id = 1")).collect()} == {3}


@pytest.mark.parametrize(("n", "changes", "fires"), [(49, 48, False), (50, 49, True), (50, 5, False), (50, 6, True), (50, 0, False)])
def test_flapping(spark, n, changes, fires):
    kinds = ["announce", "withdraw"]
    rows = [(i, i, kinds[min(i, changes) % 2], "p", 1) for i in range(n)]
    assert (D.flapping(events(spark, rows)).count() > 0) == fires


def test_flapping_window_bound_is_inclusive(spark):
    e = events(spark, [(1, 0, "announce", "p", 1), (2, 300, "withdraw", "p", 1), (3, 601, "announce", "p", 1)])
    assert [r["event_id"] for r in D.flapping(e, 300, 2, 1).collect()] == [2]


def test_ema_scores(spark):
    rows = [(i, i, "announce", "p", 1) for i in range(6)]
    e = events(spark, rows)
    x = F.when(F.col("event_id") == 5, 100.0).otherwise(F.lit(3.0) + F.col("event_id") % 2)
    before = {r["event_id"]: (r["n"], r["ema"], r["var"]) for r in B.event_states(e, x).collect()}
    assert before[0][0] == 0 and before[5][0] == 5
    z = one(spark, S.ema_z_score(F.lit(100.0), F.lit(before[5][1]), F.lit(before[5][2]), F.lit(5)))
    assert z > 3
    after = {r["event_id"]: (r["n"], r["ema"], r["var"]) for r in B.event_states(e, x, state="after").collect()}[5]
    assert one(spark, S.ema_z_score(F.lit(100.0), F.lit(after[1]), F.lit(after[2]), F.lit(6))) < 3
    assert one(spark, S.ema_z_score(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(4))) is None
    with pytest.raises(ValueError, match="alpha"):
        B.ema_baseline(e, alpha=0)


@pytest.mark.parametrize(("path", "prefix", "known", "boost"), [(False, False, False, 0), (True, False, False, 0.1), (False, True, False, 0.05), (False, False, True, -0.1), (True, True, True, 0.05), (True, True, False, 0.15), (None, None, None, 0)])
def test_boost(spark, path, prefix, known, boost):
    b = lambda v: F.lit(v).cast("boolean")
    assert one(spark, B.confidence_boost(b(path), b(prefix), b(known))) == pytest.approx(boost)


def test_propagation_measures(spark):
    arrivals = [("rrc12", 0), ("rrc00", 200), ("rrc11", 700), ("rrc17", 1234), ("rrc12", 900)]
    o = spark.createDataFrame([("p", 1, [1], c, t) for c, t in arrivals], "prefix string, origin_as long, as_path array<long>, collector string, arrival_ms long")
    r = W.propagation(o).first()
    assert r["spread_ms"] == 1234 and r["arrival_order"] == ["rrc12", "rrc00", "rrc11", "rrc17"]
    assert W.propagation(o, arrival="last").first()["arrival_order"][-1] == "rrc17"
    assert W.propagation(o.limit(2)).count() == 0


def test_wave_signals(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, S.order_deviation(arr("a", "b", "c"), arr("a", "b", "c"))) == 0
    assert one(spark, S.order_deviation(arr("a", "b", "c"), arr("x", "y", "z"))) == 1
    assert one(spark, S.order_deviation(arr("a"), arr("x"))) == 0
    assert one(spark, S.gap_ratio(arr(0.0, 4.0, 9.0))) == 0.5
    assert one(spark, S.gap_ratio(arr(1.0))) == 0
    assert one(spark, S.propagation_speed(F.lit(5.0), F.lit(None).cast("double"))) == 0
    assert one(spark, S.propagation_speed(F.lit(5.0), F.lit(2000.0))) == 0.5


def test_distances(spark):
    c = {r[0]: r for r in S.COLLECTORS}
    km = lambda a, b: one(spark, S.haversine_km(*[F.lit(v) for v in (c[a][3], c[a][4], c[b][3], c[b][4])]))
    assert km("rrc00", "rrc00") == 0 and 300 < km("rrc00", "rrc12") < 420 and 5500 < km("rrc00", "rrc03") < 6500
    assert len(S.COLLECTORS) == 26 and len(S.AS_NAMES) == 17


def test_backtest_refuses_leaking_baseline(spark):
    base = spark.createDataFrame([(10.0,)], "data_cutoff_ms double")
    with pytest.raises(ValueError, match="baseline"):
        W.backtest(base, base, base, {"start_ms": 5})


def test_anchored_ttl_is_not_refreshed(spark):
    rows = [(i, "f", T0 + timedelta(minutes=m)) for i, m in enumerate((0, 20, 29, 31, 60, 61, 62))]
    a = spark.createDataFrame(rows, "event_id long, fingerprint string, detected_at timestamp_ntz")
    assert sorted(r["event_id"] for r in A.dedup_flags(a).where("is_new").collect()) == [0, 3, 5]


@pytest.mark.parametrize(("confidence", "level"), [(0.49, None), (0.5, "warning"), (0.7, "critical"), (0.9, "emergency")])
def test_levels(spark, confidence, level):
    assert one(spark, S.escalation_level(F.lit(confidence))) == level


def test_auto_escalation(spark):
    rows = [("a", "hijack", 0.6, 0), ("b", "flap", 0.85, 0), ("c", "hijack", 0.9, 0), ("d", "odd", 0.6, 0), ("e", "hijack", 0.6, 299)]
    h = spark.createDataFrame([(i, k, "p", 1, c, "fired", T0 + timedelta(seconds=s), None) for i, k, c, s in rows], "id string, alert_type string, prefix string, origin_as long, confidence double, status string, fired_at timestamp_ntz, resolved_at timestamp_ntz")
    got = {r["id"]: round(r["confidence"], 2) for r in A.auto_escalate(h, T0 + timedelta(seconds=300)).collect()}
    assert got == {"a": 0.75, "b": 0.95}


@pytest.mark.parametrize(("n", "quota"), [(7, "Allowed"), (8, "SoftWarning"), (10, "SoftWarning"), (11, "Exceeded")])
def test_quota(spark, n, quota):
    r = spark.createDataFrame([(i, "t", T0 + timedelta(milliseconds=i)) for i in range(n)], "id long, tenant_id string, timestamp timestamp_ntz")
    assert L.quota_check(r, F.lit(10.0)).orderBy(F.desc("id")).first()["quota"] == quota


def test_gcra(spark):
    r = spark.createDataFrame([(i, "t", T0 + timedelta(milliseconds=m)) for i, m in enumerate((0, 0, 0, 500, 600))], "id long, tenant_id string, timestamp timestamp_ntz")
    assert {x["id"]: x["conforming"] for x in L.gcra_limit(r, 2).collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_folds_stream_runs_between_quiet_gaps(spark):
    import random

    rng, at, rows = random.Random(5), 0.0, []
    for i in range(3000):
        at += rng.choice((0, 0.1, 0.25, 0.5, 1.0, 1.5, 1.5, 30))
        rows.append((i, None if i % 3 == 0 else "t", T0 + timedelta(seconds=at)))
    r = spark.createDataFrame(rows, "id long, tenant_id string, timestamp timestamp_ntz")
    flags = L.gcra_limit(r, 2)
    want, last = {}, {}
    dedup, seen = {}, {}
    for i, tenant, ts in rows:
        t = (ts - T0).total_seconds()
        due = max(last.get(tenant, -1e9), t)
        want[i] = due - t <= 0.5 + 1e-9
        if want[i]:
            last[tenant] = due + 0.5
        dedup[i] = t - seen.get(tenant, -1e9) >= 2
        if dedup[i]:
            seen[tenant] = t
    assert {x["id"]: x["conforming"] for x in flags.collect()} == want and len(set(want.values())) == 2
    assert {x["id"]: x["is_new"] for x in A.dedup_flags(r, "tenant_id", "timestamp", "id", 2).collect()} == dedup
    states = B.event_states(events(spark, [(0, 0, "announce", "p", 1)]))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (flags, A.dedup_flags(r, "tenant_id", "timestamp", "id", 2), states)]
    assert not [p for p in plans if "collect_list" in p]
    runs = {(x["tenant_id"], x["_run"]) for x in folds.quiet_runs(r, "tenant_id", F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6, 1.0).collect()}
    assert len(runs) > 100


def test_vrp_dump_comes_in_ranges(spark, monkeypatch):
    from conftest import SF

    from routesift.plans import sources
    from routesift.sources import readers

    ones = [(r["prefix"], r["max_length"], r["asn"], r["ord"]) for r in readers.read_vrps(sources.vrp_dump(spark, SF)).collect()]
    monkeypatch.setattr(sources, "DUMP_SPAN", 2)
    monkeypatch.setattr(sources, "DUMP_LINES", 1)
    dump = sources.vrp_dump(spark, SF)
    assert dump.count() > 3 and len(dump.inputFiles()) > 2
    assert sorted((r["prefix"], r["max_length"], r["asn"], r["ord"]) for r in readers.read_vrps(dump).collect()) == sorted(ones)
    alone = spark.createDataFrame([('{"roas":[{"prefix":"10.0.0.0/8","max_length":9,"asn":"AS1"},{"prefix":"10.0.0.0/9","maxLength":9,"asn":"2"}]}',)], "json string")
    assert [r["ord"] for r in readers.read_vrps(alone).collect()] == [0, 1]


@pytest.mark.parametrize(
    ("json", "errors"),
    [('{"level":"info","source":"s","message":"m"}', ""), ('{"level":"CRITICAL","source":"s","message":"m"}', "level"), ('{"level":"info","source":"s","message":""}', "message"), ('{"level":1,"source":"s"}', "level; message"), ("[1]", "not an object"), ("{", "not an object"), (None, "not an object"), ('{"level":"warn","source":"s","message":"m","metadata":null,"x":[1]}', ""), ('{"level":"warn","source":"s","message":"m","metadata":[1]}', "metadata")],
)
def test_validation(spark, json, errors):
    e = spark.createDataFrame([(json,)], "json string")
    assert L.validate(e).first()["errors"] == errors


def test_event_type_is_checked():
    with pytest.raises(ValueError, match="announce"):
        E.event_type_check("update")


def test_month_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    e = events(spark, [(1, 0, "announce", "p", 1), (2, 40 * 86400, "announce", "p", 1)])
    E.write_events(e, path)
    df = E.scan(spark, path, start=datetime(2024, 2, 1))
    assert [r["event_id"] for r in df.collect()] == [2]
    assert "PartitionFilters: [isnotnull(month" in df._jdf.queryExecution().toString()


def test_detector_registry(spark):
    registry = D.DetectorRegistry()
    with pytest.raises(ValueError, match="no detector"):
        registry.run(None)
    registry.register("x", D.hijack_first_seen)
    with pytest.raises(ValueError, match="already"):
        registry.register("x", D.hijack_first_seen)


@pytest.mark.parametrize("most", [200_000, 0])
def test_lookup_join_broadcast_or_salted(spark, most):
    from routesift.operators.joins import lookup_join

    big = spark.range(100).select(F.when(F.col("id") < 90, 1).when(F.col("id") < 95, 2).alias("k"))
    table = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    assert {r["v"]: r["count"] for r in lookup_join(big, table, ["k"], most).groupBy("v").count().collect()} == {"a": 90, None: 10}


def stream_of(spark, df, path):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_goes_on_from_a_snapshot(spark, tmp_path):
    rows = [(i, i, "announce", f"p{i % 3}", 1) for i in range(60)]
    e = events(spark, rows).withColumn("as_path", F.sequence(F.lit(1), (F.col("event_id") % 7 + 1).cast("int")).cast("array<bigint>"))
    B.save_snapshot(B.ema_baseline(e.where("event_id < 30")), str(tmp_path / "snaps"), "2024-01-01")
    start = B.newest_snapshot(B.load_snapshots(spark, str(tmp_path / "snaps")))
    T.use_rocksdb(spark)
    T.run_to_folder(T.ema(stream_of(spark, e.where("event_id >= 30"), str(tmp_path / "in")), baseline=start), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["event_id"]: (r["ema"], r["var"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: (r["ema"], r["var"], r["n"]) for r in B.event_states(e, state="after").where("event_id >= 30").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_replayed_batches_replace_themselves(spark, tmp_path):
    vrps = spark.createDataFrame([("10.0.0.0/8", 24, 1, 0)], "prefix string, max_length int, asn long, ord long")
    batch = events(spark, [(1, 0, "announce", "10.1.0.0/16", 1), (2, 1, "announce", "10.2.0.0/16", 2)])
    each = T.rpki_batches(lambda: vrps, str(tmp_path / "out"))
    for number in (0, 0, 1):
        each(batch, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_a_failed_reload_keeps_the_last_good_table(spark):
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 2:
            return spark.range(1).select(F.raise_error(F.lit("gone")).cast("string").alias("prefix"))
        return spark.range(3)

    table = T.Reloaded(load, 0)
    assert table.get().count() == 3 and table.get().count() == 3 and len(calls) == 2


def test_snapshots_spread_over_batches_and_replays(spark, tmp_path):
    roa = "snapshot int, prefix string, max_length int, origin_as long, trust_anchor string"
    each = T.roa_diff_batches(str(tmp_path / "store"), str(tmp_path / "out"))
    one = lambda *rows: spark.createDataFrame([(s, p, 24, 1, "RIPE") for s, p in rows], roa)
    for number, rows in ((0, one((0, "a"), (0, "b"))), (1, one((1, "b"))), (2, one((1, "c"), (2, "c"))), (1, one((1, "b")))):
        each(rows, number)
    got = sorted((r["snapshot"], r["prefix"], r["action"]) for r in spark.read.parquet(str(tmp_path / "out")).where("snapshot > 0").collect())
    assert got == [(1, "a", "removed"), (1, "c", "added"), (2, "b", "removed")]


def test_quarantine_keeps_bad_rows(spark, tmp_path):
    parse = lambda b: b.select("json", F.from_json("json", "a int, b string").alias("m")).select("json", "m.*")
    each = T.quarantine_batches(parse, ["a", "b"], str(tmp_path / "good"), str(tmp_path / "bad"))
    for number in (0, 0):
        each(spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1}',), ("{",)], "json string"), number)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert {r["json"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {'{"a":1}', "{"}


def test_silences_expire(spark):
    asked = spark.createDataFrame([("a", "f1", "why", "ops", T0, 24), ("b", "f2", "why", "ops", T0, 168)], "id string, fingerprint string, reason string, silenced_by string, silenced_at timestamp_ntz, hours int")
    made = A.new_silences(asked)
    ended = A.expire_silences(made, spark.createDataFrame([("a",), ("zz",)], "id string"), T0 + timedelta(hours=1))
    now = A.latest_version(made.unionByName(ended), "id", "silenced_at")
    assert {r["id"]: r["active"] for r in now.collect()} == {"a": False, "b": True}


def test_irr_lookups_that_failed(spark):
    e = events(spark, [(1, 0, "announce", "p1", 1), (2, 0, "announce", "p2", 1), (3, 0, "announce", "p3", 1)])
    routes = spark.createDataFrame([("p1", 1), ("p2", 1)], "prefix string, origin long")
    got = {r["prefix"]: (r["irr"], r["irr_asns"]) for r in R.irr_check(e, routes, spark.createDataFrame([("p2",)], "prefix string")).collect()}
    assert got == {"p1": ("Consistent", [1]), "p2": ("Unavailable", None), "p3": ("NotFound", None)}


def test_collectors(spark):
    known = C.registry(spark)
    o = spark.createDataFrame([(1, "rrc00", 5), (1, "rrc03", 9), (1, "rrc99", 12)], "event_id long, collector string, arrival_ms long")
    hops = {(r["a"], r["b"]): r["km"] for r in C.hop_distances(o, known).collect()}
    assert hops["rrc00", "rrc03"] == pytest.approx(5860, abs=30) and hops["rrc03", "rrc99"] is None
    assert C.pair_distances(known).count() == 676
    assert {r["collector"]: r["is_known"] for r in C.lookup(o, known).collect()} == {"rrc00": True, "rrc03": True, "rrc99": False}


def test_json_types_are_checked(spark):
    good = '{"prefix":"p","origin_as":1,"peer_asn":2,"event_type":"announce","as_path":[2,"a",1.5,1]}'
    bad = ['{"prefix":5,"origin_as":1,"peer_asn":2,"event_type":"announce"}', '{"prefix":"p","origin_as":"1","peer_asn":2,"event_type":"announce"}', '{"prefix":"p","origin_as":1.5,"peer_asn":2,"event_type":"announce"}', "[1]", "null", "{", "", None]
    out = readers.extract_stream(spark.createDataFrame([(t,) for t in [good, *bad]], "metadata string")).collect()
    assert [(r["prefix"], r["origin_as"], r["as_path"], r["collector"]) for r in out] == [("p", 1, [2, 1], "unknown")]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_folder(Session())
