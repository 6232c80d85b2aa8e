"""Queries of alert routing, versioned tables and tenants."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import detectors as D
from . import fixtures as X
from .detectors import FIRST_SQL, FLAP_SQL
from .fixtures import sql
from .registry import query

AS_OF = datetime(2024, 1, 20)
IN_SQL = FIRST_SQL + FLAP_SQL + """, alerts_in as (select event_id, 'PossibleHijack' as anomaly_type, 'hijack' as alert_type, prefix, origin_as, 0.85 as confidence, timestamp as detected_at, tenant_id from firsts union all select event_id, 'PrefixFlapping', 'flap', prefix, origin_as, 0.75, timestamp, tenant_id from flaps),
printed as (select *, 'critical' as level, sha256(alert_type || ':' || prefix || ':' || origin_as) as fingerprint from alerts_in),
silences as (select 's' || prefix as id, sha256('flap:' || prefix || ':' || origin_as) as fingerprint, timestamp '2024-01-05' as silenced_at, timestamp '2024-01-05' + to_hours(150) as expires_at, true as active from bgp_events where prefix like '10.1%' and origin_as >= 64512 and origin_as < 65000 group by prefix, origin_as),
heard as (select * from printed p where not exists (select 1 from silences s where s.fingerprint = p.fingerprint and p.detected_at >= silenced_at and p.detected_at < expires_at)) """


def dedup_sql(source: str) -> str:
    return f""", nth as (select *, row_number() over (partition by fingerprint order by detected_at, event_id) as i from {source}),
walk(fingerprint, i, last, is_new) as (select fingerprint, i, detected_at, true from nth where i = 1 union all select w.fingerprint, n.i, case when epoch_us(n.detected_at) - epoch_us(w.last) >= 1800000000 then n.detected_at else w.last end, epoch_us(n.detected_at) - epoch_us(w.last) >= 1800000000 from walk w join nth n on n.fingerprint = w.fingerprint and n.i = w.i + 1),
routed as (select n.* from nth n join walk w using (fingerprint, i) where w.is_new) """


ROUTE_SQL = IN_SQL + dedup_sql("heard")
HIST_SQL = ROUTE_SQL + """, history as (select alert_type, prefix, origin_as, confidence, 'fired' as status, detected_at as fired_at, null::timestamp as resolved_at, event_id from routed) """


def alerts_in(spark, d):
    e = X.bgp_events(spark, d)
    return D.anomaly_union(D.hijack_first_seen(e), D.flapping_anomalies(D.flapping(e, 86400, 3, 2), 86400)).drop("details")


def silences(spark, d):
    e = X.bgp_events(spark, d).where("prefix like '10.1%' and origin_as >= 64512 and origin_as < 65000").select("prefix", "origin_as").distinct()
    r = e.select(F.concat(F.lit("s"), "prefix").alias("id"), S.alert_fingerprint(F.lit("flap"), F.col("prefix"), F.col("origin_as")).alias("fingerprint"), F.lit("planned").alias("reason"), F.lit("ops").alias("silenced_by"), F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz").alias("silenced_at"), F.lit(150).alias("hours"))
    return A.new_silences(r)


def routed(spark, d):
    return A.route(alerts_in(spark, d), silences(spark, d))


def history(spark, d):
    return A.history_rows(routed(spark, d))


@query("alert_dedup", sql(IN_SQL + dedup_sql("printed") + "select n.event_id, n.fingerprint, w.is_new from nth n join walk w using (fingerprint, i)"))
def alert_dedup(spark, d):
    return A.dedup_flags(A.fingerprinted(alerts_in(spark, d))).select("event_id", "fingerprint", "is_new")


@query("silence_anti", sql(IN_SQL + "select event_id, fingerprint from heard"))
def silence_anti(spark, d):
    return A.unsilenced(A.fingerprinted(alerts_in(spark, d)), silences(spark, d)).select("event_id", "fingerprint")


@query("silences_active", sql(IN_SQL + "select id, fingerprint, expires_at from silences where active and expires_at > timestamp '2024-01-10'"))
def silences_active(spark, d):
    s = A.latest_version(silences(spark, d), "id", "silenced_at").where("active")
    return s.where(F.col("expires_at") > F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")).select("id", "fingerprint", "expires_at")


ASKED_SQL = ", asked as (select id, sha256('flap:' || prefix || ':' || origin_as) as fingerprint, silenced_at, silenced_at + to_hours(hours::int) as expires_at from silence_requests where hours between 1 and 168 and reason <> '') "


@query("silence_upsert", sql(ASKED_SQL + "select id, fingerprint, expires_at, silenced_at < timestamp '2024-01-05' as expired from asked"))
def silence_upsert(spark, d):
    r = X.silence_requests(spark, d).withColumn("fingerprint", S.alert_fingerprint(F.lit("flap"), F.col("prefix"), F.col("origin_as")))
    made = A.new_silences(r.select("id", "fingerprint", "reason", "silenced_by", "silenced_at", "hours"))
    ended = A.expire_silences(made, made.where(F.col("silenced_at") < F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz")).select("id"), datetime(2025, 1, 1))
    newest = A.latest_version(made.unionByName(ended), "id", "silenced_at")
    return newest.select("id", "fingerprint", "expires_at", (~F.col("active")).alias("expired"))


@query("alert_route", sql(ROUTE_SQL + "select event_id, alert_type, prefix, origin_as, confidence::double as confidence, level, fingerprint from routed"))
def alert_route(spark, d):
    return routed(spark, d).select("event_id", "alert_type", "prefix", "origin_as", "confidence", "level", "fingerprint")


@query("alert_payload", sql(ROUTE_SQL + "select event_id, '{\"event_type\":\"bgp_alert\",\"level\":\"' || level || '\",\"anomaly_type\":\"' || alert_type || '\",\"prefix\":\"' || prefix || '\",\"origin_as\":' || origin_as || ',\"confidence\":' || confidence || ',\"fingerprint\":\"' || fingerprint || '\"}' as payload, '[' || upper(level) || '] BGP Alert: ' || prefix || ' AS' || origin_as || ' confidence=' || confidence as slack from routed"))
def alert_payload(spark, d):
    return A.payload(routed(spark, d))


@query("alert_persist", sql(HIST_SQL + "select alert_type, prefix, origin_as, confidence::double as confidence, status, fired_at, resolved_at from history"))
def alert_persist(spark, d):
    return history(spark, d).select("alert_type", "prefix", "origin_as", "confidence", "status", "fired_at", "resolved_at")


@query("active_alerts", sql(HIST_SQL + "select alert_type, prefix, origin_as, fired_at from history where resolved_at is null"))
def active_alerts(spark, d):
    return A.active_alerts(history(spark, d)).select("alert_type", "prefix", "origin_as", "fired_at")


@query("alert_resolve", sql(HIST_SQL + "select alert_type, prefix, origin_as, fired_at, case when alert_type = 'flap' then 'resolved' else 'fired' end as status, case when alert_type = 'flap' then timestamp '2024-01-20' end as resolved_at from history"))
def alert_resolve(spark, d):
    h = history(spark, d)
    return A.resolve(h, h.where("alert_type = 'flap'").select("id"), AS_OF).select("alert_type", "prefix", "origin_as", "fired_at", "status", "resolved_at")


#: Of every third origin the alerts are resolved, some before and some after they would escalate.
ENDED = "fired_at + make_interval(0, 0, 0, 0, 0, 0, 100 + 250 * (origin_as % 2)) as resolved_at"
ENDED_SQL = ", ended as (select * exclude (resolved_at), fired_at + to_seconds((100 + 250 * (origin_as % 2))::int) as resolved_at from history where origin_as % 3 = 0) "
BUMPED_SQL = """case when alert_type = 'hijack' then 'PossibleHijack' else 'PrefixFlapping' end as anomaly_type, prefix, origin_as, round(least(confidence + 0.15, 0.95), 6)::double as confidence, fired_at as detected_at, 'Auto-escalated from confidence ' || confidence as details,
case when confidence + 0.15 < 0.9 then 'critical' else 'emergency' end as level, sha256(alert_type || ':' || prefix || ':' || origin_as) as fingerprint"""
UNHEARD_SQL = "not exists (select 1 from silences s where s.fingerprint = sha256(h.alert_type || ':' || h.prefix || ':' || h.origin_as) and {at} >= silenced_at and {at} < expires_at)"


def resolutions(alerts):
    return alerts.where("origin_as % 3 = 0").select("id", F.expr(ENDED))


def bumped_columns(rows):
    return rows.select("anomaly_type", "prefix", "origin_as", F.round("confidence", 6).alias("confidence"), "detected_at", "details", "level", "fingerprint")


@query("auto_escalate", sql(HIST_SQL + f"select {BUMPED_SQL} from history h where epoch(timestamp '2024-01-20') - epoch(fired_at) >= 300 and confidence < 0.9 and " + UNHEARD_SQL.format(at="timestamp '2024-01-20'")))
def auto_escalate(spark, d):
    return bumped_columns(A.reroute(A.auto_escalate(history(spark, d), AS_OF), silences(spark, d)))


LIVE = "(select * from {} qualify row_number() over (partition by id order by updated_at desc) = 1)"
RULES_NOW, TENANTS_NOW = LIVE.format("rules"), LIVE.format("tenants")


@query("rule_match", sql(IN_SQL + f", live as {RULES_NOW}, hit as (select a.event_id, a.anomaly_type, r.id as rule_id, row_number() over (partition by a.event_id, a.anomaly_type order by r.updated_at desc, r.id desc) as i from alerts_in a join live r on r.enabled and (coalesce(r.tenant_id, '') = '' or r.tenant_id = a.tenant_id) and a.confidence >= r.threshold) select event_id, anomaly_type, rule_id from hit where i = 1"))
def rule_match(spark, d):
    return A.rule_match(alerts_in(spark, d), A.rules_active(X.rules(spark, d)))


@query("latest_version", sql(f"select id, name, threshold, enabled, updated_at from {RULES_NOW}"))
def latest_version(spark, d):
    return A.latest_version(X.rules(spark, d)).select("id", "name", "threshold", "enabled", "updated_at")


@query("rules_active", sql(f"select id, name from {RULES_NOW} where enabled"))
def rules_active(spark, d):
    return A.rules_active(X.rules(spark, d)).select("id", "name")


@query("rule_upsert", sql(f"""select * from (select c.id, coalesce(c.name, r.name) as name, coalesce(c.rule_type, r.rule_type) as rule_type, coalesce(c.threshold, r.threshold) as threshold, coalesce(c.enabled, r.enabled) as enabled from rule_changes c left join {RULES_NOW} r using (id))
where rule_type in ('hijack', 'flap', 'leak', 'custom') and threshold between 0 and 1 and name <> ''"""))
def rule_upsert(spark, d):
    return A.upsert(X.rules(spark, d), X.changes(spark, d, "rules"), A.rule_errors()).select("id", "name", "rule_type", "threshold", "enabled")


@query("tenants_enabled", sql(f"select id, name, rate_limit_per_sec from {TENANTS_NOW} where enabled"))
def tenants_enabled(spark, d):
    return A.latest_version(X.tenants(spark, d)).where("enabled").select("id", "name", "rate_limit_per_sec")


@query("tenant_upsert", sql(f"""select * from (select c.id, coalesce(c.name, t.name) as name, coalesce(c.rate_limit_per_sec, t.rate_limit_per_sec) as rate_limit_per_sec, coalesce(c.plan, t.plan) as plan, coalesce(c.enabled, t.enabled) as enabled from tenant_changes c left join {TENANTS_NOW} t using (id))
where plan in ('free', 'pro', 'enterprise') and rate_limit_per_sec > 0"""))
def tenant_upsert(spark, d):
    return A.upsert(X.tenants(spark, d), X.changes(spark, d, "tenants"), A.tenant_errors()).select("id", "name", "rate_limit_per_sec", "plan", "enabled")


@query("tenant_by_key", sql(f"select l.id as request_id, t.id as tenant, coalesce(t.rate_limit_per_sec, 1000) as \"limit\" from log_messages l left join (select * from {TENANTS_NOW} where enabled) t on t.api_key_hash = sha256('key-' || substr(l.tenant_id, 2))"))
def tenant_by_key(spark, d):
    r = X.log_messages(spark, d).select(F.col("id").alias("request_id"), S.api_key_hash(F.concat(F.lit("key-"), F.substring("tenant_id", 2, 9))).alias("api_key_hash"))
    return A.tenant_by_key(r, X.tenants(spark, d)).select("request_id", "tenant", "limit")
