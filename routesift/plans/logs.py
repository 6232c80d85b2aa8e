"""Queries of log validation, redaction, quotas and usage."""

from pyspark.sql import functions as F

from ..operators import logs as L
from . import fixtures as X
from .fixtures import sql
from .functions import _pii_sql
from .registry import query

JSON = """case k % 8 when 1 then concat('{"level":"', level, '","source":"', source, '"}') when 2 then concat('{"level":"CRITICAL","source":"', source, '","message":"', message, '"}')
when 3 then concat('{"level":"info","source":"', source, '","message":""}') when 4 then concat('{"level":"info","source":"', repeat('s', 129), '","message":"', message, '"}')
when 5 then concat('{"level":"info","source":"', source, '","message":"', message, '","metadata":5}') when 6 then concat('{"level":"info","source":"', source, '","message":"', message, '","extra":[1]}')
when 7 then '{"level":"info"' else concat('{"level":"', level, '","source":"', source, '","message":"', message, '","metadata":{"k":', k, '}}') end as json"""
JSON_SQL = f", lk as (select m.*, b.k from log_messages m join base b on b.event_id = m.id), entries as (select id, timestamp, tenant_id, source as s, level as l, message as m, k, {JSON} from lk) "
VALID_SQL = JSON_SQL + """, validated as (select *, case when k % 8 = 7 then 'not an object' when k % 8 = 1 then 'message' when k % 8 = 2 then 'level' when k % 8 = 3 then 'message' when k % 8 = 4 then 'source' when k % 8 = 5 then 'metadata' else '' end as errors from entries) """
_INNER, _TOTAL, _ = _pii_sql("message")
KEYED_SQL = ", keyed as (select *, sha256(lower(trim(message))) as key from log_messages), first as (select key, min(id) as first_id from (select key, id, row_number() over (partition by key order by timestamp, id) as i from keyed) where i = 1 group by 1), flags as (select id, key, id <> first_id as is_hit from keyed join first using (key)) "
REDACT_SQL = KEYED_SQL + f", src as (select id, message from log_messages where id in (select first_id from first)), once as (select id as first_id, t7 as redacted, ({_TOTAL})::int as hits from {_INNER}), redacted as (select f.id, f.key, o.redacted, o.hits, f.is_hit from flags f join first using (key) join once o using (first_id)) "
COST_SQL = REDACT_SQL + ", cost as (select tenant_id, count(*) as requests, sum(strlen(message))::bigint as bytes, sum(hits)::bigint as pii_hits, count(*) filter (is_hit) as cache_hits, count(*) filter (not is_hit) as cache_misses from redacted join log_messages using (id) group by 1) "


def entries(spark, d):
    m = X.log_messages(spark, d).join(X.base(spark, d).select(F.col("event_id").alias("id"), "k"), "id")
    return m.selectExpr("id", "timestamp", "tenant_id", JSON)


def cost(spark, d):
    m = X.log_messages(spark, d)
    r = m.join(L.redact_distinct(m).select("id", F.col("hits").alias("pii_hits")), "id").join(L.repeat_flags(m).select("id", F.col("is_hit").alias("cache_hit")), "id")
    return L.tenant_cost(r.withColumn("bytes", F.octet_length("message").cast("long")))


@query("log_validate", sql(VALID_SQL + "select id, errors from validated"))
def log_validate(spark, d):
    return L.validate(entries(spark, d)).select("id", "errors")


@query("log_split", sql(VALID_SQL + "select tenant_id, count(*) filter (errors = '') as accepted, count(*) filter (errors <> '') as rejected from validated group by 1"))
def log_split(spark, d):
    good, bad = L.split(L.validate(entries(spark, d)))
    both = good.select("tenant_id", F.lit(1).alias("a")).unionByName(bad.select("tenant_id", F.lit(0).alias("a")))
    return both.groupBy("tenant_id").agg(F.count_if(F.col("a") == 1).alias("accepted"), F.count_if(F.col("a") == 0).alias("rejected"))


@query("message_repeat_flag", sql(KEYED_SQL + "select * from flags"))
def message_repeat_flag(spark, d):
    return L.repeat_flags(X.log_messages(spark, d))


@query("redact_distinct", sql(REDACT_SQL + "select id, key, redacted, hits from redacted"))
def redact_distinct(spark, d):
    return L.redact_distinct(X.log_messages(spark, d))


@query("dedupe_stats", sql(KEYED_SQL + "select count(*) as total, count(*) filter (is_hit) as hits, count(*) filter (not is_hit) as misses, round(count(*) filter (is_hit) * 100.0 / count(*), 6) as hit_rate from flags"))
def dedupe_stats(spark, d):
    return L.dedupe_stats(L.repeat_flags(X.log_messages(spark, d))).withColumn("hit_rate", F.round("hit_rate", 6))


@query("tenant_cost", sql(COST_SQL + "select * from cost"))
def tenant_cost(spark, d):
    return cost(spark, d)


@query("cost_summary", sql(COST_SQL + "select tenant_id, sum(requests)::bigint as requests, sum(bytes)::bigint as bytes, sum(pii_hits)::bigint as pii_hits, sum(cache_hits)::bigint as cache_hits, sum(cache_misses)::bigint as cache_misses from cost group by rollup (tenant_id)"))
def cost_summary(spark, d):
    return L.cost_summary(cost(spark, d))


@query("cost_report", sql(COST_SQL + "select tenant_id, format('Tenant: {} Requests: {} Bytes: {:.1f} MB PII Hits: {}', tenant_id, requests, bytes / 1048576.0, pii_hits) as line from cost union all select null, 'Total tenants: ' || count(*) from cost"))
def cost_report(spark, d):
    return L.cost_report(cost(spark, d))


@query("quota_check", sql("select id, tenant_id, round(n * 100.0 / 70, 6) as share, case when n > 70 then 'Exceeded' when n * 100.0 / 70 >= 80 then 'SoftWarning' else 'Allowed' end as quota from (select *, row_number() over (partition by tenant_id, date_trunc('day', timestamp) order by timestamp, id) as n from log_messages)"))
def quota_check(spark, d):
    return L.quota_check(X.log_messages(spark, d), F.lit(70.0), "day").select("id", "tenant_id", F.round("share", 6).alias("share"), "quota")


GCRA_SQL = """, nth as (select tenant_id, id, epoch_us(timestamp) / 1e6 as t, row_number() over (partition by tenant_id order by timestamp, id) as i from log_messages),
walk(tenant_id, i, id, tat, ok) as (select tenant_id, i, id, t + 900, true from nth where i = 1
union all select w.tenant_id, n.i, n.id, case when greatest(w.tat, n.t) - n.t <= 900 + 1e-9 then greatest(w.tat, n.t) + 900 else w.tat end, greatest(w.tat, n.t) - n.t <= 900 + 1e-9 from walk w join nth n on n.tenant_id = w.tenant_id and n.i = w.i + 1) """


@query("gcra_limit", sql(GCRA_SQL + "select tenant_id, id, ok as conforming from walk"))
def gcra_limit(spark, d):
    return L.gcra_limit(X.log_messages(spark, d), 1 / 900, 2).select("tenant_id", "id", "conforming")


@query("log_pipeline", sql(VALID_SQL + f""", q as (select *, row_number() over (partition by tenant_id, date_trunc('day', timestamp) order by timestamp, id) as n from validated where errors = ''),
a as (select *, sha256(lower(trim(m))) as key, case when n * 100.0 / 15 >= 80 then 'SoftWarning' else 'Allowed' end as quota from q where n <= 15),
f as (select key, first(id order by timestamp, id) as fid from a group by 1), src as (select id, m as message from a where id in (select fid from f)), once as (select id as fid, t7 as redacted, ({_TOTAL})::int as hits from {_INNER})
select a.id, timestamp, tenant_id, s as source, case when k % 8 = 6 then 'info' else l end as level, redacted as redacted_message, hits as pii_hits, strlen(m)::bigint as bytes, a.id <> fid as cache_hit, quota from a join f using (key) join once using (fid)"""))
def log_pipeline(spark, d):
    return L.log_pipeline(entries(spark, d), F.lit(15.0), "day")
