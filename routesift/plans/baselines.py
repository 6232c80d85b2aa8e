"""Queries of path-length baselines and confidence enhancement."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import baselines as B
from ..operators import detectors as D
from ..operators.storage import work_folder
from . import fixtures as X
from .detectors import FIRST_SQL
from .fixtures import sql
from .registry import query


def ema_sql(where: str = "event_type = 'announce'") -> str:
    """Numbered path lengths per prefix and the recurrence over them; ``before`` holds the state before each event."""
    return f""", numbered as (select event_id, timestamp, prefix, origin_as, len(as_path)::double as x, row_number() over (partition by prefix order by timestamp, event_id) as i from bgp_events where {where}),
fold(prefix, i, event_id, x, ema0, var0, n0, ema, var, n) as (select prefix, i, event_id, x, 0.0::double, 0.0::double, 0::bigint, x, 0.0::double, 1::bigint from numbered where i = 1
union all select f.prefix, m.i, m.event_id, m.x, f.ema, f.var, f.n, f.ema + 0.1 * (m.x - f.ema), 0.9 * (f.var + 0.1 * (m.x - f.ema) * (m.x - f.ema)), f.n + 1 from fold f join numbered m on m.prefix = f.prefix and m.i = f.i + 1),
last as (select * from fold qualify row_number() over (partition by prefix order by i desc) = 1),
scored as (select prefix, event_id, case when n0 >= 5 then (x - ema0) / sqrt(var0 + 1e-6) end as z from fold),
days as (select origin_as, count(distinct timestamp::date) as days from bgp_events where {where} group by 1) """


EMA_SQL = ema_sql()
UNUSUAL = "(split_part(f.prefix, '/', 2)::int not between 8 and 24)"
BOOST = f"greatest(-0.15, least(0.15, (case when coalesce(abs(z) > 3, false) then 0.1 else 0.0 end + case when {UNUSUAL} then 0.05 else 0.0 end - case when coalesce(days >= 7, false) then 0.1 else 0.0 end)::double))"
ENH_SQL = EMA_SQL + FIRST_SQL + f", enh as (select f.event_id, f.prefix, f.origin_as, 0.85 as confidence, coalesce(abs(z) > 3, false) as path_anomaly, {UNUSUAL} as unusual_prefix, coalesce(days >= 7, false) as well_known, days, {BOOST} as boost from firsts f left join scored s using (event_id) left join days d on d.origin_as = f.origin_as) "


def announces(spark, d):
    return X.bgp_events(spark, d).where("event_type = 'announce'")


def enhanced(spark, d):
    e = announces(spark, d)
    return B.enhanced(D.hijack_first_seen(e), B.path_length_anomaly(e), B.as_days_seen(e))


@query("ema_baseline", sql(EMA_SQL + "select prefix, round(ema, 6) as ema, round(var, 6) as var, n from last"))
def ema_baseline(spark, d):
    return B.ema_baseline(announces(spark, d)).select("prefix", F.round("ema", 6).alias("ema"), F.round("var", 6).alias("var"), "n")


@query("path_length_anomaly", sql(EMA_SQL + "select prefix, event_id, round(z, 5) as z, coalesce(abs(z) > 3, false) as is_anomaly from scored"))
def path_length_anomaly(spark, d):
    return B.path_length_anomaly(announces(spark, d)).select("prefix", "event_id", F.round("z", 5).alias("z"), "is_anomaly")


@query("as_days_seen", sql(EMA_SQL + "select origin_as, days, days >= 7 as well_known, round(least(days / 30.0, 1.0), 6)::double as score from days"))
def as_days_seen(spark, d):
    return B.as_days_seen(announces(spark, d)).withColumn("score", F.round("score", 6))


@query("baseline_feature_join", sql(ENH_SQL + "select event_id, prefix, origin_as, path_anomaly, unusual_prefix, well_known, days from enh"))
def baseline_feature_join(spark, d):
    return enhanced(spark, d).select("event_id", "prefix", "origin_as", "path_anomaly", "unusual_prefix", "well_known", "days")


@query("confidence_enhance", sql(ENH_SQL + "select event_id, round(boost, 6)::double as boost, round(greatest(0, least(1, 0.85 + boost)), 6)::double as enhanced from enh"))
def confidence_enhance(spark, d):
    return enhanced(spark, d).select("event_id", F.round("boost", 6).alias("boost"), F.round("enhanced", 6).alias("enhanced"))


@query("anomaly_ab", sql(ENH_SQL + "select event_id, prefix, 0.85::double as rule_based, round(greatest(0, least(1, 0.85 + boost)), 6)::double as enhanced from enh"))
def anomaly_ab(spark, d):
    return enhanced(spark, d).select("event_id", "prefix", F.col("confidence").alias("rule_based"), F.round("enhanced", 6).alias("enhanced"))


TRAIN = "event_type = 'announce' and timestamp >= timestamp '2024-01-30' - interval 10 days"


@query("baseline_train", sql(ema_sql(TRAIN) + "select 'prefix' as kind, prefix as key, round(ema, 6) as value, n from last union all select 'as', origin_as::varchar, round(least(days / 30.0, 1.0), 6)::double, days from days"))
def baseline_train(spark, d):
    prefixes, asns = B.train(X.bgp_events(spark, d), datetime(2024, 1, 30), 10)
    p = prefixes.select(F.lit("prefix").alias("kind"), F.col("prefix").alias("key"), F.round("ema", 6).alias("value"), "n")
    return p.unionByName(asns.select(F.lit("as").alias("kind"), F.col("origin_as").cast("string").alias("key"), F.round("score", 6).alias("value"), F.col("days").alias("n")))


#: Snapshots are taken of all events before each of these days; a cleanup on the 30th keeps those of the last week.
SNAPSHOT_DAYS = ("2024-01-10", "2024-01-20", "2024-01-25")


@query("baseline_snapshot", sql(ema_sql(f"event_type = 'announce' and timestamp < timestamp '{SNAPSHOT_DAYS[-1]}'") + f"select '{SNAPSHOT_DAYS[-1]}' as snapshot_date, prefix, round(ema, 6) as ema, round(var, 6) as var, n from last"))
def baseline_snapshot(spark, d):
    path = f"{work_folder(spark)}/snapshots"
    for day in SNAPSHOT_DAYS:
        B.save_snapshot(B.ema_baseline(announces(spark, d).where(F.col("timestamp") < F.lit(datetime.fromisoformat(day)).cast("timestamp_ntz"))), path, day)
    B.remove_snapshots(spark, path, "2024-01-30")
    newest = B.newest_snapshot(B.load_snapshots(spark, path))
    return newest.select("snapshot_date", "prefix", F.round("ema", 6).alias("ema"), F.round("var", 6).alias("var"), "n")
