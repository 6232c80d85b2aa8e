"""Queries of propagation measures, wave baselines and scores."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import waves as W
from ..operators.storage import checkpointed, stored
from . import fixtures as X
from .fixtures import sql
from .functions import GEO_SQL, pair_distances
from .registry import query

PROP_SQL = """, once as (select arrival_ms // 300000 as slot, prefix, origin_as, as_path, collector, min(arrival_ms) as arrival_ms from bgp_observations group by all),
prop as (select slot, prefix, origin_as, as_path, list(arrival_ms::double order by arrival_ms, collector) as times_ms, list(collector order by arrival_ms, collector) as arrival_order, min(arrival_ms)::double as first_ms, max(arrival_ms)::double as last_ms, count(*)::int as n_collectors, (max(arrival_ms) - min(arrival_ms))::double as spread_ms from once group by slot, prefix, origin_as, as_path having count(*) >= 3),
good as (select * from prop where len(as_path) between 1 and 6 and spread_ms <= 10000) """


def base_sql(where: str = "true", n: int = 30) -> str:
    return PROP_SQL + f""", src as (select * from good where {where}),
ranked as (select prefix, origin_as, as_path, unnest(arrival_order) as collector, generate_subscripts(arrival_order, 1) - 1 as pos from src),
orders as (select prefix, origin_as, as_path, list(collector order by rank, collector) as expected_order from (select prefix, origin_as, as_path, collector, avg(pos) as rank from ranked group by all) group by all),
baseline as (select prefix, origin_as, as_path, count(*) as sample_count, min(spread_ms) as min_spread_ms, quantile_cont(spread_ms, 0.5) as p50_spread_ms, quantile_cont(spread_ms, 0.95) as p95_spread_ms, quantile_cont(spread_ms, 0.99) as p99_spread_ms, max(spread_ms) as max_spread_ms, stddev_pop(spread_ms) as std_dev, max(last_ms) as data_cutoff_ms from src group by all having count(*) >= {n}),
full_baseline as (select * from baseline join orders using (prefix, origin_as, as_path)) """


BASE_SQL = base_sql()


def score_sql(join: str = "left join full_baseline b using (prefix, origin_as, as_path)", where: str = "true", n: int = 30) -> str:
    return base_sql(where, n) + GEO_SQL + f""", far as (select slot, prefix, origin_as, as_path, max(km) as km from (select slot, prefix, origin_as, as_path, unnest(arrival_order) as ca from prop) x join (select slot, prefix, origin_as, as_path, unnest(arrival_order) as cb from prop) y using (slot, prefix, origin_as, as_path) join pairs on a = ca and b = cb where ca < cb group by all),
tops as (select * from full_baseline qualify row_number() over (partition by prefix order by sample_count desc, origin_as desc, as_path desc) = 1),
signals as (select p.slot, p.prefix, p.origin_as, p.as_path, first_ms, spread_ms, b.sample_count is not null as has,
case when b.std_dev = 0 then 0 else least(abs((spread_ms - b.p50_spread_ms) / b.std_dev) / 3, 1) end as z, case when spread_ms > b.p99_spread_ms then 1.0 else 0.0 end as o,
len([i for i in range(1, len(times_ms)) if times_ms[i + 1] - times_ms[i] > 4])::double / (len(times_ms) - 1) as g,
1 - len(list_intersect(arrival_order[1:3], b.expected_order[1:3]))::double / least(len(arrival_order[1:3]), len(b.expected_order[1:3])) as d,
case when coalesce(km, 0) = 0 then 0 else greatest(0, least(1, spread_ms / greatest(km / 200000.0 * 1000, 0.001))) end as s
from prop p left join far using (slot, prefix, origin_as, as_path) {join}),
scored as (select slot, prefix, origin_as, as_path, first_ms, case when has then z else 0 end as spread_z, case when has then o else 0 end as outlier, case when has then g else 0 end as gap, case when has then d else 0 end as "order", case when has then s else 0 end as speed,
case when has then 0.4 * z + 0.3 * o + 0.15 * g + 0.1 * d + 0.05 * s else 0 end as raw from signals),
classed as (select *, least(raw, 1.0) as score, case when raw < 0.3 then 'Normal' when raw < 0.6 then 'Suspicious' else 'Anomalous' end as class from scored) """


SCORE_SQL = score_sql()
KEY = "slot, prefix, origin_as, as_path"
KEYS = KEY.split(", ")


def prop(spark, d):
    return W.propagation(X.bgp_observations(spark, d))


def scored(spark, d):
    e = checkpointed(prop(spark, d))  # the statistics, the order and the score start from it
    return W.wave_score(e, W.build_baseline(W.good_route(e)), pair_distances(spark))


@query("propagation_measures", sql(PROP_SQL + f"select {KEY}, first_ms, last_ms, spread_ms, arrival_order from prop"))
def propagation_measures(spark, d):
    return prop(spark, d).select(*KEYS, "first_ms", "last_ms", "spread_ms", "arrival_order")


@query("offline_propagation", sql(PROP_SQL + f"select {KEY}, n_collectors, spread_ms from prop"))
def offline_propagation(spark, d):
    return prop(spark, d).select(*KEYS, "n_collectors", "spread_ms")


@query("good_route", sql(PROP_SQL + f"select {KEY}, n_collectors from good"))
def good_route(spark, d):
    return W.good_route(prop(spark, d)).select(*KEYS, "n_collectors")


@query("good_route_ratio", sql(PROP_SQL + "select count(*) as total, (select count(*) from good) as good, round((select count(*) from good) * 100.0 / count(*), 6) as percent from prop"))
def good_route_ratio(spark, d):
    return W.good_route_ratio(prop(spark, d)).withColumn("percent", F.round("percent", 6))


@query("wave_stats", sql(PROP_SQL + "select prefix, count(*) as n, round(avg(spread_ms), 6) as mean, round(stddev_pop(spread_ms), 6) as std, min(spread_ms) as min, max(spread_ms) as max from prop group by 1"))
def wave_stats(spark, d):
    return W.wave_stats(prop(spark, d), ["prefix"]).select("prefix", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query("expected_order", sql(BASE_SQL + "select prefix, origin_as, as_path, expected_order from orders"))
def expected_order(spark, d):
    return W.expected_order(W.good_route(prop(spark, d)))


COLS = "prefix, origin_as, as_path, sample_count, min_spread_ms, round(p50_spread_ms, 6) as p50, round(p95_spread_ms, 6) as p95, round(p99_spread_ms, 6) as p99, max_spread_ms, round(std_dev, 6) as std_dev"


def baseline_cols(b):
    return b.selectExpr("prefix", "origin_as", "as_path", "sample_count", "min_spread_ms", "round(p50_spread_ms, 6) as p50", "round(p95_spread_ms, 6) as p95", "round(p99_spread_ms, 6) as p99", "max_spread_ms", "round(std_dev, 6) as std_dev", "expected_order", "data_cutoff_ms")


@query("wave_baseline_build", sql(base_sql(n=10) + f"select {COLS}, expected_order, data_cutoff_ms from full_baseline"))
def wave_baseline_build(spark, d):
    return baseline_cols(W.build_baseline(W.good_route(prop(spark, d)), 10))


@query("baseline_build_job", sql(BASE_SQL + f"select {COLS}, expected_order, data_cutoff_ms from full_baseline"))
def baseline_build_job(spark, d):
    return baseline_cols(W.baseline_job(X.bgp_observations(spark, d)))


@query("wave_baseline_lookup", sql(BASE_SQL + f"select {KEY}, sample_count, round(p50_spread_ms, 6) as p50 from prop left join full_baseline using (prefix, origin_as, as_path)"))
def wave_baseline_lookup(spark, d):
    e = stored(prop(spark, d))  # the statistics, the order and the lookup start from it
    return W.lookup_baseline(e, W.build_baseline(W.good_route(e))).select(*KEYS, "sample_count", F.round("p50_spread_ms", 6).alias("p50"))


@query("collector_pair_max", sql(SCORE_SQL + f"select {KEY}, round(km, 5) as km from prop left join far using ({KEY})"))
def collector_pair_max(spark, d):
    return W.far_pairs(prop(spark, d), pair_distances(spark), KEYS).select(*KEYS, F.round("km", 5).alias("km"))


@query("gap_ratio", sql(SCORE_SQL + f"select {KEY}, round(g, 6) as gap_ratio from signals"))
def gap_ratio(spark, d):
    return prop(spark, d).select(*KEYS, F.round(S.gap_ratio(F.col("times_ms")), 6).alias("gap_ratio"))


@query("order_deviation", sql(BASE_SQL + f"select {KEY}, round(1 - len(list_intersect(arrival_order[1:3], expected_order[1:3]))::double / 3, 6) as deviation from good join orders using (prefix, origin_as, as_path)"))
def order_deviation(spark, d):
    e = W.good_route(prop(spark, d))
    return e.join(W.expected_order(e), W.GROUP).select(*KEYS, F.round(S.order_deviation(F.col("arrival_order"), F.col("expected_order")), 6).alias("deviation"))


@query("propagation_speed", sql(SCORE_SQL + f"select {KEY}, round(s, 6)::double as speed from signals"))
def propagation_speed(spark, d):
    e = W.far_pairs(prop(spark, d), pair_distances(spark), KEYS)
    return e.select(*KEYS, F.round(S.propagation_speed(F.col("spread_ms"), F.col("km")), 6).alias("speed"))


@query("wave_score", sql(SCORE_SQL + f"select {KEY}, round(spread_z, 6)::double as spread_z, outlier::double as outlier, round(gap, 6)::double as gap, round(\"order\", 6)::double as order_deviation, round(speed, 6)::double as speed, round(score, 6)::double as score, class from classed"))
def wave_score(spark, d):
    r = lambda c, n=None: F.round(c, 6).alias(n or c)
    return scored(spark, d).select(*KEYS, r("spread_z"), "outlier", r("gap"), r("order", "order_deviation"), r("speed"), r("score"), "class")


@query("wave_anomalies", sql(SCORE_SQL + "select 'PossibleHijack' as anomaly_type, slot, prefix, origin_as, round(score, 6)::double as confidence, class from classed where class <> 'Normal'"))
def wave_anomalies(spark, d):
    a = W.wave_anomalies(scored(spark, d))
    return a.select("anomaly_type", "slot", "prefix", "origin_as", F.round("confidence", 6).alias("confidence"), F.regexp_extract("details", r"\((\w+)\)", 1).alias("class"))


START, END = 1705363200000, 1706745600000
CASE = {"prefix": "10.1.0.0/20", "legitimate_origin_as": 64513, "hijacker_origin_as": 65000, "start_ms": START, "end_ms": END, "detection_threshold": 0.1}
BACK_SQL = score_sql("left join tops b on b.prefix = p.prefix", f"last_ms < {START}", 5)
ATTACK = f"prefix = '10.1.0.0/20' and origin_as = 65000 and first_ms between {START} - 1000 and {END} + 1000"


def half_baseline(spark, d):
    return W.build_baseline(W.good_route(prop(spark, d)).where(F.col("last_ms") < START), 5)


@query("case_label", sql(PROP_SQL + f"select {KEY}, {ATTACK} as is_attack from prop"))
def case_label(spark, d):
    return W.label_case(prop(spark, d), CASE).select(*KEYS, "is_attack")


CONF_SQL = f""", lab as (select *, {ATTACK} as attack, score >= 0.1 as hit from classed),
conf as (select count(*) filter (attack and hit) as tp, count(*) filter (attack and not hit) as fn, count(*) filter (not attack and hit) as fp, count(*) filter (not attack and not hit) as tn, round(min(case when attack and hit then greatest(first_ms - {START}, 0) / 1000 end), 3) as latency_s, count(*) filter (score = 0 and not attack) as no_baseline from lab)
select *, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::double as tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 6)::double as fpr, round(coalesce(fp / nullif(fp + tn - no_baseline, 0), 0), 6)::double as fpr_covered from conf"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "fpr_covered")}).withColumn("latency_s", F.round("latency_s", 3))


@query("backtest", sql(BACK_SQL + CONF_SQL))
def backtest(spark, d):
    return rounded(W.backtest(X.bgp_observations(spark, d), half_baseline(spark, d), pair_distances(spark), CASE))


@query("backtest_confusion", sql(score_sql("left join full_baseline b using (prefix, origin_as, as_path)", f"last_ms < {START}", 5) + CONF_SQL))
def backtest_confusion(spark, d):
    s = W.wave_score(prop(spark, d), half_baseline(spark, d), pair_distances(spark))
    return rounded(W.confusion(W.label_case(s, CASE).withColumn("start_ms", F.lit(float(START))), 0.1))
