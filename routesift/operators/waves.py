"""How announcements spread over collectors: measures, baselines, scores and the backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import lookup_join, sized

SLOT_MS = 300_000
MIN_COLLECTORS, MIN_SAMPLES = 3, 30
#: Pairs of collectors that a literal may hold.
MAX_PAIRS = 5000
MAX_PATH, MAX_SPREAD_MS = 6, 10_000
WEIGHTS = {"spread": 0.4, "outlier": 0.3, "gap": 0.15, "order": 0.1, "speed": 0.05}
GROUP = ["prefix", "origin_as", "as_path"]


def measures(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: first and last arrival, spread, times and the collectors in order of arrival.

    ``arrivals`` has one row per group and collector; ties in time go by collector.
    """
    items = F.array_sort(F.collect_list(F.struct("arrival_ms", "collector")))
    g = arrivals.groupBy(*keys).agg(items.alias("i"))
    out = g.withColumns({"times_ms": F.transform("i", lambda x: x["arrival_ms"].cast("double")), "arrival_order": F.transform("i", lambda x: x["collector"])}).drop("i")
    return out.withColumns({"first_ms": F.array_min("times_ms"), "last_ms": F.array_max("times_ms"), "n_collectors": F.size("times_ms")}).withColumn("spread_ms", F.col("last_ms") - F.col("first_ms"))


def propagation(observations: DataFrame, min_collectors: int = MIN_COLLECTORS, slot_ms: int = SLOT_MS, arrival: str = "first") -> DataFrame:
    """Propagation events per time slot and (prefix, origin, path), with at least so many collectors.

    A collector counts once, at its earliest arrival in the slot (``arrival="last"``: its latest).
    The path itself is the key; its hash is an output only.
    """
    pick = F.min if arrival == "first" else F.max
    slot = F.floor(F.col("arrival_ms") / slot_ms).cast("long").alias("slot")
    once = observations.groupBy(slot, *GROUP, "collector").agg(pick("arrival_ms").alias("arrival_ms"))
    return measures(once, ["slot", *GROUP]).where(F.col("n_collectors") >= min_collectors)


def is_good() -> Column:
    """Enough collectors, a path of usable length, and a spread within bounds."""
    return (F.col("n_collectors") >= MIN_COLLECTORS) & F.size("as_path").between(1, MAX_PATH) & (F.col("spread_ms") <= MAX_SPREAD_MS)


def good_route(events: DataFrame) -> DataFrame:
    return events.where(is_good())


def wave_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("spread_ms")
    return events.groupBy(*keys).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"))


def expected_order(events: DataFrame) -> DataFrame:
    """Collectors of each (prefix, origin, path) by their mean rank of arrival, ties by id."""
    ranks = events.select(*GROUP, F.posexplode("arrival_order").alias("pos", "collector")).groupBy(*GROUP, "collector").agg(F.avg("pos").alias("rank"))
    return ranks.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("rank", "collector"))).alias("r")).select(*GROUP, F.transform("r", lambda x: x["collector"]).alias("expected_order"))


def build_baseline(events: DataFrame, min_samples: int = MIN_SAMPLES, approximate: bool = False) -> DataFrame:
    """Spread statistics, percentiles and expected order of groups with enough samples.

    Percentiles are exact; ``approximate`` uses bounded sketches for groups of very many samples.
    """
    s = F.col("spread_ms")
    levels = [0.5, 0.95, 0.99]
    p = F.percentile_approx(s, levels, 10_000) if approximate else F.percentile(s, F.array(*map(F.lit, levels)))
    g = events.groupBy(*GROUP).agg(F.count("*").alias("sample_count"), F.min(s).alias("min_spread_ms"), p.alias("p"), F.max(s).alias("max_spread_ms"), F.stddev_pop(s).alias("std_dev"), F.max("last_ms").alias("data_cutoff_ms"))
    g = g.where(F.col("sample_count") >= min_samples).select(*GROUP, "sample_count", "min_spread_ms", F.col("p")[0].alias("p50_spread_ms"), F.col("p")[1].alias("p95_spread_ms"), F.col("p")[2].alias("p99_spread_ms"), "max_spread_ms", "std_dev", "data_cutoff_ms")
    return g.join(expected_order(events), GROUP)


def baseline_job(observations: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return build_baseline(good_route(propagation(observations)), min_samples)


def good_route_ratio(events: DataFrame) -> DataFrame:
    """One row: total, good and the percentage of good routes (null without events)."""
    g = events.agg(F.count("*").alias("total"), F.count_if(is_good()).alias("good"))
    return g.withColumn("percent", F.try_divide(F.col("good") * 100.0, F.col("total")))


def save_baseline(baseline: DataFrame, path: str, description: str = "", mode: str = "overwrite") -> None:
    """Write with header columns; ``mode="append"`` extends a stored baseline."""
    baseline.withColumns({"version": F.lit(1), "created_at": F.current_timestamp(), "description": F.lit(description)}).write.mode(mode).parquet(path)


def load_baseline(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Size of the quantile sketches; the normalised rank error is about 2.3 / SKETCH ** 0.9, that is 0.13 %.
SKETCH = 4096
STATE = ["n", "mean", "m2", "min", "max", "cutoff_ms", "sketch", "ranks"]


def wave_states(events: DataFrame, day: Column | None = None) -> DataFrame:
    """Mergeable states of the spread per day and (prefix, origin, path), and of the collectors' ranks.

    ``n``, ``mean`` and ``m2`` (the sum of squared deviations) are moments, ``sketch`` a KLL sketch and
    ``ranks`` the sums and counts of every collector's position. Days are of the last arrival, in UTC.
    """
    s = F.col("spread_ms")
    day = F.date_format(F.timestamp_millis(F.col("last_ms").cast("long")), "yyyy-MM-dd") if day is None else day
    rows = events.withColumn("day", day)
    g = rows.groupBy("day", *GROUP).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), (F.var_pop(s) * F.count("*")).alias("m2"), F.min(s).alias("min"), F.max(s).alias("max"), F.max("last_ms").alias("cutoff_ms"), F.kll_sketch_agg_double(s, SKETCH).alias("sketch"))
    places = rows.select("day", *GROUP, F.posexplode("arrival_order").alias("pos", "collector")).groupBy("day", *GROUP, "collector").agg(F.sum("pos").alias("sum"), F.count("*").alias("n"))
    return g.join(places.groupBy("day", *GROUP).agg(F.array_sort(F.collect_list(F.struct("collector", "sum", "n"))).alias("ranks")), ["day", *GROUP])


def merged_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, std, min, max, cutoff_ms) from states of any days and finer keys.

    Deviations are taken from the joint mean before they are added, so nothing cancels. A key has
    few states, one for each day and finer key, so the join with the means repeats no rows.
    """
    mean = states.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    g = states.select(*keys, "n", "mean", "m2", "min", "max", "cutoff_ms").join(sized(mean), keys, "left").groupBy(*keys)
    g = g.agg(F.sum("n").alias("n"), F.any_value("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("cutoff_ms").alias("cutoff_ms"))
    return g.withColumn("std", F.sqrt(F.col("m2") / F.col("n"))).drop("m2")


def merged_baseline(states: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """The baseline of all the states' days, as ``build_baseline`` gives it, without the events.

    Moments and the expected order are exact; a percentile is a value whose rank is within the
    sketches' error of the one asked for, and exact while a group has at most SKETCH samples.
    """
    levels = [0.5, 0.95, 0.99]
    sketches = states.groupBy(*GROUP).agg(F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    quantiles = sketches.select(*GROUP, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, levels))).alias("q"))
    ranks = states.select(*GROUP, F.inline("ranks")).groupBy(*GROUP, "collector").agg((F.sum("sum") / F.sum("n")).alias("rank"))
    order = ranks.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "collector"))), lambda x: x["collector"]).alias("expected_order"))
    m = merged_moments(states, GROUP).where(F.col("n") >= min_samples)
    out = m.join(quantiles, GROUP).join(order, GROUP)
    return out.select(*GROUP, F.col("n").alias("sample_count"), F.col("min").alias("min_spread_ms"), *[F.col("q")[i].alias(f"p{round(x * 100)}_spread_ms") for i, x in enumerate(levels)], F.col("max").alias("max_spread_ms"), F.col("std").alias("std_dev"), F.col("cutoff_ms").alias("data_cutoff_ms"), "expected_order")


def save_states(states: DataFrame, path: str) -> None:
    """Add days to stored states; a day that is there already is replaced, other days aren't read or written."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load_states(spark, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored states of the days from ``since`` to ``until`` (both included, as text); other days' files aren't read."""
    states = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    states = states if since is None else states.where(F.col("day") >= since)
    return states if until is None else states.where(F.col("day") <= until)


def far_pairs(events: DataFrame, distances: DataFrame, key: list[str]) -> DataFrame:
    """``events`` and ``km`` of the farthest pair of known reporting collectors (null without one).

    Up to MAX_PAIRS pairs of the table (a, b, km) become a constant array, found by the collectors'
    numbers, so events are neither exploded nor shuffled. Beyond that the pairs of every distinct set
    of collectors are joined with the table once and the farthest one goes back to the events.
    """
    rows = distances.where("a < b").limit(MAX_PAIRS + 1).collect()  # 325 pairs for 26 collectors
    ids = F.array_sort(F.array_distinct("arrival_order"))
    if len(rows) > MAX_PAIRS:
        sets = events.select(ids.alias("_ids")).distinct()
        pairs = sets.select("_ids", F.explode("_ids").alias("a")).select("_ids", "a", F.explode(F.filter("_ids", lambda x: x > F.col("a"))).alias("b"))
        km = pairs.join(sized(distances.where("a < b").select("a", "b", "km")), ["a", "b"]).groupBy("_ids").agg(F.max("km").alias("km"))
        return lookup_join(events.withColumn("_ids", ids), km, ["_ids"]).drop("_ids")
    names = sorted({r[c] for r in rows for c in ("a", "b")})
    n, at = len(names), {x: i for i, x in enumerate(names)}
    flat: list[float | None] = [None] * (n * n)
    for r in rows:
        flat[at[r["a"]] * n + at[r["b"]]] = r["km"]
    if not n:
        return events.withColumn("km", F.lit(None).cast("double"))
    held, known = F.array(*map(F.lit, names)), F.array(*[F.lit(x).cast("double") for x in flat])
    numbers = F.filter(F.transform(ids, lambda a: F.array_position(held, a).cast("int") - 1), lambda i: i >= 0)
    pairs = F.flatten(F.transform(numbers, lambda i: F.transform(F.filter(numbers, lambda j: j > i), lambda j: F.get(known, i * n + j))))
    return events.withColumn("km", F.array_max(pairs))


def lookup_baseline(events: DataFrame, baseline: DataFrame, baseline_key: str = "exact") -> DataFrame:
    """Left join on (prefix, origin, path); ``baseline_key="prefix"`` takes the prefix's most-sampled entry.

    A (prefix, origin, path) has one event per slot at most, so no key of theirs is hot enough to be salted.
    """
    cols = ["sample_count", "p50_spread_ms", "p99_spread_ms", "std_dev", "expected_order"]
    if baseline_key == "exact":
        return events.join(sized(baseline.select(*GROUP, *cols)), GROUP, "left")
    top = baseline.groupBy("prefix").agg(F.max_by(F.struct(*cols), F.struct("sample_count", "origin_as", "as_path")).alias("b")).select("prefix", "b.*")
    return lookup_join(events, top, ["prefix"])


def wave_score(events: DataFrame, baseline: DataFrame, distances: DataFrame, weights: dict[str, float] | None = None, baseline_key: str = "exact") -> DataFrame:
    """Five signals, total score (capped at 1) and class (of the uncapped total); 0 and Normal without a baseline."""
    w = WEIGHTS | (weights or {})
    e = lookup_baseline(far_pairs(events, distances, GROUP), baseline, baseline_key)
    has = F.col("sample_count").isNotNull()
    signal = lambda c: F.when(has, c).otherwise(0.0)
    e = e.withColumns({
        "spread_z": signal(F.least(F.abs(S.z_score(F.col("spread_ms"), F.col("p50_spread_ms"), F.col("std_dev"))) / 3, F.lit(1.0))),
        "outlier": signal(F.when(F.col("spread_ms") > F.col("p99_spread_ms"), 1.0).otherwise(0.0)),
        "gap": signal(S.gap_ratio(F.col("times_ms"))),
        "order": signal(S.order_deviation(F.col("arrival_order"), F.col("expected_order"))),
        "speed": signal(S.propagation_speed(F.col("spread_ms"), F.col("km"))),
    })
    total = w["spread"] * F.col("spread_z") + w["outlier"] * F.col("outlier") + w["gap"] * F.col("gap") + w["order"] * F.col("order") + w["speed"] * F.col("speed")
    return e.withColumn("raw", total).withColumns({"score": F.least(F.col("raw"), F.lit(1.0)), "class": S.wave_classification(F.col("raw"))}).drop("raw")


def wave_anomalies(scored: DataFrame) -> DataFrame:
    text = F.format_string("Wave anomaly (%s): spread_z=%.2f outlier=%.2f gap_ratio=%.2f order_deviation=%.2f speed=%.2f", "class", "spread_z", "outlier", "gap", "order", "speed")
    return scored.where("class <> 'Normal'").select(F.lit("PossibleHijack").alias("anomaly_type"), "prefix", "origin_as", "slot", F.col("score").alias("confidence"), text.alias("details"), F.lit("bgp").alias("tenant_id"))


def label_case(events: DataFrame, case: dict) -> DataFrame:
    """``events`` and is_attack: the case's prefix and intruder, first arrival within its window and a second around."""
    first = F.col("first_ms")
    return events.withColumn("is_attack", (F.col("prefix") == case["prefix"]) & (F.col("origin_as") == case["hijacker_origin_as"]) & (first >= case["start_ms"] - 1000) & (first <= case["end_ms"] + 1000))


def confusion(labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: TP, FN, FP, TN, rates, fastest detection and events without a baseline; false positive rate with and without those."""
    hit, attack, bare = F.col("score") >= threshold, F.col("is_attack"), (F.col("score") == 0) & ~F.col("is_attack")
    n = lambda c: F.count_if(c)
    g = labelled.agg(n(attack & hit).alias("tp"), n(attack & ~hit).alias("fn"), n(~attack & hit).alias("fp"), n(~attack & ~hit).alias("tn"), F.min(F.when(attack & hit, F.greatest(F.col("first_ms") - F.col("start_ms"), F.lit(0.0)) / 1000)).alias("latency_s"), n(bare).alias("no_baseline"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.withColumns({"tpr": rate(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": rate(F.col("fp"), F.col("fp") + F.col("tn")), "fpr_covered": rate(F.col("fp"), F.col("fp") + F.col("tn") - F.col("no_baseline"))})


def backtest(observations: DataFrame, baseline: DataFrame, distances: DataFrame, case: dict, baseline_key: str = "prefix") -> DataFrame:
    """Score a case's period. A baseline that reaches into the incident is refused."""
    cutoff = baseline.agg(F.max("data_cutoff_ms")).first()[0]
    if cutoff is not None and cutoff >= case["start_ms"]:
        raise ValueError("the baseline's data ends after the incident begins")
    scored = wave_score(propagation(observations), baseline, distances, baseline_key=baseline_key)
    return confusion(label_case(scored, case).withColumn("start_ms", F.lit(float(case["start_ms"]))), case.get("detection_threshold", 0.5))
