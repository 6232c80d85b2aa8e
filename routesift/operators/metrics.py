"""Counters, histograms, rates and alert conditions over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE_BOUNDS = [i / 10 for i in range(1, 11)]
#: Latency bounds in milliseconds.
LATENCY_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0]


def histogram(df: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    """(labels, le, n): cumulative counts of values up to each bound, the last bound being infinite.

    One conditional sum per bound, so a row isn't exploded before it is counted.
    """
    le = [*bounds, float("inf")]
    sums = df.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(le)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(le)])
    return sums.select(*labels, F.explode(pairs).alias("x")).select(*labels, "x.le", "x.n")


def histogram_quantile(hist: DataFrame, q: float, labels: list[str]) -> DataFrame:
    """(labels, value): linear interpolation within the bucket that holds the quantile.

    A quantile in the infinite bucket is the last finite bound; without values it is null.
    """
    rows = F.array_sort(F.collect_list(F.struct("le", "n")))
    g = hist.groupBy(*labels).agg(rows.alias("b"))
    g = g.withColumn("rank", F.element_at("b", -1)["n"] * q).withColumn("i", F.array_position(F.transform("b", lambda x: x["n"] >= F.col("rank")), True).cast("int"))
    at = F.element_at("b", F.col("i"))
    low = F.when(F.col("i") > 1, F.element_at("b", F.greatest(F.col("i") - 1, F.lit(1)))["le"]).otherwise(0.0)
    below = F.when(F.col("i") > 1, F.element_at("b", F.greatest(F.col("i") - 1, F.lit(1)))["n"]).otherwise(0)
    value = F.when(F.col("i") == F.size("b"), F.element_at("b", -2)["le"]).otherwise(low + (at["le"] - low) * F.try_divide(F.col("rank") - below, at["n"] - below))
    return g.select(*labels, F.when(F.element_at("b", -1)["n"] > 0, value).alias("value"))


def bucket(seconds: int, time: str = "timestamp") -> Column:
    """Start of the tumbling window as TIMESTAMP_NTZ."""
    return F.window(F.col(time).cast("timestamp"), f"{seconds} seconds")["start"].cast("timestamp_ntz")


def increase(df: DataFrame, seconds: int, labels: list[str], time: str = "timestamp") -> DataFrame:
    return df.groupBy(bucket(seconds, time).alias("bucket"), *labels).agg(F.count("*").alias("n"))


def rate(df: DataFrame, seconds: int, labels: list[str], time: str = "timestamp") -> DataFrame:
    return increase(df, seconds, labels, time).withColumn("rate", F.col("n") / seconds).drop("n")


def counter_windows(samples: DataFrame, seconds: int, step: int, labels: list[str], time: str = "timestamp", value: str = "value", ties: str = "highest") -> DataFrame:
    """(labels, at, samples): the samples of every series in the ranges that end at multiples of ``step``, sorted by time.

    A range is ``seconds`` long and holds its end, not its begin. A sample is sent to each of its
    ranges by series and end, so a series of any length spreads over tasks; what is gathered is one
    series' samples of one range. Samples without a time or a value are left out, of samples at one
    time the highest counts; with ``ties="all"`` each does, in the order of their values.
    """
    t, span, every = F.unix_micros(F.col(time).cast("timestamp")), seconds * 1_000_000, step * 1_000_000
    first = F.ceil(F.col("_t") / F.lit(every)).cast("long") * every
    fine = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*labels, t.alias("_t"), F.col(value).cast("double").alias("_v"))
    ends = fine.withColumn("_first", first).withColumn("_at", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.lit(span), F.lit(every)))).where(F.col("_at") < F.col("_t") + span)
    once = ends if ties == "all" else ends.groupBy(*labels, "_at", "_t").agg(F.max("_v").alias("_v"))
    g = once.groupBy(*labels, "_at").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))).alias("samples"))
    return g.select(*labels, F.timestamp_micros("_at").cast("timestamp_ntz").alias("at"), "samples")


def counter_increase(samples: DataFrame, seconds: int, step: int, labels: list[str], time: str = "timestamp", value: str = "value", per_second: bool = False, ties: str = "highest") -> DataFrame:
    """(labels, at, increase or rate) of counters over ranges that slide by ``step``, extrapolated to the ranges' ends.

    A value below the one before is a reset to zero. Ranges with fewer than two samples give no row.
    The sampled stretch is extended to a range's begin and end if they are within 1.1 mean distances
    of samples, else by half a distance, and to the begin no further than where the counter would be zero.
    ``ties`` is as in ``counter_windows``; where all of a range's samples lie at one time the growth is NaN.
    """
    w = counter_windows(samples, seconds, step, labels, time, value, ties).where(F.size("samples") > 1)
    s = F.col("samples")
    steps = F.zip_with(F.slice(s, F.lit(2), F.size(s) - 1), F.slice(s, F.lit(1), F.size(s) - 1), lambda b, a: F.when(b["v"] < a["v"], b["v"]).otherwise(b["v"] - a["v"]))
    begin, end = s[0], F.element_at(s, -1)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    w = w.select(*labels, "at", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("_up"), ((begin["t"] - at) / 1e6 + seconds).alias("_before"), ((at - end["t"]) / 1e6).alias("_after"), ((end["t"] - begin["t"]) / 1e6).alias("_seen"), begin["v"].alias("_v"), (F.size(s) - 1).alias("_gaps"))
    mean = F.col("_seen") / F.col("_gaps")
    reach = lambda c: F.when(c >= mean * 1.1, mean / 2).otherwise(c)
    zero = F.when((F.col("_up") > 0) & (F.col("_v") >= 0), F.col("_seen") * F.col("_v") / F.col("_up"))
    grown = F.coalesce(F.try_divide(F.col("_up") * (F.col("_seen") + F.least(reach(F.col("_before")), zero) + reach(F.col("_after"))), F.col("_seen")), F.lit(float("nan")))
    return w.select(*labels, "at", (grown / seconds).alias("rate") if per_second else grown.alias("increase"))


def hit_rate_low(df: DataFrame, seconds: int, hit: Column, percent: float = 20.0) -> DataFrame:
    """Windows whose hit rate is below ``percent``."""
    g = df.groupBy(bucket(seconds).alias("bucket")).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return g.withColumn("hit_rate", F.try_divide(F.col("hits") * 100.0, F.col("total"))).where(F.col("hit_rate") < percent)


def error_ratio(df: DataFrame, seconds: int, error: Column) -> DataFrame:
    """Errors per event of each window in percent, with a small constant against division by zero."""
    g = df.groupBy(bucket(seconds).alias("bucket")).agg((F.count_if(error) / seconds).alias("errors"), (F.count("*") / seconds).alias("events"))
    return g.select("bucket", (F.col("errors") / (F.col("events") + 0.001) * 100).alias("ratio"))


def alert_for(series: DataFrame, condition: Column, seconds: int, minimum: int, labels: list[str]) -> DataFrame:
    """(labels, since, until, periods): stretches of at least ``minimum`` consecutive windows where the condition holds."""
    w = Window.partitionBy(*labels).orderBy("bucket")
    n = F.unix_seconds(F.col("bucket").cast("timestamp")) / seconds
    held = series.where(condition).withColumn("island", n - F.row_number().over(w))
    g = held.groupBy(*labels, "island").agg(F.min("bucket").alias("since"), F.max("bucket").alias("until"), F.count("*").alias("periods"))
    return g.where(F.col("periods") >= minimum).drop("island")


def absent(series: DataFrame, start, end, seconds: int) -> DataFrame:
    """Windows from ``start`` to ``end`` without any row in ``series``."""
    span = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {seconds} seconds"))
    every = series.sparkSession.range(1).select(F.explode(span).alias("bucket")).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"))
    return every.join(series.select("bucket").distinct(), "bucket", "left_anti")


def outside_band(rates: DataFrame, low: float, high: float) -> DataFrame:
    return rates.where((F.col("rate") < low) | (F.col("rate") > high))


def recording(df: DataFrame, label: str, short: int = 60, long: int = 300) -> DataFrame:
    """Both resolutions of a rate series by label, as one table to be stored."""
    return rate(df, short, [label]).withColumn("window_s", F.lit(short)).unionByName(rate(df, long, [label]).withColumn("window_s", F.lit(long)))
