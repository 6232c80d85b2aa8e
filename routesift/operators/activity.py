"""Stored states of activity by day, united at query time: counts, sketches of distinct values, bitmaps of days.

A range of days is answered from one row per day (or month) and key, without the events. Counts and
days are exact; distinct values are HyperLogLog estimates, whose relative standard error is about
1.04 / sqrt(2 ** LG) and which are exact while there are few values, or, with one row per day, key
and value, exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's registers: an error of 1.6 %.
LG = 12


def day_of(time: str = "timestamp") -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def daily(events: DataFrame, key: str, distinct: str, exact: bool = False) -> DataFrame:
    """(day, key, events, sketch): the events of a key on a day and a sketch of the values of ``distinct``.

    ``exact``: (day, key, value, events), a row for each value instead of the sketch.
    """
    if exact:
        return events.groupBy(day_of().alias("day"), key, F.col(distinct).cast("string").alias("value")).agg(F.count("*").alias("events"))
    return events.groupBy(day_of().alias("day"), key).agg(F.count("*").alias("events"), F.hll_sketch_agg(F.col(distinct).cast("string"), LG).alias("sketch"))


def save_days(states: DataFrame, path: str) -> None:
    """Store states by day (or month); what is there already of these days is replaced, others aren't touched."""
    column = "day" if "day" in states.columns else "month"
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def load_days(spark, path: str, since: str, until: str, column: str = "day") -> DataFrame:
    """States of the days from ``since`` to ``until``, both included; only their folders are read."""
    return spark.read.parquet(path).withColumn(column, F.col(column).cast("string")).where(F.col(column).between(since, until))


def united(states: DataFrame, key: str, name: str = "distinct") -> DataFrame:
    """(key, events, name) over all the states' days."""
    if "value" in states.columns:
        pairs = states.groupBy(key, "value").agg(F.sum("events").alias("events"))
        return pairs.groupBy(key).agg(F.sum("events").alias("events"), F.count("value").alias(name))
    g = states.groupBy(key).agg(F.sum("events").alias("events"), F.hll_union_agg("sketch").alias("sketch"))
    return g.select(key, "events", F.hll_sketch_estimate("sketch").alias(name))


def top(states: DataFrame, key: str, name: str, limit: int = 10, least: int = 0) -> DataFrame:
    """The busiest keys of the states' days, ties by key; at most 100."""
    return united(states, key, name).where(F.col("events") > least).orderBy(F.desc("events"), key).limit(min(limit, 100))


def day_bits(events: DataFrame, key: str = "origin_as") -> DataFrame:
    """(month, key, bits): a bit for each day of the month on which the key was seen."""
    day = F.dayofmonth("timestamp")
    return events.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"), key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), day)).alias("bits"))


def days_between(bits: DataFrame, since: str, until: str, key: str = "origin_as") -> DataFrame:
    """(key, days): distinct days from ``since`` to ``until`` (both included) on which the key was seen; keys without any are left out."""
    first, last = F.lit(since[:7]), F.lit(until[:7])
    ones = F.lit((1 << 32) - 1).cast("long")
    low = F.when(F.col("month") == first, ones.bitwiseAND(F.lit(-(1 << int(since[8:]))).cast("long"))).otherwise(ones)
    high = F.when(F.col("month") == last, F.lit((1 << int(until[8:]) + 1) - 1).cast("long")).otherwise(ones)
    held = bits.where(F.col("month").between(since[:7], until[:7])).select(key, F.bit_count(F.col("bits").bitwiseAND(low).bitwiseAND(high)).cast("long").alias("n"))
    return held.groupBy(key).agg(F.sum("n").alias("days")).where("days > 0")
