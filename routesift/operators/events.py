"""Filters, projections, listings and aggregations over route events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_older

EVENT_TYPES = ("announce", "withdraw")


def scan(spark, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Event table partitioned by ``month`` (yyyymm); a time range prunes partitions and filters rows."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("month") >= int(start.strftime("%Y%m"))) & (F.col("timestamp") >= F.lit(start).cast(df.schema["timestamp"].dataType)))
    if end is not None:
        df = df.where((F.col("month") <= int(end.strftime("%Y%m"))) & (F.col("timestamp") <= F.lit(end).cast(df.schema["timestamp"].dataType)))
    return df


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write by month, rows of a month dealt by origin and sorted by (origin_as, prefix, timestamp), so that row groups can be skipped."""
    dated = df.withColumn("month", F.date_format("timestamp", "yyyyMM").cast("int"))
    dated.repartitionByRange("month", "origin_as", "prefix").sortWithinPartitions("month", "origin_as", "prefix", "timestamp").write.mode(mode).partitionBy("month").parquet(path)


def event_type_check(event_type: str) -> str:
    if event_type not in EVENT_TYPES:
        raise ValueError(f"event_type must be announce or withdraw, not {event_type!r}")
    return event_type


def event_filter(df: DataFrame, prefix: str | None = None, origin_as: int | None = None, start=None, end=None, event_type: str | None = None) -> DataFrame:
    """The AND of the conditions given; all rows without any."""
    kind = df.schema["timestamp"].dataType
    if prefix is not None:
        df = df.where(F.col("prefix") == prefix)
    if origin_as is not None:
        df = df.where(F.col("origin_as") == origin_as)
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast(kind))
    if event_type is not None:
        df = df.where(F.col("event_type") == event_type_check(event_type))
    return df


def sample_rows(df: DataFrame, rate: float, key: str = "event_id") -> DataFrame:
    """A repeatable share of rows, chosen by the first 32 bits of the MD5 of the key's text; null keys are left out."""
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(drawn < int(rate * (1 << 32)))


def top_as(df: DataFrame, limit: int = 10) -> DataFrame:
    """Origins by number of events, with exact distinct prefixes; ties by origin. At most 100."""
    return df.groupBy("origin_as").agg(F.count("*").alias("events"), F.countDistinct("prefix").alias("prefixes")).orderBy(F.desc("events"), "origin_as").limit(min(limit, 100))


def asn_prefixes(df: DataFrame, asn: int, start=None, end=None, limit: int = 100) -> DataFrame:
    out = event_filter(df, origin_as=asn, start=start, end=end).groupBy("prefix").agg(F.max("timestamp").alias("last_seen"), F.count("*").alias("events"))
    return out.orderBy(F.desc("events"), "prefix").limit(min(limit, 1000))


def flapping_prefixes(df: DataFrame, start, end, min_events: int = 10, limit: int = 20, approximate: bool = False) -> DataFrame:
    """Busiest prefixes of a period with their origins, counted exactly or approximately."""
    origins = F.approx_count_distinct("origin_as") if approximate else F.countDistinct("origin_as")
    out = event_filter(df, start=start, end=end).groupBy("prefix").agg(F.count("*").alias("events"), origins.alias("origins"))
    return out.where(F.col("events") > min_events).orderBy(F.desc("events"), "prefix").limit(limit)


def timeline(df: DataFrame, unit: str = "hour") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, F.col("timestamp").cast("timestamp")).cast("timestamp_ntz").alias("bucket")).agg(F.count_if(F.col("event_type") == "announce").alias("announces"), F.count_if(F.col("event_type") == "withdraw").alias("withdraws"))


def prefix_history(df: DataFrame, prefix: str, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest first, ties by event id; at most 1000."""
    return event_filter(df, prefix=prefix, start=start, end=end).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(min(limit, 1000))


def events_page(df: DataFrame, start=None, end=None, event_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return event_filter(df, start=start, end=end, event_type=event_type).orderBy(F.desc("timestamp"), F.desc("event_id")).offset(offset).limit(limit)


def known_origins(df: DataFrame, start=None, end=None) -> DataFrame:
    """Sorted origins per prefix in a period. Distinct pairs first, so that a set holds origins, not events."""
    return event_filter(df, start=start, end=end).select("prefix", "origin_as").distinct().groupBy("prefix").agg(F.array_sort(F.collect_set("origin_as")).alias("origins"))


def kinds(df: DataFrame) -> DataFrame:
    """Events per type."""
    return df.groupBy("event_type").agg(F.count("*").alias("n"))


def to_detector_format(df: DataFrame) -> DataFrame:
    return df.select("timestamp", "event_type", "prefix", "origin_as", "as_path", "peer_asn", F.lit("").alias("peer_ip"), F.array().cast("array<string>").alias("community"), F.lit("nats-stream").alias("source"), F.lit("bgp").alias("tenant_id"))


def log_message(event_type: Column, prefix: Column, peer_name: Column, path: Column) -> tuple[Column, Column]:
    """Level and text of the log entry for a route event."""
    announce = event_type == "announce"
    return F.when(announce, "info").otherwise("warn"), F.when(announce, F.concat(F.lit("ANNOUNCE "), prefix, F.lit(" via "), peer_name, F.lit(" (path: "), path, F.lit(")"))).otherwise(F.concat(F.lit("WITHDRAW "), prefix, F.lit(" from "), peer_name))


def retention(df: DataFrame, as_of, days: int, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column) >= F.lit(as_of).cast(df.schema[column].dataType) - F.expr(f"interval {days} days"))


def purge(spark, path: str, as_of, days: int, unit: str = "month", time: str = "timestamp") -> list[str]:
    """Remove stored events that ``retention`` leaves out: whole months (or days) by their folders, and rows of the oldest one kept."""
    first = as_of - timedelta(days=days)
    text = first.strftime("%Y%m" if unit == "month" else "%Y-%m-%d")
    return drop_older(spark, path, unit, text, F.col(time) < F.lit(first).cast("timestamp_ntz"))
