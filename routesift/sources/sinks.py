"""Writers: NDJSON archives, event and ROA tables, published propagation events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ndjson(records: DataFrame, path: str, compression: str = "gzip", mode: str = "append") -> None:
    """JSON lines below ``date=`` folders; tasks without rows write nothing. Codecs are those of the cluster's Hadoop (zstd needs its native library)."""
    records.withColumn("date", F.to_date("timestamp")).repartition("date", F.pmod(F.xxhash64(*records.columns[:1]), F.lit(8))).write.mode(mode).option("compression", compression).partitionBy("date").json(path)


def append_events(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Micro-batched append of route events as Parquet by month; returns the running query."""
    dated = stream.withColumn("month", F.date_format("timestamp", "yyyyMM").cast("int"))
    return dated.writeStream.format("parquet").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def append_roa_history(delta: DataFrame, path: str, as_of) -> None:
    """ROA changes with their time in milliseconds."""
    delta.withColumn("timestamp", F.date_trunc("millisecond", F.lit(as_of).cast("timestamp"))).write.mode("append").parquet(path)


def propagation_json(events: DataFrame, min_collectors: int = 3) -> DataFrame:
    """(key, value) of propagation events with enough collectors, ready for a topic."""
    fields = [c for c in ("slot", "prefix", "origin_as", "as_path", "first_ms", "last_ms", "spread_ms", "arrival_order") if c in events.columns]
    return events.where(F.col("n_collectors") >= min_collectors).select(F.col("prefix").alias("key"), F.to_json(F.struct(*fields)).alias("value"))
