"""Path-length baselines per prefix and knowledge about AS numbers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .folds import MovingAverage, scan_sorted
from .joins import lookup_join
from .storage import drop_partitions

ALPHA = 0.1
WELL_KNOWN_DAYS, FULL_DAYS = 7, 30
PATH_BOOST, PREFIX_BOOST, KNOWN_CUT, BOOST_LIMIT = 0.10, 0.05, 0.10, 0.15


def _path_lengths(events: DataFrame, value: Column | None, keys: list[str]) -> DataFrame:
    x = F.size("as_path") if value is None else value
    return events.select(*keys, "timestamp", "event_id", x.cast("double").alias("x"))


STATES, IN_TIME = "ema double, var double, n long", ["timestamp", "event_id", "x"]


def ema_baseline(events: DataFrame, value: Column | None = None, keys: list[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(keys, ema, var, n) after folding the values in order of time, as ``event_states`` does."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    keys = keys or ["prefix"]
    ends = scan_sorted(_path_lengths(events, value, keys), keys, IN_TIME, "x", MovingAverage(alpha, False), STATES, last=True)
    return ends.groupBy(*keys).agg(F.max_by(F.struct("ema", "var", "n"), "n").alias("s")).select(*keys, "s.ema", "s.var", "s.n")


def event_states(events: DataFrame, value: Column | None = None, keys: list[str] | None = None, alpha: float = ALPHA, state: str = "before") -> DataFrame:
    """(keys, timestamp, event_id, x, ema, var, n) with each event's state before or after it is folded in.

    A prefix scan: a key's rows may lie in any number of partitions. From a null value on a key has
    no mean and no variance.
    """
    keys = keys or ["prefix"]
    return scan_sorted(_path_lengths(events, value, keys), keys, IN_TIME, "x", MovingAverage(alpha, state == "before"), STATES)


def path_length_anomaly(events: DataFrame, threshold: float = 3.0, state: str = "before", alpha: float = ALPHA) -> DataFrame:
    """(prefix, event_id, timestamp, z, is_anomaly) of the path length against the prefix's baseline.

    ``state="before"`` scores a value that isn't folded in yet; with "after" and alpha 0.1 the
    score can't exceed 3, so nothing fires.
    """
    s = event_states(events, alpha=alpha, state=state)
    z = S.ema_z_score(F.col("x"), F.col("ema"), F.col("var"), F.col("n"))
    return s.select("prefix", "event_id", "timestamp", z.alias("z"), S.is_anomaly(z, threshold).alias("is_anomaly"))


def as_days_seen(events: DataFrame) -> DataFrame:
    """(origin_as, days, well_known, score) from the distinct days an AS was seen."""
    days = events.groupBy("origin_as").agg(F.countDistinct(F.to_date("timestamp")).alias("days"))
    return days.select("origin_as", "days", (F.col("days") >= WELL_KNOWN_DAYS).alias("well_known"), F.least(F.col("days") / FULL_DAYS, F.lit(1.0)).alias("score"))


def confidence_boost(path_anomaly: Column, unusual_prefix: Column, well_known: Column) -> Column:
    part = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    raw = part(path_anomaly, PATH_BOOST) + part(unusual_prefix, PREFIX_BOOST) - part(well_known, KNOWN_CUT)
    return F.greatest(F.lit(-BOOST_LIMIT), F.least(F.lit(BOOST_LIMIT), raw))


def enhance(confidence: Column, boost: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + boost))


def baseline_features(anomalies: DataFrame, paths: DataFrame, days: DataFrame) -> DataFrame:
    """Anomalies with path_anomaly, unusual_prefix and well_known attached, by event and by AS."""
    joined = anomalies.join(paths.select("event_id", F.col("is_anomaly").alias("path_anomaly")), "event_id", "left")
    joined = lookup_join(joined, days.select("origin_as", "well_known", "days"), ["origin_as"])
    return joined.withColumn("unusual_prefix", S.unusual_prefix_length(F.col("prefix")))


def enhanced(anomalies: DataFrame, paths: DataFrame, days: DataFrame) -> DataFrame:
    """Rule-based and enhanced confidence side by side."""
    f = baseline_features(anomalies, paths, days)
    f = f.withColumn("boost", confidence_boost(F.col("path_anomaly"), F.col("unusual_prefix"), F.col("well_known")))
    return f.withColumn("enhanced", enhance(F.col("confidence"), F.col("boost")))


def save_snapshot(baseline: DataFrame, path: str, day: str) -> None:
    """Write a dated snapshot; a rerun of the day replaces it."""
    baseline.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def load_snapshots(spark, path: str) -> DataFrame:
    """All snapshots below ``path``; dates stay text and prune partitions."""
    return spark.read.parquet(path).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rows of the newest date (a partition filter when read from a path)."""
    day = snapshots.agg(F.max("snapshot_date")).first()[0]
    return snapshots.where(F.col("snapshot_date") == F.lit(day))


def live_snapshots(snapshots: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Snapshots that a cleanup at ``as_of`` keeps."""
    return snapshots.where(F.to_date("snapshot_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))


def remove_snapshots(spark, path: str, as_of: str, days: int = 7) -> list[str]:
    """Delete the folders of the snapshots that ``live_snapshots`` leaves out."""
    return drop_partitions(spark, path, "snapshot_date", (date.fromisoformat(as_of) - timedelta(days=days)).isoformat())


def train(events: DataFrame, as_of, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Prefix baselines and AS knowledge from the announcements of the last days."""
    recent = events.where((F.col("event_type") == "announce") & (F.col("timestamp") >= F.lit(as_of).cast(events.schema["timestamp"].dataType) - F.expr(f"interval {days} days")))
    return ema_baseline(recent), as_days_seen(recent)
