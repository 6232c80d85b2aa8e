"""Hijack and flapping detectors over route events, and how their anomalies combine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIJACK_CONFIDENCE, FLAP_CONFIDENCE = 0.85, 0.75
FLAP_SECONDS, FLAP_EVENTS, FLAP_CHANGES = 300, 50, 6

ANOMALY = ["event_id", "anomaly_type", "prefix", "origin_as", "confidence", "detected_at", "details", "tenant_id"]


def anomaly_id(kind: str = "anomaly_type"):
    """A repeatable id in place of a random one."""
    return F.sha2(F.concat_ws("|", kind, "prefix", F.col("origin_as").cast("string"), F.col("detected_at").cast("string")), 256)


def unseen(events: DataFrame, history: DataFrame | None) -> DataFrame:
    """Events whose (prefix, origin) isn't in the history."""
    return events if history is None else events.join(history.select("prefix", "origin_as").distinct(), ["prefix", "origin_as"], "left_anti")


def first_seen(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The earliest announcement of every (prefix, origin) that the history doesn't know.

    The smallest (timestamp, event_id) is an aggregate, combined before the shuffle, so a busy pair costs one row per task.
    """
    e = unseen(events.where("event_type <> 'withdraw'"), history)
    rest = [c for c in e.columns if c not in ("prefix", "origin_as", "timestamp", "event_id")]
    first = e.groupBy("prefix", "origin_as").agg(F.min(F.struct("timestamp", "event_id", *[F.col(c) for c in rest if c in ("tenant_id",)])).alias("f"))
    return first.select("prefix", "origin_as", "f.*")


def known_origins_running(events: DataFrame) -> DataFrame:
    """First sightings with the sorted origins known after each; the window runs over pairs, not events."""
    w = Window.partitionBy("prefix").orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return first_seen(events).withColumn("known", F.array_sort(F.collect_set("origin_as").over(w)))


def origin_text(prefix: Column, origin: Column, known: Column) -> Column:
    """The alert's text, with the origins known by then."""
    return F.concat(F.lit("AS"), origin.cast("string"), F.lit(" announced "), prefix, F.lit(" but known originators are: ["), F.array_join(known.cast("array<string>"), ", "), F.lit("]"))


def hijack_first_seen(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """A possible hijack for every first sighting; the first origin of a prefix fires too."""
    return first_seen(events, history).select("event_id", F.lit("PossibleHijack").alias("anomaly_type"), "prefix", "origin_as", F.lit(HIJACK_CONFIDENCE).alias("confidence"), F.col("timestamp").alias("detected_at"), "tenant_id")


def flapping(events: DataFrame, seconds: int = FLAP_SECONDS, min_events: int = FLAP_EVENTS, min_changes: int = FLAP_CHANGES) -> DataFrame:
    """Every event at which its prefix had enough events and direction changes in the sliding window.

    The window includes its bound and peers of an equal time. A prefix is cut into spans of twelve
    windows; a span also gets the events of the last window before it, as context only, so
    that the events of a hot prefix are spread over tasks by time.
    """
    length = 12 * seconds
    t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    span = F.floor(t / length)
    spans = F.array(F.struct(span.alias("at"), F.lit(True).alias("own")), F.struct((span + 1).alias("at"), F.lit(False).alias("own")))
    placed = events.withColumn("_span", F.explode(F.filter(spans, lambda x: x["own"] | (x["at"] * length - t <= seconds)))).withColumns({"_at": F.col("_span.at"), "_own": F.col("_span.own")})
    by_span = Window.partitionBy("prefix", "_at").orderBy("timestamp", "event_id")
    turned = placed.withColumn("_turn", F.coalesce((F.lag("event_type").over(by_span) != F.col("event_type")).cast("int"), F.lit(0)))
    frame = f"(partition by prefix, _at order by timestamp range between interval {seconds} seconds preceding and current row)"
    counted = turned.withColumns({"n_events": F.expr(f"count(*) over {frame}"), "n_changes": F.expr(f"sum(_turn) over {frame} - first_value(_turn) over {frame}")})
    return counted.where(F.col("_own") & (F.col("n_events") >= min_events) & (F.col("n_changes") >= min_changes)).drop("_span", "_at", "_own", "_turn")


def flapping_anomalies(flaps: DataFrame, seconds: int = FLAP_SECONDS) -> DataFrame:
    # fixed value: the wording that readers of the alerts expect
    text = F.format_string(f"Prefix %s had %d events with %d direction changes in the last {seconds} seconds", "prefix", "n_events", "n_changes")
    return flaps.select("event_id", F.lit("PrefixFlapping").alias("anomaly_type"), "prefix", "origin_as", F.lit(FLAP_CONFIDENCE).alias("confidence"), F.col("timestamp").alias("detected_at"), text.alias("details"), "tenant_id")


def hijack_enriched(validated: DataFrame) -> DataFrame:
    """Hijack confidences from events with ``rpki`` and ``irr``: new or known origin against both.

    New: 0.30 if Valid, 0.99 or 0.97 if Invalid (IRR inconsistent or not), else 0.90 or 0.85.
    Known: 0.75 or 0.60 if Invalid, else no alert. Withdrawals never alert.
    """
    firsts = first_seen(validated).select("prefix", "origin_as", "event_id").withColumn("is_new", F.lit(True))
    e = validated.where("event_type <> 'withdraw'").join(firsts, ["prefix", "origin_as", "event_id"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    invalid, odd = F.col("rpki").isin("InvalidAsn", "InvalidLength"), F.col("irr") == "Inconsistent"
    new = F.when(F.col("rpki") == "Valid", 0.30).when(invalid & odd, 0.99).when(invalid, 0.97).when(odd, 0.90).otherwise(0.85)
    known = F.when(invalid & odd, 0.75).when(invalid, 0.60)
    return e.withColumn("confidence", F.when(F.col("is_new"), new).otherwise(known)).where("confidence is not null").withColumn("anomaly_type", F.lit("PossibleHijack"))


def hijack_rpki_first(validated: DataFrame) -> DataFrame:
    """Stream policy: only RPKI-invalid announcements alert; without a VRP table plain first sightings do."""
    return hijack_enriched(validated).where(F.col("rpki").isin("InvalidAsn", "InvalidLength") | ((F.col("rpki") == "Unavailable") & F.col("is_new")))


def anomaly_union(*frames: DataFrame) -> DataFrame:
    """Anomalies of several detectors as one table; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


Detector = Callable[[DataFrame], DataFrame]


class DetectorRegistry:
    """Named detectors, each from route events to anomalies."""

    def __init__(self) -> None:
        self.detectors: dict[str, Detector] = {}

    def register(self, name: str, detector: Detector) -> None:
        if name in self.detectors:
            raise ValueError(f"detector {name!r} is registered already")
        self.detectors[name] = detector

    def run(self, events: DataFrame) -> DataFrame:
        if not self.detectors:
            raise ValueError("no detector is registered")
        return anomaly_union(*[f(events).withColumn("detector", F.lit(name)) for name, f in self.detectors.items()])
