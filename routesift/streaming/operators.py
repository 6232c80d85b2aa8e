"""Streaming forms of the detectors. Times are event times; watermarks bound lateness and state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import detectors as D
from ..operators import rpki as R
from ..operators.storage import checkpointed, names_in, remove, scratch, work_folder
from ..sources import readers
from . import processors as P

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows the heap belongs on disk; the stateful processors need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def timed(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The stream with ``timestamp`` as TIMESTAMP and a watermark on it."""
    return stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def hijack(stream: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """First sightings of (prefix, origin): known pairs of the history are dropped, state holds one row per pair.

    The history's pairs are stored once when the stream is built; batches read the pairs, not the
    history. Pairs are never forgotten; ``known_origins`` is the form whose state is bounded in time.
    """
    fresh = stream.where("event_type <> 'withdraw'")
    if history is not None:
        fresh = fresh.join(checkpointed(history.select("prefix", "origin_as").distinct()), ["prefix", "origin_as"], "left_anti")
    return fresh.dropDuplicates(["prefix", "origin_as"])


def known_origins(stream: DataFrame, history: DataFrame | None = None, seconds: int = 30 * 86400) -> DataFrame:
    """Announcements of an origin that its prefix hasn't shown for ``seconds``, with the origins that it has, and the alert's text.

    ``history`` (events) fills the state once, when the stream first starts; it isn't read again, and
    origins leave the state when they expire.
    """
    rows = timed(stream.where("event_type = 'announce'")).select("prefix", "timestamp", "event_id", "origin_as")
    start = None
    if history is not None:
        last = history.where("event_type = 'announce' and origin_as is not null").groupBy("prefix", "origin_as").agg(F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("at"))
        start = last.groupBy("prefix").agg(F.collect_list(F.struct(F.col("origin_as").alias("origin"), "at")).alias("origins")).groupBy("prefix")  # a prefix's own origins
    out = rows.groupBy("prefix").transformWithState(statefulProcessor=P.KnownOrigins(seconds), outputStructType="event_id long, prefix string, origin_as long, detected_us long, known array<long>", outputMode="Append", timeMode="EventTime", initialState=start)
    text = D.origin_text(F.col("prefix"), F.col("origin_as"), F.col("known"))
    return out.select("event_id", "prefix", "origin_as", F.timestamp_micros("detected_us").cast("timestamp_ntz").alias("detected_at"), "known", text.alias("details"))


def held_conditions(stream: DataFrame, condition: Column, seconds: int, minimum: int, labels: list[str], silence: int = 10) -> DataFrame:
    """(labels, state, since, until, periods): pending, firing and resolved stretches of windows whose count ``n`` holds, and silent labels.

    Events are counted by window and label; a window is judged when the watermark has passed it.
    """
    counts = timed(stream).groupBy(F.window("timestamp", f"{seconds} seconds"), *labels).agg(F.count("*").alias("n"))
    named = counts.select(F.window_time("window").alias("timestamp"), F.unix_millis("window.start").alias("bucket_ms"), *[F.col(c).cast("string").alias(f"label{i}") for i, c in enumerate(labels)], condition.alias("holds"))
    schema = ", ".join(f"label{i} string" for i in range(len(labels))) + ", state string, since_ms long, until_ms long, periods long"
    out = named.groupBy(*[f"label{i}" for i in range(len(labels))]).transformWithState(statefulProcessor=P.HeldCondition(seconds, minimum, silence), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return out.select(*[F.col(f"label{i}").alias(c) for i, c in enumerate(labels)], "state", at("since_ms").alias("since"), at("until_ms").alias("until"), "periods")


def flapping(stream: DataFrame, seconds: int = 300, min_events: int = 50, min_changes: int = 6) -> DataFrame:
    return timed(stream).groupBy("prefix").transformWithState(statefulProcessor=P.Flapping(seconds, min_events, min_changes), outputStructType="event_id long, prefix string, n_events long, n_changes long", outputMode="Append", timeMode="EventTime")


def ema(stream: DataFrame, alpha: float = 0.1, baseline: DataFrame | None = None) -> DataFrame:
    """Baseline states after every event; ``baseline`` (prefix, ema, var, n), such as a snapshot, is where keys start from."""
    rows = timed(stream).select("prefix", "timestamp", "event_id", F.size("as_path").alias("x"))
    start = None if baseline is None else baseline.select("prefix", "ema", "var", "n").groupBy("prefix")
    return rows.groupBy("prefix").transformWithState(statefulProcessor=P.Ema(alpha), outputStructType="event_id long, prefix string, ema double, var double, n long", outputMode="Append", timeMode="EventTime", initialState=start)


def anchored(stream: DataFrame, key: str, seconds: int) -> DataFrame:
    """(event_id, key, is_new) with the anchored time-to-live of repeats and alerts."""
    rows = timed(stream).select(F.col(key).alias("key"), "timestamp", "event_id")
    return rows.groupBy("key").transformWithState(statefulProcessor=P.AnchoredTtl(seconds), outputStructType="event_id long, key string, is_new boolean", outputMode="Append", timeMode="EventTime")


def token_bucket(stream: DataFrame, rate: float, burst: float | None = None, key: str = "tenant_id", ident: str = "id") -> DataFrame:
    """(key, id, conforming) of requests against a bucket of ``burst`` that refills at ``rate`` a second; as ``gcra_limit``."""
    rows = timed(stream).select(F.col(key).alias("key"), "timestamp", F.unix_micros("timestamp").alias("at_us"), F.col(ident).alias("event_id"))
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=P.TokenBucket(1.0 / rate, ((burst or rate) - 1) / rate), outputStructType="key string, event_id long, conforming boolean", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.col("event_id").alias(ident), "conforming")


def dedup_within_watermark(stream: DataFrame, key: str = "fingerprint", ttl: str = "30 minutes") -> DataFrame:
    """Cheaper, approximate deduplication: a key's first row within the watermark's span."""
    return timed(stream, ttl).dropDuplicatesWithinWatermark([key])


def propagation(observations: DataFrame, seconds: int = 10, min_collectors: int = 3, delay: str = "10 seconds") -> DataFrame:
    """Propagation events of anchored groups per (prefix, origin, path)."""
    rows = observations.withColumn("timestamp", F.timestamp_millis("arrival_ms")).withWatermark("timestamp", delay)
    rows = rows.select("prefix", "origin_as", F.array_join(F.col("as_path").cast("array<string>"), " ").alias("path"), "collector", "arrival_ms", "timestamp")
    return rows.groupBy("prefix", "origin_as", "path").transformWithState(statefulProcessor=P.Propagation(seconds, min_collectors), outputStructType="prefix string, origin_as long, path string, first_ms long, spread_ms long, arrival_order array<string>", outputMode="Append", timeMode="EventTime")


def quota(stream: DataFrame, limit: int, unit: str = "1 second") -> DataFrame:
    g = timed(stream).groupBy("tenant_id", F.window("timestamp", unit)).agg(F.count("*").alias("n"))
    return g.select("tenant_id", F.col("window.start").alias("start"), "n", F.when(F.col("n") > limit, "Exceeded").when(F.col("n") * 100 >= limit * 80, "SoftWarning").otherwise("Allowed").alias("quota"))


def timeline(stream: DataFrame, unit: str = "1 hour") -> DataFrame:
    g = timed(stream).groupBy(F.window("timestamp", unit)).agg(F.count_if(F.col("event_type") == "announce").alias("announces"), F.count_if(F.col("event_type") == "withdraw").alias("withdraws"))
    return g.select(F.col("window.start").alias("bucket"), "announces", "withdraws")


class Reloaded:
    """A table that is read anew when it is older than ``seconds``, stored once and used by all batches until then.

    A failed read keeps the last good one and is tried again after the same time. A new table
    replaces the old one's folder, which the batch before the last may still read, so two are kept.
    """

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 600, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.seconds, self.clock = load, seconds, clock
        self.table, self.read_at, self.folders, self.loads = None, float("-inf"), [], 0

    def get(self) -> DataFrame:
        now = self.clock()
        if self.table is None or now - self.read_at >= self.seconds:
            try:
                rows = self.load()
                spark = rows.sparkSession
                folder = work_folder(spark)
                rows.write.parquet(folder)
                self.table = spark.read.schema(rows.schema).parquet(folder)
                self.folders.append(folder)
                self.loads += 1
                while len(self.folders) > 2:
                    remove(spark, self.folders.pop(0))
            except Exception:
                if self.table is None:
                    raise
            self.read_at = now
        return self.table


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """Write a micro-batch to a folder of its own, so that a batch that is replayed replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def rpki_batches(load_vrps: Callable[[], DataFrame], path: str, seconds: float = 600) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: validate announcements against the VRP table, reloaded every ``seconds``, and write them by batch."""
    table = Reloaded(load_vrps, seconds)

    def each(batch: DataFrame, number: int) -> None:
        vrps = table.get()
        with scratch(batch.sparkSession):
            write_batch(R.rpki_validate(batch.where("event_type = 'announce'"), vrps), path, number)

    return each


#: Snapshots that one micro-batch may touch.
MAX_SNAPSHOTS = 1000


def roa_diff_batches(store: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over rows with a ``snapshot`` number: differences of consecutive snapshots below ``path``, by snapshot.

    Rows are stored by snapshot and batch. The differences of every snapshot that a batch touches,
    and of the one after it, are written anew from those two snapshots' folders alone, so replays and
    snapshots spread over several batches give the same result. A folder without rows is an empty one.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = sorted(r[0] for r in batch.select("snapshot").distinct().limit(MAX_SNAPSHOTS + 1).collect())
        if len(touched) > MAX_SNAPSHOTS:
            raise ValueError(f"a batch with more than {MAX_SNAPSHOTS} snapshots")
        for n in touched:
            batch.where(F.col("snapshot") == n).drop("snapshot").write.mode("overwrite").parquet(f"{store}/snapshot={n}/batch={number}")
        held = {int(name.partition("=")[2]) for name in names_in(spark, store) if name.startswith("snapshot=")}
        schema = batch.drop("snapshot").schema

        def of(k: int) -> DataFrame:
            parts = [f"{store}/snapshot={k}/{name}" for name in names_in(spark, f"{store}/snapshot={k}") if name.startswith("batch=")]
            return spark.read.schema(schema).parquet(*parts).distinct() if parts else spark.createDataFrame([], schema)

        for n in sorted({*touched, *(t + 1 for t in touched)}):
            if n <= max(held):
                R.roa_delta(of(n - 1), of(n)).write.mode("overwrite").parquet(f"{path}/snapshot={n}")

    return each


def escalations(alerts: DataFrame, resolutions: DataFrame, timeout: int = A.ESCALATE_AFTER, delay: str = "10 minutes") -> DataFrame:
    """Bumped anomalies of the alerts that turn ``timeout`` old unresolved, when the watermark has passed that age.

    ``alerts`` are rows of the history, ``resolutions`` (id, resolved_at). A timer per alert waits for
    its age, so neither a clock nor a new look at old alerts is needed, and each comes out once.
    """
    known = alerts.where(F.col("alert_type").isin("hijack", "flap"))
    rows = known.select("id", F.lit("fired").alias("kind"), F.col("fired_at").alias("timestamp"), "alert_type", "prefix", "origin_as", "confidence")
    rows = rows.unionByName(resolutions.select("id", F.lit("resolved").alias("kind"), F.col("resolved_at").alias("timestamp")), allowMissingColumns=True)
    processor = P.Escalation(timeout, A.ESCALATE_BELOW, A.BUMP, A.TOP)
    out = timed(rows, delay).groupBy("id").transformWithState(statefulProcessor=processor, outputStructType="id string, alert_type string, prefix string, origin_as long, confidence double, before double, fired_us long, due_us long", outputMode="Append", timeMode="EventTime")
    out = out.withColumn("fired_at", F.timestamp_micros("fired_us").cast("timestamp_ntz"))
    return A.bumped(out, F.col("confidence"), F.col("before"), F.timestamp_micros("due_us").cast("timestamp_ntz"))


def rerouting_batches(silences: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over escalations: those that no silence holds back now, with level and fingerprint, by batch."""

    def each(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            write_batch(A.reroute(batch, silences()), path, number)

    return each


def quarantine_batches(parse: Callable[[DataFrame], DataFrame], required: list[str], good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: parsed rows with all required fields go to ``good``, the others to ``bad``, both by batch."""

    def each(batch: DataFrame, number: int) -> None:
        for rows, path in zip(readers.quarantine(parse(batch), required), (good, bad), strict=True):
            write_batch(rows, path, number)

    return each


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all that is there and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
