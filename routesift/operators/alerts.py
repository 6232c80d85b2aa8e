"""From anomalies to alerts: fingerprints, silences, deduplication, rules, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .folds import AnchoredTimes, scan_sorted
from .joins import SALTS, lookup_join, sized
from .storage import checkpointed

TTL_SECONDS = 1800
KINDS = {"PossibleHijack": "hijack", "PrefixFlapping": "flap"}
RULE_TYPES = ("hijack", "flap", "leak", "custom")
PLANS = ("free", "pro", "enterprise")
DEFAULT_LIMIT = 1000
ESCALATE_AFTER, ESCALATE_BELOW, BUMP, TOP = 300, 0.9, 0.15, 0.95


def alert_kind(anomaly_type: Column) -> Column:
    return F.when(anomaly_type == "PossibleHijack", "hijack").when(anomaly_type == "PrefixFlapping", "flap")


def fingerprinted(anomalies: DataFrame) -> DataFrame:
    """Anomalies with level and fingerprint; those below every level are dropped."""
    level = S.escalation_level(F.col("confidence"))
    kind = alert_kind(F.col("anomaly_type"))
    return anomalies.withColumns({"level": level, "alert_type": kind, "fingerprint": S.alert_fingerprint(kind, F.col("prefix"), F.col("origin_as"))}).where("level is not null")


def latest_version(table: DataFrame, key: str = "id", version: str = "updated_at") -> DataFrame:
    """The newest row per key: one aggregate combined before the shuffle, not a window."""
    rest = [c for c in table.columns if c not in (key, version)]
    top = table.groupBy(key).agg(F.max_by(F.struct(version, *rest), version).alias("r"))
    return top.select(key, "r.*").select(table.columns)


def unsilenced(alerts: DataFrame, silences: DataFrame, time: str = "detected_at") -> DataFrame:
    """Alerts without an active silence of their fingerprint that covers their time."""
    s = sized(latest_version(silences, "id", "silenced_at").where("active").select(F.col("fingerprint").alias("sf"), F.col("silenced_at").alias("since"), F.col("expires_at").alias("until")))
    return alerts.join(s, (F.col("fingerprint") == F.col("sf")) & (F.col(time) >= F.col("since")) & (F.col(time) < F.col("until")), "left_anti")


def dedup_flags(alerts: DataFrame, key: str = "fingerprint", time: str = "detected_at", order: str = "event_id", ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, order, time, is_new): new if the last emitted one of the key is at least ``ttl`` seconds old.

    Suppressed rows don't extend the time. Every row points at the first one at least ``ttl`` later,
    and the chain of pointers from a key's first row are the new ones. Rows are sorted by ranges and
    the partitions' chains joined, so a busy key spreads over tasks, with or without quiet times.
    """
    times = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(AnchoredTimes.NONE))
    rows = alerts.select(key, order, time, times.alias("_t"))
    return scan_sorted(rows, [key], ["_t", order], "_t", AnchoredTimes(int(ttl * 1_000_000)), "is_new boolean").drop("_t")


def deduplicated(alerts: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    flags = dedup_flags(alerts, ttl=ttl).where("is_new").select("fingerprint", "event_id", "detected_at")
    return alerts.join(flags, ["fingerprint", "event_id", "detected_at"], "left_semi")


def route(anomalies: DataFrame, silences: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Level, fingerprint, silence, deduplication: the alerts to be kept and sent."""
    return deduplicated(unsilenced(fingerprinted(anomalies), silences), ttl)


def history_rows(alerts: DataFrame, rule_id: Column | None = None) -> DataFrame:
    """Rows of the alert history in status fired."""
    ident = F.sha2(F.concat_ws("|", "fingerprint", F.col("detected_at").cast("string")), 256)
    return alerts.select(ident.alias("id"), (F.lit("") if rule_id is None else rule_id).alias("rule_id"), "alert_type", "prefix", "origin_as", "confidence", F.lit("fired").alias("status"), F.col("detected_at").alias("fired_at"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))


def payload(alerts: DataFrame) -> DataFrame:
    """(event_id, payload, slack): JSON and chat line of every alert."""
    body = F.to_json(F.struct(F.lit("bgp_alert").alias("event_type"), "level", F.col("alert_type").alias("anomaly_type"), "prefix", "origin_as", "confidence", "fingerprint"))
    line = F.format_string("[%s] BGP Alert: %s AS%d confidence=%.2f", F.upper("level"), "prefix", "origin_as", "confidence")
    return alerts.select("event_id", body.alias("payload"), line.alias("slack"))


#: Rules of a tenant that one row of steps holds.
STEPS = 1000


def rule_steps(rules: DataFrame) -> DataFrame:
    """(tenant_id, thresholds, rules): per tenant, the empty text for all, ascending thresholds and the newest rule at or below each.

    Of the rules sorted by threshold only those newer than all before them can ever be the newest
    match; they are the steps. A running maximum over rule tables finds them, so a search in a sorted
    array replaces the comparison with every rule.
    """
    newest = rules.groupBy(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "threshold").agg(F.max(F.struct("updated_at", "id")).alias("rule")).where("threshold is not null")
    w = Window.partitionBy("tenant_id").orderBy("threshold")
    best = F.max("rule").over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = newest.withColumn("_best", best).where("_best is null or rule > _best")
    return steps.select("tenant_id", F.struct("threshold", "rule").alias("step"))


def rule_match(anomalies: DataFrame, rules: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, rule_id): the first matching rule per anomaly: tenant null, empty or equal, and confidence at least its threshold.

    Rules are ranked newest first; the type isn't compared. ``key`` are the columns that tell
    anomalies apart, by default event and type, so several anomalies of one event are matched each.
    An anomaly searches its tenant's steps and those of all tenants once each. Tenants' steps are
    arrays of at most STEPS items; beyond that they are joined by tenant and the searched range of
    thresholds as rows of their own.
    """
    key = key or ["event_id", "anomaly_type"]
    steps = checkpointed(rule_steps(rules))
    wide = steps.groupBy("tenant_id").count().agg(F.max("count")).first()[0] or 0
    asked = anomalies.select(*key, F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "confidence")
    if wide > STEPS:
        return _by_ranges(asked, steps, key)
    table = checkpointed(steps.groupBy("tenant_id").agg(F.array_sort(F.collect_list("step")).alias("steps")))
    everywhere = table.select(F.col("tenant_id").alias("_all"), F.col("steps").alias("all_steps"))
    placed = lookup_join(lookup_join(asked, table, ["tenant_id"], stored=True).withColumn("_all", F.lit("")), everywhere, ["_all"], stored=True)
    hit = lambda s: F.try_element_at(F.filter(F.col(s), lambda x: x["threshold"] <= F.col("confidence")), F.lit(-1))["rule"]
    found = F.greatest(hit("steps"), hit("all_steps"))
    return placed.select(*key, found["id"].alias("rule_id")).where("rule_id is not null")


def _by_ranges(asked: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """Matches by a merge of anomalies and steps in the order of thresholds, in parts of each tenant.

    The last step at or below a confidence is the running maximum of the sorted union; parts are cut
    at every STEPS-th step, and each begins with the step before it.
    """
    w = Window.partitionBy("tenant_id").orderBy("step.threshold")
    cut = steps.withColumn("_n", F.row_number().over(w)).withColumn("part", F.floor((F.col("_n") - 1) / STEPS))
    begins = cut.groupBy("tenant_id", "part").agg(F.min("step.threshold").alias("begin"))
    edges = begins.groupBy("tenant_id").agg(F.array_sort(F.collect_list("begin")).alias("edges"))  # a STEPS-th of a tenant's steps
    named = asked.withColumn("tenant_id", F.explode(F.array_distinct(F.array("tenant_id", F.lit("")))))
    placed = lookup_join(named, checkpointed(edges), ["tenant_id"], stored=True).withColumn("part", F.size(F.filter("edges", lambda e: e <= F.col("confidence"))) - 1).where("part >= 0")
    spread = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    rows = cut.select("tenant_id", "part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("step.threshold").alias("at"), F.lit(0).alias("kind"), F.col("step.rule").alias("rule"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in key])
    rows = rows.unionByName(placed.select("tenant_id", "part", spread.alias("salt"), F.col("confidence").alias("at"), F.lit(1).alias("kind"), *key), allowMissingColumns=True)
    run = Window.partitionBy("tenant_id", "part", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("rule", F.last("rule", True).over(run)).where("kind = 1")
    return found.groupBy(*key).agg(F.max("rule").alias("rule")).select(*key, F.col("rule.id").alias("rule_id"))


def bumped(due: DataFrame, confidence: Column, before: Column, escalated_at: Column) -> DataFrame:
    """Anomalies of raised confidence from alerts (id, alert_type, prefix, origin_as, fired_at) that are due."""
    kind = F.when(F.col("alert_type") == "hijack", "PossibleHijack").otherwise("PrefixFlapping")
    text = F.concat(F.lit("Auto-escalated from confidence "), before.cast("string"))
    return due.select("id", kind.alias("anomaly_type"), "prefix", "origin_as", confidence.alias("confidence"), F.col("fired_at").alias("detected_at"), escalated_at.alias("escalated_at"), text.alias("details"))


def auto_escalate(active: DataFrame, as_of, timeout: int = ESCALATE_AFTER) -> DataFrame:
    """Fired alerts of known kinds at least ``timeout`` old and below 0.9, bumped by 0.15 up to 0.95."""
    now = F.lit(as_of).cast(active.schema["fired_at"].dataType)
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6 - F.unix_micros(F.col("fired_at").cast("timestamp")) / 1e6
    due = active.where((F.col("status") == "fired") & F.col("resolved_at").isNull() & (age >= timeout) & (F.col("confidence") < ESCALATE_BELOW) & F.col("alert_type").isin("hijack", "flap"))
    return bumped(due, F.least(F.col("confidence") + BUMP, F.lit(TOP)), F.col("confidence"), now)


def escalations(alerts: DataFrame, resolutions: DataFrame, timeout: int = ESCALATE_AFTER) -> DataFrame:
    """Every alert (id, fired_at, ...) that no resolution (id, resolved_at) ended before it was ``timeout`` old, bumped at that time."""
    ended = resolutions.groupBy("id").agg(F.min("resolved_at").alias("_ended"))
    at = F.col("fired_at") + F.expr(f"interval {timeout} seconds")
    held = alerts.where((F.col("confidence") < ESCALATE_BELOW) & F.col("alert_type").isin("hijack", "flap")).join(ended, "id", "left").where(F.col("_ended").isNull() | (F.col("_ended") >= at))
    return bumped(held, F.least(F.col("confidence") + BUMP, F.lit(TOP)), F.col("confidence"), at)


def reroute(bumped: DataFrame, silences: DataFrame) -> DataFrame:
    """Bumped anomalies with level and fingerprint, but for those whose fingerprint is silenced when they escalate.

    Each alert is bumped once and alerts of a fingerprint are a deduplication time apart, so they
    aren't deduplicated again.
    """
    return unsilenced(fingerprinted(bumped), silences, "escalated_at")


def active_alerts(history: DataFrame) -> DataFrame:
    return history.where("status = 'fired' and resolved_at is null").orderBy(F.desc("fired_at"), "id")


def resolve(history: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """History with the given ids resolved at ``as_of``."""
    marked = history.join(sized(ids.select("id").distinct().withColumn("hit", F.lit(True))), "id", "left")
    return marked.withColumns({"status": F.when(F.col("hit"), "resolved").otherwise(F.col("status")), "resolved_at": F.when(F.col("hit"), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("resolved_at"))}).drop("hit")


def rules_active(rules: DataFrame) -> DataFrame:
    return latest_version(rules).where("enabled").orderBy(F.desc("updated_at"), "id")


def rule_errors() -> Column:
    """Why a new rule version isn't valid; empty if it is."""
    return F.array_compact(F.array(F.when(~F.coalesce(F.col("rule_type").isin(*RULE_TYPES), F.lit(False)), "rule_type"), F.when(~F.coalesce(F.col("threshold").between(0, 1), F.lit(False)), "threshold"), F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "name")))


def tenant_errors() -> Column:
    return F.array_compact(F.array(F.when(~F.coalesce(F.col("plan").isin(*PLANS), F.lit(False)), "plan"), F.when(~F.coalesce(F.col("rate_limit_per_sec") > 0, F.lit(False)), "rate_limit_per_sec")))


def silence_errors() -> Column:
    return F.array_compact(F.array(F.when(~F.coalesce(F.col("hours").between(1, 168), F.lit(False)), "hours"), F.when(F.coalesce(F.length("reason"), F.lit(0)) == 0, "reason")))


def upsert(table: DataFrame, changes: DataFrame, errors: Column | None = None) -> DataFrame:
    """New versions for a batch of changes: nulls keep the newest row's values; invalid results are left out.

    A soft delete is a change of ``enabled`` to false. The result is to be appended.
    """
    now = latest_version(table).alias("old")
    joined = changes.alias("c").join(now, "id", "left")
    made = joined.select("id", *[F.coalesce(F.col(f"c.{c}"), F.col(f"old.{c}")).alias(c) if c in changes.columns else F.col(f"old.{c}").alias(c) for c in table.columns if c != "id"]).select(table.columns)
    return made if errors is None else made.where(F.size(errors) == 0)


def new_silences(requests: DataFrame) -> DataFrame:
    """Silences from (id, fingerprint, reason, silenced_by, silenced_at, hours); invalid requests are left out."""
    good = requests.where(F.size(silence_errors()) == 0)
    return good.withColumns({"expires_at": F.expr("silenced_at + make_dt_interval(0, hours)"), "active": F.lit(True)}).drop("hours")


def expire_silences(silences: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """New versions, inactive as of ``as_of``, of the silences with the given ids; to be appended. Unknown ids give none."""
    now = latest_version(silences, "id", "silenced_at")
    return now.join(sized(ids.select("id").distinct()), "id", "left_semi").withColumns({"active": F.lit(False), "silenced_at": F.lit(as_of).cast(silences.schema["silenced_at"].dataType)}).select(silences.columns)


def outcome_counts(anomalies: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Counters by anomaly type, level, tenant and RPKI status.

    A resolved alert is one that turned out false: ``history`` tells which (its status is resolved
    and its type, prefix and origin are the anomaly's, its time the detection's).
    """
    counted = anomalies.withColumns({"level": S.escalation_level(F.col("confidence")), "rpki": F.coalesce("rpki", F.lit("NotFound"))})
    if history is None:
        counted = counted.withColumn("resolved", F.lit(False))
    else:
        ended = history.where("status = 'resolved'").select("alert_type", "prefix", "origin_as", F.col("fired_at").alias("detected_at"), F.lit(True).alias("resolved")).distinct()
        counted = counted.withColumn("alert_type", alert_kind(F.col("anomaly_type"))).join(ended, ["alert_type", "prefix", "origin_as", "detected_at"], "left")
    return counted.groupBy("anomaly_type", "level", "tenant_id", "rpki").agg(F.count("*").alias("n"), F.count_if(F.coalesce("resolved", F.lit(False))).alias("false_positives"))


def tenant_by_key(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests with tenant and limit of the enabled tenant that owns the key; the default limit without one."""
    known = latest_version(tenants).where("enabled").select("api_key_hash", F.col("id").alias("tenant"), F.col("rate_limit_per_sec").alias("limit"))
    return lookup_join(requests, known, ["api_key_hash"]).withColumn("limit", F.coalesce("limit", F.lit(DEFAULT_LIMIT)))
