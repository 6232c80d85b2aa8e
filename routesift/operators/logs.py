"""Log entries: validation, redaction, repeats, quotas, limits and usage per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .folds import RUN, fold_sorted, quiet_runs
from .joins import lookup_join
from .storage import checkpointed

LEVELS = ("debug", "info", "warn", "error")
REPEAT_TTL = 300
SOFT_SHARE = 80.0


#: Fields of an entry; strings are read as such, and once more with their kinds where a value may not be one.
FIELDS = ("level", "source", "message")
ENTRY = "struct<level:string,source:string,message:string,metadata:variant,_corrupt_record:string>"
KINDS_OF = "struct<level:variant,source:variant,message:variant>"
#: A field's name with another value than a string, or a name that may be escaped.
UNSURE = r'"(level|source|message)"\s*:\s*[^"\s]|\\u'


def validate(entries: DataFrame, column: str = "json") -> DataFrame:
    """``entries`` with level, source, message, metadata (JSON text) and errors (empty if valid, else joined with "; ").

    The JSON is parsed once, in a generator, so that later filters don't parse it again; what is
    judged are plain columns. Only texts that may hold another value than a string in a field are
    parsed a second time, for the kinds of the values. Text that isn't a JSON object is one error;
    other fields are allowed. A null text isn't an object.
    """
    kept = [c for c in entries.columns if c not in (*FIELDS, "metadata", "errors")]
    text = F.col(f"`{column}`")
    parsed = entries.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.from_json(text, ENTRY))).alias(*[f"_{f}" for f in FIELDS], "_metadata", "_corrupt"))
    unsure = text.rlike(UNSURE)
    exact = F.from_json(text, KINDS_OF)
    fields = [F.when(unsure, S.json_text(exact[f])).otherwise(F.col(f"_{f}")).alias(f) for f in FIELDS]
    bare = F.trim(text)
    whole = text.isNotNull() & F.col("_corrupt").isNull() & (bare != "") & (bare != "null")
    parsed = parsed.select(*[F.col(f"`{c}`") for c in kept], *fields, F.to_json("_metadata").alias("metadata"), whole.alias("_whole"))
    bad = F.concat_ws(
        "; ",
        F.when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "level"),
        F.when(~F.coalesce(F.length("source").between(1, 128), F.lit(False)), "source"),
        F.when(~F.coalesce(F.length("message").between(1, 8192), F.lit(False)), "message"),
        F.when((F.col("metadata") != "null") & ~F.col("metadata").startswith("{"), "metadata"),
    )
    return parsed.select(*[F.col(f"`{c}`") for c in kept], *FIELDS, "metadata", F.when(F.col("_whole"), bad).otherwise("not an object").alias("errors"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected entries."""
    return validated.where("errors = ''"), validated.where("errors <> ''")


def tenant_or_default(tenant: Column) -> Column:
    return F.coalesce(tenant, F.lit("anonymous"))


def tenant_valid(tenant: Column) -> Column:
    return F.coalesce((F.length(tenant) <= 64) & tenant.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def quota_check(requests: DataFrame, limit: Column, unit: str = "second") -> DataFrame:
    """Requests numbered per tenant and clock ``unit``, with Allowed, SoftWarning (from 80 %) or Exceeded (over 100 %)."""
    w = Window.partitionBy("tenant_id", F.date_trunc(unit, F.col("timestamp").cast("timestamp"))).orderBy("timestamp", "id")
    share = F.row_number().over(w) / limit * 100
    return requests.withColumn("share", share).withColumn("quota", F.when(F.col("share") > 100, "Exceeded").when(F.col("share") >= SOFT_SHARE, "SoftWarning").otherwise("Allowed"))


def gcra_limit(requests: DataFrame, rate: float, burst: float | None = None) -> DataFrame:
    """(tenant_id, id, timestamp, conforming): a bucket of ``burst`` that refills at ``rate`` per second.

    The fold keeps the theoretical arrival time; only conforming requests move it. After a gap of
    slack and step the bucket is full again, so a tenant's requests are folded in runs between such gaps.
    """
    step, slack = 1.0 / rate, ((burst or rate) - 1) / rate

    def start():
        tat = float("-inf")

        def take(t: float | None) -> tuple[bool | None]:
            nonlocal tat
            if t is None:
                return (None,)
            due = max(tat, t)
            ok = due - t <= slack + 1e-9
            if ok:
                tat = due + step
            return (ok,)

        return take

    t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    runs = quiet_runs(requests.select("tenant_id", "id", "timestamp", t.alias("_t")), "tenant_id", F.col("_t"), slack + step)
    return fold_sorted(runs, ["tenant_id", RUN], ["_t", "id"], "_t", start, "conforming boolean").drop("_t", RUN)


def repeat_flags(messages: DataFrame, ttl: int | None = None) -> DataFrame:
    """(id, key, is_hit): the first message of a key is a miss, later ones hits.

    With a ``ttl`` in seconds a message that long after the key's last miss is a miss again.
    """
    keyed = messages.select("id", "timestamp", S.message_key(F.col("message")).alias("key"))
    if ttl is not None:
        from .alerts import dedup_flags

        return dedup_flags(keyed, "key", "timestamp", "id", ttl).select("id", "key", (~F.col("is_new")).alias("is_hit"))
    first = keyed.groupBy("key").agg(F.min(F.struct("timestamp", "id")).alias("f")).select(F.col("f.id").alias("id"), F.lit(True).alias("is_first"))
    # joined by the unique id: a key that many messages share isn't gathered in one task
    return keyed.join(first, "id", "left").select("id", "key", F.col("is_first").isNull().alias("is_hit"))


def redact_distinct(messages: DataFrame) -> DataFrame:
    """(id, key, redacted, hits): every distinct key is redacted once, from its first message, and joined back."""
    keyed = messages.withColumn("key", S.message_key(F.col("message")))
    first = keyed.groupBy("key").agg(F.min(F.struct("timestamp", "id", "message")).alias("f"))
    once = first.select("key", F.inline(F.array(S.pii_redacted(F.col("f.message"))))).select("key", F.col("text").alias("redacted"), "hits")
    return keyed.select("id", "key").join(once, "key").select("id", "key", "redacted", "hits")


def tenant_cost(records: DataFrame) -> DataFrame:
    """Usage per tenant from (tenant_id, bytes, pii_hits, cache_hit)."""
    hit = F.col("cache_hit")
    return records.groupBy("tenant_id").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("pii_hits").alias("pii_hits"), F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("cache_misses"))


def cost_summary(cost: DataFrame) -> DataFrame:
    """Tenants and a grand total (tenant_id null) by rollup, busiest first."""
    sums = [F.sum(c).alias(c) for c in ("requests", "bytes", "pii_hits", "cache_hits", "cache_misses")]
    return cost.rollup("tenant_id").agg(*sums).orderBy(F.desc("requests"), "tenant_id")


def cost_report(cost: DataFrame) -> DataFrame:
    """One line of text per tenant, and a footer (tenant_id null) with the number of tenants."""
    line = F.format_string("Tenant: %s Requests: %d Bytes: %.1f MB PII Hits: %d", "tenant_id", "requests", F.col("bytes") / 1048576.0, "pii_hits")
    footer = cost.agg(F.format_string("Total tenants: %d", F.count("*")).alias("line")).select(F.lit(None).cast("string").alias("tenant_id"), "line")
    return cost.select("tenant_id", line.alias("line")).unionByName(footer)


def dedupe_stats(flags: DataFrame) -> DataFrame:
    g = flags.agg(F.count("*").alias("total"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
    return g.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("total")), F.lit(0.0)))


def log_pipeline(entries: DataFrame, limit: Column, unit: str = "second") -> DataFrame:
    """Sink records: validated, within quota, redacted once per distinct message, with usage.

    The allowed entries are stored once; of each key the first entry is found by an aggregate that
    combines before the shuffle, redacted, and joined back.
    """
    good = validate(entries).where("errors = ''").withColumn("tenant_id", tenant_or_default(F.col("tenant_id"))).where(tenant_valid(F.col("tenant_id")))
    allowed = quota_check(good, limit, unit).where("quota <> 'Exceeded'")
    allowed = checkpointed(allowed.select("id", "timestamp", "tenant_id", "source", "level", "message", "quota", S.message_key(F.col("message")).alias("key")))
    first = allowed.groupBy("key").agg(F.min(F.struct("timestamp", "id", "message")).alias("f"))
    redacted = first.select("key", F.col("f.id").alias("first_id"), F.inline(F.array(S.pii_redacted(F.col("f.message"))))).select("key", "first_id", F.col("text").alias("redacted_message"), F.col("hits").alias("pii_hits"))
    once = lookup_join(allowed, redacted, ["key"])
    return once.select("id", "timestamp", "tenant_id", "source", "level", "redacted_message", "pii_hits", F.octet_length("message").cast("long").alias("bytes"), (F.col("id") != F.col("first_id")).alias("cache_hit"), "quota")
