"""Readers of feeds, dumps and batches in JSON, as DataFrames of parsed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

RIS = "type string, data struct<timestamp double, id string, peer_asn string, path array<string>, announcements array<struct<next_hop string, prefixes array<string>>>, withdrawals array<string>, peer string>"
REPLAY = "event_type string, prefix string, peer_asn long, origin_as long, peer_ip string, as_path array<long>, collector string, timestamp double, community array<string>"
ENTRY = "level string, source string, message string, metadata string"
MAX_BATCH = 1000


def log_batch(texts: DataFrame, column: str = "json") -> DataFrame:
    """(pos, level, source, message, metadata) of JSON arrays of entries; larger batches than 1000 are refused whole, as is text that isn't an array."""
    items = F.from_json(column, f"array<struct<{ENTRY.replace(' string', ': string')}>>")
    fits = texts.withColumn("items", items).where(F.size("items").between(1, MAX_BATCH))
    rest = [c for c in texts.columns if c != column]
    return fits.select(*rest, F.posexplode("items").alias("pos", "e")).select(*rest, "pos", "e.*")


def ris_explode(messages: DataFrame, column: str = "json") -> DataFrame:
    """One row per announced or withdrawn prefix of every RIS message; other types and malformed text are dropped.

    The origin is the last hop, else the peer. Announcements carry the next hop as peer_ip, withdrawals the peer.
    """
    rest = [c for c in messages.columns if c != column]
    m = messages.withColumn("m", F.from_json(column, RIS)).where("m.type = 'ris_message'")
    peer = F.coalesce(F.trim("m.data.peer_asn").try_cast("long"), F.lit(0).cast("long"))
    path = S.flatten_path(F.coalesce("m.data.path", F.array().cast("array<string>")))
    m = m.select(*rest, peer.alias("peer_asn"), path.alias("as_path"), "m.data.announcements", "m.data.withdrawals", F.col("m.data.peer").alias("peer"), F.col("m.data.timestamp").alias("ts"))
    m = m.withColumn("origin_as", F.coalesce(F.element_at(F.when(F.size("as_path") > 0, F.col("as_path")), -1), "peer_asn"))
    common = [*rest, "ts", "peer_asn", "origin_as", "as_path"]
    a = m.select(*common, F.explode("announcements").alias("a")).select(*common, F.explode("a.prefixes").alias("prefix"), F.coalesce("a.next_hop", F.lit("")).alias("peer_ip"), F.lit("announce").alias("event_type"))
    w = m.select(*common, "peer", F.explode("withdrawals").alias("prefix")).select(*common, "prefix", F.coalesce("peer", F.lit("")).alias("peer_ip"), F.lit("withdraw").alias("event_type"))
    return a.unionByName(w)


ROUTE = "struct<prefix:variant,origin_as:bigint,peer_asn:bigint,event_type:variant,as_path:array<variant>,collector:variant,peer_ip:variant,community:array<string>>"


def _routes(entries: DataFrame, column: str, fields: Callable[[Column], dict[str, Column]], required: list[str], kept: list[str]) -> DataFrame:
    """The ``kept`` columns and the fields of each JSON object that has all required ones.

    The text is parsed once, in a generator, so that no filter parses it again. Whole numbers and
    strings must be such in the JSON.
    """

    def whole(r: Column) -> Column:
        out = F.lit(True)
        for f in required:
            out = out & r[f].isNotNull()
        return out

    record = S.let(F.from_json(column, ROUTE), lambda v: F.struct(*[c.alias(f) for f, c in fields(v).items()]))
    return entries.select(*kept, F.inline(F.filter(F.array(record), whole)))


def _path(v: Column) -> Column:
    ints = F.filter(v["as_path"], lambda x: F.schema_of_variant(x) == "BIGINT")
    return F.coalesce(F.transform(ints, lambda x: x.cast("long")), F.array().cast("array<bigint>"))


def extract_stream(entries: DataFrame, column: str = "metadata") -> DataFrame:
    """Route records from JSON metadata: rows without prefix, origin_as, peer_asn or event_type of the right type are dropped."""

    def fields(v: Column) -> dict[str, Column]:
        text = lambda f: S.json_text(v[f])
        return {"prefix": text("prefix"), "origin_as": v["origin_as"], "peer_asn": v["peer_asn"], "event_type": text("event_type"), "as_path": _path(v), "collector": F.coalesce(text("collector"), F.lit("unknown")), "peer_ip": F.coalesce(text("peer_ip"), F.lit(""))}

    return _routes(entries, column, fields, ["prefix", "origin_as", "peer_asn", "event_type"], [c for c in entries.columns if c != column])


def extract_log(entries: DataFrame, column: str = "metadata") -> DataFrame:
    """The same from log entries, where peer_ip is required and the entry's other columns are kept."""

    def fields(v: Column) -> dict[str, Column]:
        text = lambda f: S.json_text(v[f])
        return {"prefix": text("prefix"), "origin_as": v["origin_as"], "peer_asn": v["peer_asn"], "event_type": text("event_type"), "peer_ip": text("peer_ip"), "as_path": _path(v), "community": F.coalesce(v["community"], F.array().cast("array<string>"))}

    return _routes(entries, column, fields, ["prefix", "origin_as", "peer_asn", "event_type", "peer_ip"], [c for c in entries.columns if c != column])


def read_replay(spark, path: str) -> DataFrame:
    """Replayed archives as JSON lines; the collector comes from the path (``rrcNN``) where the row has none."""
    df = spark.read.schema(REPLAY).json(path)
    named = F.regexp_extract(F.col("_metadata.file_path"), "(rrc[0-9]{2})", 1)
    return df.withColumn("collector", F.coalesce("collector", F.when(named != "", named), F.lit("unknown"))).where("prefix is not null and event_type is not null")


def read_vrps(dump: DataFrame, column: str = "json", good: Callable[[Column], Column] = lambda prefix: S.prefix_bits(prefix).isNotNull()) -> DataFrame:
    """(prefix, max_length, asn, ord) of ``{roas: [...]}`` in list order; entries with a bad prefix or AS are skipped. Both spellings of the length are read.

    A dump may come in several rows; ``first`` is then the number of entries before a row's own.
    ``good`` says which prefixes are kept: the valid ones, unless a source has its own way to write them.
    """
    p = dump.select(F.from_json(column, "first long, roas array<struct<prefix string, maxLength int, max_length int, asn string>>").alias("p"))
    d = p.select(F.coalesce("p.first", F.lit(0)).alias("first"), F.posexplode("p.roas").alias("pos", "r")).withColumn("ord", F.col("first") + F.col("pos"))
    v = d.select("r.prefix", F.coalesce("r.maxLength", "r.max_length").alias("max_length"), S.parse_asn(F.col("r.asn")).alias("asn"), F.col("ord").cast("long").alias("ord"))
    return v.where(F.col("asn").isNotNull() & good(F.col("prefix")))


def read_roas(dump: DataFrame, column: str = "json") -> DataFrame:
    """The distinct (prefix, max_length, origin_as, trust_anchor) of a ROA export."""
    d = dump.select(F.explode(F.from_json(column, "roas array<struct<prefix string, maxLength int, max_length int, asn string, ta string>>")["roas"]).alias("r"))
    return d.select("r.prefix", F.coalesce("r.max_length", "r.maxLength").alias("max_length"), S.parse_asn(F.col("r.asn")).alias("origin_as"), F.coalesce("r.ta", F.lit("")).alias("trust_anchor")).where("prefix is not null and origin_as is not null").distinct()


def read_irr(answers: DataFrame, column: str = "json") -> DataFrame:
    """(other columns, origins) from whois JSON: AS numbers of all attributes named origin, sorted."""
    shape = "objects struct<object array<struct<attributes struct<attribute array<struct<name string, value string>>>>>>"
    items = F.flatten(F.transform(F.from_json(column, shape)["objects"]["object"], lambda o: F.coalesce(o["attributes"]["attribute"], F.array().cast("array<struct<name:string,value:string>>"))))
    origins = F.array_compact(F.transform(F.filter(items, lambda a: a["name"] == "origin"), lambda a: S.parse_asn(a["value"])))
    return answers.withColumn("origins", F.array_sort(F.array_distinct(F.coalesce(origins, F.array().cast("array<bigint>"))))).drop(column)


def read_stream(spark, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """A durable file subscription; Kafka is read with ``fmt="kafka"``. Progress is kept in the query's checkpoint."""
    reader = spark.readStream.format(fmt).options(**options)
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def quarantine(parsed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others, which are kept apart rather than dropped."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return parsed.where(whole), parsed.where(~whole)
