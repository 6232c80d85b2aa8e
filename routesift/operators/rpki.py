"""Route-origin validation by nested address intervals, IRR checks and ROA differences."""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import BROADCAST_ROWS, lookup_join
from .storage import checkpointed

#: Ranges of addresses for each shuffle partition, so that hashing their numbers spreads them evenly.
PARTS = 4
#: Bound of the sample of pairs that the ranges of addresses are cut by.
SAMPLE = 10_000
LENGTH = re.compile("[0-9]{1,3}")


def vrp_index(vrps: DataFrame) -> DataFrame:
    """(family, len, net, max_length, asn, ord) of the valid entries; host bits are cut off."""
    b = vrps.withColumn("b", S.prefix_bits(F.col("prefix"))).where("b is not null and asn is not null")
    return b.select("b.family", F.col("b.plen").alias("len"), F.expr("substring(b.bits, 1, b.plen)").alias("net"), "max_length", "asn", "ord")


def covering_keys(prefixes: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
    """One row per network of a known (family, length) that may cover the prefix: (family, plen, len, net) added."""
    known = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("len")) for f, n in lengths]) if lengths else F.array().cast("array<struct<family:int,len:int>>")
    marked = prefixes.withColumn("b", S.prefix_bits(F.col("prefix")))
    tried = marked.withColumn("k", F.explode(F.filter(known, lambda k: (k["family"] == F.col("b.family")) & (k["len"] <= F.col("b.plen")))))
    return tried.select(*prefixes.columns, F.col("b.family").alias("family"), F.col("b.plen").alias("plen"), F.col("k.len").alias("len"), F.expr("substring(b.bits, 1, k.len)").alias("net"))


def span(prefix: str | None) -> tuple[int, int] | None:
    """First address of a prefix as a number whose highest byte is the family, left-aligned in 128 bits, and the length; None if it isn't valid.

    Host bits are cut off; IPv6 addresses may end in a dotted IPv4 address.
    """
    address, _, length = (prefix or "").partition("/")
    if not LENGTH.fullmatch(length):
        return None
    n, six = int(length), ":" in address
    if n > (128 if six else 32):
        return None
    try:
        raw = int.from_bytes(socket.inet_pton(socket.AF_INET6, address)) if six else int.from_bytes(socket.inet_pton(socket.AF_INET, address)) << 96
    except (OSError, ValueError):
        return None
    return (6 if six else 4) << 128 | raw >> 128 - n << 128 - n, n


SWEPT = "part int, first binary, plen int, kind int, asn long, max_length long, ord long, prefix string"
#: What stands for no maximum length and no place in the list.
NO_LENGTH, NO_PLACE = -1, -(1 << 63)


#: An IPv4 prefix, of which Arrow takes the numbers out of a whole column at once.
V4 = r"^(?P<a>[0-9]{1,3})\.(?P<b>[0-9]{1,3})\.(?P<c>[0-9]{1,3})\.(?P<d>[0-9]{1,3})/(?P<n>[0-9]{1,3})$"


def spans(prefixes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First addresses as rows of 17 bytes, family first, and lengths, -1 for what isn't valid: ``span`` for a column."""
    firsts, lengths = np.zeros((len(prefixes), 17), np.uint8), np.full(len(prefixes), -1, np.int32)
    parts = pc.extract_regex(prefixes, V4)
    shaped = pc.is_valid(parts).to_numpy(zero_copy_only=False)
    text = [pc.fill_null(t, "0") for t in parts.flatten()]
    number = [pc.cast(t, pa.int32()).to_numpy() for t in text]
    plain = [pc.equal(t, pc.cast(pc.cast(t, pa.int32()), pa.string())).to_numpy(zero_copy_only=False) for t in text[:4]]
    fine = shaped & np.logical_and.reduce(plain) & (np.maximum.reduce(number[:4]) < 256) & (number[4] <= 32)
    address = sum(n.astype(np.uint64) << np.uint64(24 - 8 * i) for i, n in enumerate(number[:4]))
    hidden = np.uint64(32) - number[4].clip(0, 32).astype(np.uint64)
    firsts[fine, 0], lengths[fine] = 4, number[4][fine]
    firsts[:, 1:5][fine] = (address >> hidden << hidden).astype(">u4").view(np.uint8).reshape(-1, 4)[fine]
    for i in np.flatnonzero(~fine):
        if (s := span(prefixes[i].as_py())) is not None:
            firsts[i], lengths[i] = np.frombuffer(s[0].to_bytes(17), np.uint8), s[1]
    return firsts, lengths


def _keys(firsts: np.ndarray, lengths: np.ndarray, asns: np.ndarray) -> np.ndarray:
    """Fixed-width bytes in the order of first address, length and AS."""
    rest = np.column_stack([lengths.astype(np.uint8)[:, None], asns.astype(">u8").view(np.uint8).reshape(-1, 8)])
    return np.ascontiguousarray(np.column_stack([firsts, rest])).view("S26").ravel()


def _ends(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The greatest key within each network."""
    bits = np.arange(1, 129)[None] > lengths[:, None]
    last = firsts | np.column_stack([np.zeros((len(firsts), 1), np.uint8), np.packbits(bits, axis=1)])
    return np.ascontiguousarray(np.column_stack([last, np.full((len(firsts), 9), 255, np.uint8)])).view("S26").ravel()


def _dealt(kind: int, cuts: np.ndarray, known: np.ndarray | None = None):
    """Rows (prefix, asn, max_length, ord), one for each of the parts that a network (kind 0) reaches into, or for a pair's own (1).

    Parts are ranges of address, length and AS, so the many origins of one prefix may lie in several.
    Networks without any of the ``known`` pairs' keys are left out.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lengths = spans(batch.column(0))
            good = np.flatnonzero(lengths >= 0)
            firsts, lengths, batch = firsts[good], lengths[good], batch.take(pa.array(good))
            if known is not None:
                inner = np.flatnonzero(known.searchsorted(_keys(firsts, np.zeros(len(good)), np.zeros(len(good)))) < known.searchsorted(_ends(firsts, lengths), "right"))
                firsts, lengths, batch = firsts[inner], lengths[inner], batch.take(pa.array(inner))
            asns = batch.column(1).to_numpy()
            low = cuts.searchsorted(_keys(firsts, lengths, asns) if kind else _keys(firsts, np.zeros(len(firsts)), np.zeros(len(firsts))), "right")
            high = low if kind else cuts.searchsorted(_ends(firsts, lengths), "right")
            rows = np.repeat(np.arange(len(low)), high - low + 1)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[rows]
            taken = batch.take(pa.array(rows))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(17), len(rows), [None, pa.py_buffer(np.ascontiguousarray(firsts[rows]))]).cast(pa.binary())
            names = taken.column(0) if kind else pa.nulls(len(rows), pa.string())
            most, place = pc.fill_null(taken.column(2), NO_LENGTH), pc.fill_null(taken.column(3), NO_PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), raw, pa.array(lengths[rows]), pa.array(np.full(len(rows), kind, np.int32)), taken.column(1), most, place, names], names=["part", "first", "plen", "kind", "asn", "max_length", "ord", "prefix"])

    return deal


class Nested:
    """The networks that hold the sweep's present address, outermost first: their last addresses, lengths and, by AS, the maximum lengths."""

    def __init__(self, mode: str) -> None:
        self.mode, self.held = mode, []

    def move(self, first: int) -> None:
        while self.held and self.held[-1][0] < first:
            self.held.pop()

    def add(self, first: int, plen: int, asn: int, most: int, place: int) -> None:
        last = first + (1 << 128 - plen) - 1
        if not self.held or self.held[-1][:2] != (last, plen):
            self.held.append((last, plen, {}))
        by_asn = self.held[-1][2]
        before, length, longest = by_asn.get(asn, (None, most, most))
        by_asn[asn] = (place, most, max(longest, most)) if before is None or place < before else (before, length, max(longest, most))

    def judge(self, plen: int, asn: int) -> str | None:
        """None without a covering network."""
        own = False
        for _, _, by_asn in reversed(self.held):
            if (hit := by_asn.get(asn)) is None:
                continue
            own = True
            if plen <= (hit[1] if self.mode == "first" else hit[2]):
                return "Valid"
            if self.mode == "first":
                break
        return "InvalidLength" if own else "InvalidAsn" if self.held else None


def _swept(mode: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nested = None, Nested(mode)
        for batch in batches:
            rows, found = [], []
            numbers = (batch.column(i).to_numpy().tolist() for i in (0, 2, 3, 4, 5, 6))
            for i, (raw, part, plen, kind, asn, most, place) in enumerate(zip(batch.column(1).to_pylist(), *numbers, strict=True)):
                if part != at:
                    at, nested = part, Nested(mode)
                first = int.from_bytes(raw)
                nested.move(first)
                if kind == 0:
                    nested.add(first, plen, asn, most, place)
                elif (status := nested.judge(plen, asn)) is not None:
                    rows.append(i)
                    found.append(status)
            taken = batch.select([7, 4]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=["prefix", "origin_as", "rpki"])

    return sweep


def validated_pairs(pairs: DataFrame, networks: DataFrame, mode: str = "first") -> DataFrame:
    """(prefix, origin_as, rpki) of the distinct pairs that some network (prefix, asn, max_length, ord) covers; both are stored.

    Networks nest, so one pass over networks and pairs sorted by first address and length keeps the
    enclosing networks as a stack. Addresses are cut into ranges at quantiles of the pairs, where they
    are few, and then networks without any pair are left out at once; else of a bounded sample of both.
    A pair goes to one range, a network to each it reaches into.
    """
    ranges = PARTS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long")
    asked = pairs.select("prefix", F.col("origin_as").alias("asn"), none.alias("max_length"), none.alias("ord"))
    some, n = asked.select("prefix", "asn"), pairs.count()
    if few := n <= BROADCAST_ROWS:
        sample = some.toPandas()  # a checked number
    else:
        some = networks.select("prefix", "asn").unionByName(some)
        sample = some.sample(min(1.0, SAMPLE / max(1, some.count())), 7).limit(2 * SAMPLE).toPandas()  # bounded
    firsts, lengths = spans(pa.array(sample["prefix"], pa.string()))
    keys = np.sort(_keys(firsts, lengths, sample["asn"].to_numpy(np.int64))[lengths >= 0])
    cuts = np.unique(keys[np.linspace(0, len(keys), ranges + 1)[1:-1].astype(int)]) if len(keys) else keys
    rows = networks.mapInArrow(_dealt(0, cuts, keys if few else None), SWEPT).unionByName(asked.mapInArrow(_dealt(1, cuts), SWEPT))
    return rows.repartition(ranges // PARTS, "part").sortWithinPartitions("part", "first", "plen", "kind").mapInArrow(_swept(mode), "prefix string, origin_as long, rpki string")


def vrp_networks(vrps: DataFrame) -> DataFrame:
    """(prefix, asn, max_length, ord) of the entries with an AS, stored once."""
    return checkpointed(vrps.where("asn is not null").select("prefix", *[F.col(c).cast("long").alias(c) for c in ("asn", "max_length", "ord")]))


def rpki_validate(events: DataFrame, vrps: DataFrame, mode: str = "first") -> DataFrame:
    """``events`` and ``rpki`` (Valid, InvalidLength, InvalidAsn, NotFound, Unavailable).

    Distinct (prefix, origin) pairs are validated once, in one sorted pass over nested intervals of
    addresses. With ``mode="first"`` the first match of the AS, most specific first and then by list
    order, decides; ``mode="any"`` is standard origin validation, where any covering match within its
    maximum length is Valid. Invalid prefixes, null ones and null origins are NotFound.
    """
    networks = vrp_networks(vrps)
    if networks.isEmpty() and vrps.isEmpty():
        return events.withColumn("rpki", F.lit("Unavailable"))
    pairs = checkpointed(events.select("prefix", F.col("origin_as").cast("long").alias("origin_as")).where("prefix is not null and origin_as is not null").distinct())
    return lookup_join(events, validated_pairs(pairs, networks, mode), ["prefix", "origin_as"]).withColumn("rpki", F.coalesce("rpki", F.lit("NotFound")))


def irr_check(events: DataFrame, routes: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``events`` and irr (Consistent, Inconsistent, NotFound, Unavailable) and irr_asns, the registered origins.

    ``failed`` holds the prefixes whose lookup failed; they are Unavailable, without origins.
    """
    known = routes.select("prefix", "origin").distinct().groupBy("prefix").agg(F.array_sort(F.collect_set("origin")).alias("irr_asns"))
    if failed is not None:
        known = known.withColumn("failed", F.lit(False)).unionByName(failed.select("prefix", F.lit(True).alias("failed")), allowMissingColumns=True)
        known = known.groupBy("prefix").agg(F.max("failed").alias("failed"), F.max("irr_asns").alias("irr_asns"))
        known = known.select("prefix", "failed", F.when(~F.col("failed"), F.col("irr_asns")).alias("irr_asns"))
    else:
        known = known.withColumn("failed", F.lit(False))
    joined = lookup_join(events, known, ["prefix"])
    lost = F.coalesce("failed", F.lit(False))
    return joined.withColumn("irr", F.when(lost, "Unavailable").when(F.col("irr_asns").isNull(), "NotFound").when(F.array_contains("irr_asns", F.col("origin_as")), "Consistent").otherwise("Inconsistent")).drop("failed")


def roa_delta(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in ``new`` (added) and only in ``known`` (removed), with the action; one grouping over both sides."""
    sides = known.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    held = sides.groupBy(*known.columns).agg(F.bool_or("_old").alias("_was"), F.bool_and("_old").alias("_gone"))
    return held.where("not _was or _gone").withColumn("action", F.when(F.col("_gone"), "removed").otherwise("added")).drop("_was", "_gone")


def roa_removed_anomalies(delta: DataFrame) -> DataFrame:
    """A possible hijack of confidence 0.65 for every removed ROA."""
    text = F.concat(F.lit("ROA removed: "), "prefix", F.lit(" AS"), F.col("origin_as").cast("string"))
    return delta.where("action = 'removed'").select(F.lit("PossibleHijack").alias("anomaly_type"), "prefix", "origin_as", F.lit(0.65).alias("confidence"), text.alias("details"))
