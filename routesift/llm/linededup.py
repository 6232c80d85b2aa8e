"""Reversible line deduplication with sharded cuckoo filters over exact reference counts.

The state is a table of exact reference counts (shard, key, documents that hold the line) and
one cuckoo filter per shard with the keys that reach ``min_docs``. Inserting documents adds to
the counts, deleting documents takes from them; keys that cross the threshold enter or leave the
filter of their shard. A line is dropped if its key is in the filter and the exact counts agree.

Filters are broadcast while their bytes are below a limit; the exact table supplies the (very
few) keys that would pass a filter wrongly, so that documents are cleaned in one pass without a
shuffle. Above the limit the lines' distinct keys are sent to their shards, each shard's filter is
probed where its keys are, and the keys that pass are held against the exact table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, lookup_join, pieces

MIN_DOCS = 10
#: Bytes of all filters and false positives that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys that one filter is sized for.
SHARD_KEYS = 1 << 17
SLOTS = 4
KICKS = 500


def key_of(line: bytes) -> bytes:
    """Sixteen bytes for the line's key, empty for an empty key."""
    line = line.strip().lower()
    return xxhash.xxh3_128_digest(line) if line else b""


def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (32 bits, never 0) and hash of keys given as rows of two uint64."""
    mark = (keys[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.where(mark == 0, np.uint32(1), mark), keys[:, 0]


def as_pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


class CuckooFilter:
    """Partial-key cuckoo hashing: buckets of four fingerprints of 32 bits, two buckets a key."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table  # (buckets, SLOTS), buckets a power of two

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        n = len(keys)
        while True:
            made = cls.sized(n)
            if made.insert(keys):
                return made
            n = max(8, 2 * n)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark, hashed = _words(keys)
        first = hashed & np.uint64(len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        mixed = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (mixed & np.uint64(len(self.table) - 1))

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; False if some key finds no place (the filter is then to be rebuilt larger)."""
        mark, first, second = self._places(keys)
        for m, a, b in zip(mark, first, second, strict=True):
            if not self._put(m, int(a), int(b)):
                return False
        return True

    def _put(self, mark: np.uint32, a: int, b: int) -> bool:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = a
        for kick in range(KICKS):
            slot = (kick * 7 + int(mark)) % SLOTS
            mark, self.table[bucket, slot] = self.table[bucket, slot], mark
            bucket = int(self._other(np.uint64(bucket), np.asarray(mark)))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        mark, first, second = self._places(keys)
        for m, a, b in zip(mark, first, second, strict=True):
            for bucket in (int(a), int(b)):
                held = np.flatnonzero(self.table[bucket] == m)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return (self.table[first.astype(np.int64)] == mark[:, None]).any(axis=1) | (self.table[second.astype(np.int64)] == mark[:, None]).any(axis=1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 1] >> np.uint64(32)).astype(np.int64) % shards


@dataclass
class LineState:
    """``counts``: (shard int, key binary, n_docs long), n_docs > 0; ``filters``: (shard int, filter binary)."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def document_keys(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct keys of each text's lines."""
    for column in pieces(texts):
        yield pa.array([list({k for line in (t or b"").split(b"\n") if (k := key_of(line))}) for t in binary_values(column)], pa.list_(pa.binary()))


def count_keys(docs: DataFrame, shards: int) -> DataFrame:
    """Documents (rows of ``docs``) per line key; the counts are combined before the shuffle."""
    keys = docs.select(F.explode(F.arrow_udf(document_keys, "array<binary>")("text")).alias("key"))
    # the high half of the key's second word, as shard_of reads it (little endian)
    word = F.conv(F.hex(F.concat(*[F.substring("key", i, 1) for i in (16, 15, 14, 13)])), 16, 10).cast("long")
    return keys.groupBy("key").agg(F.count("*").alias("n_docs")).select(F.pmod(word, F.lit(shards)).cast("int").alias("shard"), "key", "n_docs")


def _build(pairs: pa.Table) -> pa.Table:
    return pa.table({"shard": pairs.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.of(as_pairs(pairs.column("key").to_pylist())).dump()], pa.binary())})


def _update(old: pa.Table, change: pa.Table) -> pa.Table:
    keys, enters = as_pairs(change.column("key").to_pylist()), np.array(change.column("enters").to_pylist(), bool)
    now = CuckooFilter.load(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.sized(2 * max(8, int(enters.sum())))
    now.delete(keys[~enters])
    if not now.insert(keys[enters]):
        return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
    shard = (change if change.num_rows else old).column("shard").slice(0, 1)
    return pa.table({"shard": shard, "filter": pa.array([now.dump()], pa.binary())})


def build(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineState:
    """The state of a first set of documents. Shards, a power of two, follow the number of frequent keys."""
    counts = checkpointed(count_keys(docs, 1 << 20))
    if shards is None:
        frequent = counts.where(F.col("n_docs") >= min_docs).count()
        shards = min(1 << 20, 1 << (frequent // SHARD_KEYS).bit_length())
    counts = counts.withColumn("shard", F.pmod("shard", F.lit(shards)).cast("int"))
    frequent = counts.where(F.col("n_docs") >= min_docs)
    filters = checkpointed(frequent.groupBy("shard").applyInArrow(_build, "shard int, filter binary"))
    return LineState(counts, filters, shards, min_docs)


def change(state: LineState, docs: DataFrame, sign: int) -> LineState:
    """The state after inserting (sign 1) or deleting (sign -1) documents.

    Deleted documents must have been inserted before; counts never fall below zero. Filters of
    shards without a key that crosses the threshold are reused; one that overflows is rebuilt
    from the exact counts.
    """
    delta = count_keys(docs, state.shards).withColumnRenamed("n_docs", "delta")
    both = checkpointed(state.counts.join(delta, ["shard", "key"], "full").select("shard", "key", F.coalesce("n_docs", F.lit(0)).alias("old"), F.greatest(F.coalesce("n_docs", F.lit(0)) + sign * F.coalesce("delta", F.lit(0)), F.lit(0)).alias("n_docs")))
    counts = both.where("n_docs > 0").select("shard", "key", "n_docs")
    crossed = both.select("shard", "key", (F.col("old") >= state.min_docs).alias("was"), (F.col("n_docs") >= state.min_docs).alias("enters")).where("was <> enters").drop("was")
    made = state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_update, "shard int, filter binary")
    made = checkpointed(made)
    full = counts.where(F.col("n_docs") >= state.min_docs).join(made, "shard", "left_anti")
    rebuilt = full.groupBy("shard").applyInArrow(_build, "shard int, filter binary")
    return LineState(counts, checkpointed(made.unionByName(rebuilt)), state.shards, state.min_docs)


def insert(state: LineState, docs: DataFrame) -> LineState:
    return change(state, docs, 1)


def delete(state: LineState, docs: DataFrame) -> LineState:
    return change(state, docs, -1)


class Filters:
    """All shards' filters and the keys that pass them though the exact counts say no."""

    def __init__(self, filters: dict[int, bytes], wrong: frozenset[bytes], shards: int) -> None:
        self.filters, self.wrong, self.shards = filters, wrong, shards
        self.loaded: dict[int, CuckooFilter] = {}

    def passes(self, keys: list[bytes]) -> np.ndarray:
        pairs = as_pairs(keys)
        shard, out = shard_of(pairs, self.shards), np.zeros(len(keys), bool)
        for s in np.unique(shard).tolist():
            if s in self.filters:
                if s not in self.loaded:
                    self.loaded[s] = CuckooFilter.load(self.filters[s])
                at = np.flatnonzero(shard == s)
                out[at] = self.loaded[s].contains(pairs[at])
        return out

    def frequent(self, keys: list[bytes]) -> np.ndarray:
        out = self.passes(keys)
        for i in np.flatnonzero(out) if self.wrong else ():
            out[i] = keys[i] not in self.wrong
        return out


CLEANED = "struct<n_lines:long,n_dropped:long,text:string>"
_CLEANED = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def _cleaned(texts: list[bytes | None], frequent) -> pa.Array:
    lines = [(t or b"").split(b"\n") for t in texts]
    keys = [key_of(x) for doc in lines for x in doc]
    filled = [i for i, k in enumerate(keys) if k]
    drop = np.zeros(len(keys), bool)
    if filled:
        drop[filled] = frequent([keys[i] for i in filled])
    rows, at = [], 0
    for doc in lines:
        out = drop[at : at + len(doc)]
        at += len(doc)
        n = int(out.sum())
        rows.append((len(doc), n, b"\n".join(x for x, d in zip(doc, out.tolist(), strict=True) if not d) if n else b"\n".join(doc)))
    kept = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), kept], fields=list(_CLEANED))


def apply(state: LineState, docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` and a struct ``cleaned`` (n_lines, n_dropped, text).

    A null or empty text is one empty line. Lines with an empty key are never dropped. Rows of
    ``docs`` count as documents, rows of one doc_id too, and each has a result of its own. Texts are
    read whole; an empty table gives no rows. The documents must be in the state. A
    column of ``docs`` named cleaned is replaced.
    """
    sc, docs = docs.sparkSession.sparkContext, docs.drop("cleaned")
    size = state.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        blobs = {r["shard"]: bytes(r["filter"]) for r in state.filters.collect()}  # size checked
        shared, shards = sc.broadcast(blobs), state.shards

        @F.arrow_udf("boolean")
        def passes(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
            filters = Filters(shared.value, frozenset(), shards)
            for column in keys:
                yield pa.array(filters.passes(column.to_pylist()) if len(column) else [], pa.bool_())

        room = (broadcast_bytes - size) // 64 + 1
        wrong = state.counts.where(F.col("n_docs") < state.min_docs).where(passes("key")).select("key").limit(room + 1).collect()
        if len(wrong) <= room:
            exact = sc.broadcast(frozenset(bytes(r["key"]) for r in wrong))

            @F.arrow_udf(CLEANED)
            def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                filters = Filters(shared.value, exact.value, shards)
                for column in pieces(texts):
                    yield _cleaned(binary_values(column), filters.frequent)

            return docs.withColumn("cleaned", clean("text"))
    return _apply_by_shard(state, docs)


def passing(state: LineState, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (shard, key) that pass the filter of their shard; a shard's keys stream past its filter."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            shard, first, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | first[1:] | first[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                if first[a]:
                    at, held = shard[a], CuckooFilter.load(data[a].as_py())
                elif shard[a] == at:
                    part = data.slice(a, b - a)
                    hit = held.contains(as_pairs(part.to_pylist()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part], names=["shard", "key"]).filter(pa.array(hit))

    rows = state.filters.select("shard", F.lit(True).alias("first"), F.col("filter").alias("data")).unionByName(keys.select("shard", F.lit(False).alias("first"), F.col("key").alias("data")))
    return rows.repartition("shard").sortWithinPartitions("shard", F.desc("first")).mapInArrow(probe, "shard int, key binary")


def _apply_by_shard(state: LineState, docs: DataFrame) -> DataFrame:
    """Equal texts have equal results, so the keys of distinct texts are probed at their shards and held against the exact counts."""

    @F.arrow_udf("struct<id:binary,keys:array<struct<shard:int,key:binary>>>")
    def keyed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in pieces(texts):
            values = [t or b"" for t in binary_values(column)]
            ids = pa.array([xxhash.xxh3_128_digest(t) for t in values], pa.binary())
            keys = [list({k for line in t.split(b"\n") if (k := key_of(line))}) for t in values]
            flat = [k for ks in keys for k in ks]
            shards = shard_of(as_pairs(flat), state_shards).astype(np.int32) if flat else np.zeros(0, np.int32)
            items = pa.StructArray.from_arrays([pa.array(shards), pa.array(flat, pa.binary())], names=["shard", "key"])
            offsets = np.concatenate([[0], np.cumsum([len(ks) for ks in keys])]).astype(np.int32)
            yield pa.StructArray.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), items)], names=["id", "keys"])

    @F.arrow_udf(CLEANED)
    def clean(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = [_cleaned([t], lambda ks, d=frozenset(map(bytes, d or ())): np.array([k in d for k in ks], bool)) for t, d in zip(binary_values(texts), drops.to_pylist(), strict=True)]
        return pa.concat_arrays(out) if out else pa.array([], _CLEANED)

    state_shards = state.shards
    marked = docs.withColumn("_keyed", keyed("text"))
    pairs = checkpointed(marked.select(F.col("_keyed.id").alias("_id"), F.explode("_keyed.keys").alias("k")).select("_id", "k.shard", "k.key").distinct())
    exact = state.counts.where(F.col("n_docs") >= state.min_docs).select("shard", "key")
    frequent = checkpointed(passing(state, pairs.select("shard", "key").distinct()).join(exact, ["shard", "key"], "left_semi").select("key", F.lit(True).alias("_hit")))
    drops = lookup_join(pairs.select("_id", "key"), frequent, ["key"]).where("_hit").groupBy("_id").agg(F.collect_list("key").alias("_drops"))  # a text's own lines
    out = marked.withColumn("_id", F.col("_keyed.id")).join(checkpointed(drops), "_id", "left")
    return out.withColumn("cleaned", clean("text", "_drops")).select(*docs.columns, "cleaned")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Build the state of all documents and apply it to them."""
    return apply(build(docs, min_docs), docs, broadcast_bytes)
