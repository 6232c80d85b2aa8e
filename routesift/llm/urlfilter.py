"""URL filters: sorted digest arrays of rules, probed for the suffixes of a host and the beginnings of a path.

A rule is a host and the beginning of a path. Rules are kept as a sorted array of the 64-bit xxhash
digests of host and path, beside the strings themselves; the rules' hosts are an array of the same
kind, and each tells how long its rules' paths are. The arrays are written to one file that every
executor gets from Spark and maps into memory, so the workers of a machine share its pages. A batch of
URLs searches the digests of all its distinct hosts' suffixes at once (``searchsorted``), then those of
the known suffixes with the beginnings of the path, and confirms every hit by the stored string, so a
collision of digests decides nothing. The longest of the fitting rules wins.

Up to ``FILE_BYTES`` of rules make that one file. Beyond it rules are dealt to shards by a hash of host
and path, each with an array of its own, and the distinct pairs of a suffix and a beginning that the
URLs ask for are sent there once each, so that a frequent one isn't one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import write_bytes
from .common import checkpointed, lookup_join, release_memory, shared_folder

ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query: host, beginning of the path, verdict.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
#: What a URL is judged that no rule fits.
DEFAULT = ALLOW
#: Bytes of rules that are sent to every executor as one file, and that a shard holds of more.
FILE_BYTES, SHARD_BYTES = 256 << 20, 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FOUND = "struct<host:string,path:string,blocked:boolean>"
_FOUND = pa.struct([("host", pa.string()), ("path", pa.string()), ("blocked", pa.bool_())])


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _key(host: bytes, path: bytes) -> bytes:
    return host + b"\0" + path


def _padded(parts: list[np.ndarray]) -> bytes:
    return b"".join((raw := part.tobytes()) + b"\0" * (-len(raw) % 8) for part in parts)


class DigestArray:
    """Distinct strings by their sorted digests, each with a few numbers, over bytes in memory or mapped from a file."""

    def __init__(self, data: np.ndarray) -> None:
        n, numbers, text = (int(x) for x in data[:24].view(np.int64))
        at = 24

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            part = data[at : at + size].view(kind)
            at += -(-size // 8) * 8
            return part

        self.digests, self.ends, self.first = take(n, np.uint64), take(n + 1, np.int64), take(n + 1, np.int64)
        self.numbers, self.text, self.size = take(numbers, np.int64), take(text, np.uint8), at

    @staticmethod
    def pack(items: dict[bytes, list[int]]) -> bytes:
        order = sorted((xxhash.xxh64_intdigest(k), k) for k in items)
        ends, first = np.cumsum([0] + [len(k) for _, k in order]), np.cumsum([0] + [len(items[k]) for _, k in order])
        head = np.array([len(order), first[-1], ends[-1]], np.int64)
        text = np.frombuffer(b"".join(k for _, k in order), np.uint8)
        return _padded([head, np.array([d for d, _ in order], np.uint64), ends.astype(np.int64), first.astype(np.int64), np.array([x for _, k in order for x in items[k]], np.int64), text])

    def rows_of(self, names: list[bytes]) -> np.ndarray:
        """Index of the stored string that equals each name, -1 where none does. Strings of one digest are looked through in turn."""
        out = np.full(len(names), -1, np.int64)
        if not names or not len(self.digests):
            return out
        wanted = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:
                if self.text[self.ends[j] : self.ends[j + 1]].tobytes() == names[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def numbers_of(self, row: int) -> list[int]:
        return self.numbers[self.first[row] : self.first[row + 1]].tolist()


class Rules:
    """The rules' own array and that of their hosts."""

    def __init__(self, data: np.ndarray) -> None:
        self.labels = int(data[:8].view(np.int64)[0])
        self.hosts = DigestArray(data[8:])
        self.rules = DigestArray(data[8 + self.hosts.size :])

    @staticmethod
    def pack(rules: list[tuple[str, str, bool]]) -> bytes:
        """Rules (host, path, blocked), each host and path once."""
        lengths: dict[bytes, set[int]] = {}
        for host, path, _ in rules:
            lengths.setdefault(host.encode(), set()).add(len(path.encode()))
        labels = max((h.count(b".") + 1 for h in lengths), default=0)
        keys = {_key(host.encode(), path.encode()): [int(blocked)] for host, path, blocked in rules}
        return np.array([labels], np.int64).tobytes() + DigestArray.pack({h: sorted(n) for h, n in lengths.items()}) + DigestArray.pack(keys)

    def suffixes(self, host: bytes) -> list[bytes]:
        """The host and what follows its dots, no longer than the rules' hosts in labels."""
        labels = host.rsplit(b".", self.labels)
        return [b".".join(labels[i:]) for i in range(int(len(labels) > self.labels), len(labels))]

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[dict | None]:
        """The longest fitting rule of every (host, path), in code points of both; of equal ones that of the longer host."""
        tails = {h: self.suffixes(h) for h in set(hosts)}
        names = list({s for t in tails.values() for s in t})
        lengths = {s: self.hosts.numbers_of(r) for s, r in zip(names, self.hosts.rows_of(names).tolist(), strict=True) if r >= 0}
        known = {h: [s for s in t if s in lengths] for h, t in tails.items()}
        asked = [(i, s, path[:n]) for i, (host, path) in enumerate(zip(hosts, paths, strict=True)) for s in known[host] for n in lengths[s] if n <= len(path)]
        found = self.rules.rows_of([_key(s, p) for _, s, p in asked])
        out: list[dict | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        for k in np.flatnonzero(found >= 0):
            i, host, path = asked[k]
            host, path = host.decode(), path.decode()
            if (rank := (len(host) + len(path), len(host))) > best[i]:
                best[i], out[i] = rank, {"host": host, "path": path, "blocked": bool(self.rules.numbers_of(int(found[k]))[0])}
        return out


def _values(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _clean(rules: DataFrame) -> DataFrame:
    """Rules with nulls or another verdict than allow and block go, hosts are lower-cased; a pair that is both allowed and blocked is blocked."""
    fine = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK))
    fine = fine.select(F.translate("host", UPPER, LOWER).alias("host"), "path", (F.col("verdict") == BLOCK).alias("blocked"))
    return fine.groupBy("host", "path").agg(F.max("blocked").alias("blocked"))


def _by_file(pairs: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """The rule of every row from one mapped file; ``rules`` was measured to be small."""
    spark, name = pairs.sparkSession, f"rules-{uuid.uuid4().hex}.bin"
    stored = f"{shared_folder(spark)}/{name}"  # from where Spark takes it to the executors, new ones too
    write_bytes(spark, stored, Rules.pack([tuple(r) for r in rules.toPandas().itertuples(index=False)]))
    spark.sparkContext.addFile(stored)

    @F.arrow_udf(FOUND)
    def rule(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        array = Rules(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        for hosts, paths in columns:
            yield pa.array(array.judge(_values(hosts), _values(paths)), _FOUND)
        release_memory()

    return pairs.withColumn("_rule", rule(host, path))


def _by_shards(pairs: DataFrame, rules: DataFrame, shards: int) -> DataFrame:
    """(host, path, _rule) of the distinct pairs that a rule fits."""
    lengths = checkpointed(rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths")).withColumnRenamed("host", "suffix"))  # of one host
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    tailed = lookup_join(pairs.withColumn("suffix", F.explode(tails)), lengths, ["suffix"])
    begun = tailed.withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("path"))
    asked = checkpointed(begun.select("host", "path", "suffix", F.substring("path", F.lit(1), F.col("_n")).alias("begin")))
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int").alias("shard")
    held = rules.select(shard("host", "path"), F.lit(0).alias("kind"), F.col("host").alias("suffix"), F.col("path").alias("begin"), "blocked")
    wanted = asked.select(shard("suffix", "begin"), F.lit(1).alias("kind"), "suffix", "begin", F.lit(False).alias("blocked")).distinct()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, array = None, {}, None
        for batch in batches:
            runs, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(runs) | np.diff(kinds)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(runs)], strict=True):
                if runs[a] != at:
                    at, items, array = runs[a], {}, None
                part = batch.slice(a, b - a)
                keys = [_key(h, p) for h, p in zip(_values(part.column(2)), _values(part.column(3)), strict=True)]
                if kinds[a] == 0:
                    items |= {k: [int(x)] for k, x in zip(keys, part.column(4).to_pylist(), strict=True)}
                    continue
                array = array or DigestArray(np.frombuffer(DigestArray.pack(items), np.uint8))
                rows = array.rows_of(keys)
                hit = part.filter(pa.array(rows >= 0))
                blocked = pa.array([bool(array.numbers_of(r)[0]) for r in rows[rows >= 0].tolist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([hit.column(2), hit.column(3), blocked], names=["suffix", "begin", "blocked"])

    rows = held.unionByName(wanted).repartition("shard").sortWithinPartitions("shard", "kind")
    hits = checkpointed(rows.mapInArrow(probe, "suffix string, begin string, blocked boolean"))
    fitting = lookup_join(asked, hits, ["suffix", "begin"]).where("blocked is not null")
    rule = F.struct(F.col("suffix").alias("host"), F.col("begin").alias("path"), "blocked")
    return fitting.groupBy("host", "path").agg(F.max_by(rule, F.struct(F.length("suffix") + F.length("begin"), F.length("suffix"))).alias("_rule"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``pages`` and the struct ``filter`` of host, path, rule (null where none fits) and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains
    where the URL's path starts with the rule's path; the longest in code points of host and path
    wins, then the one of the longer host; what no rule fits gets the ``default``. Host is what
    follows the first ``://`` up to ``/``, ``?`` or ``#``, lower-cased (A-Z), with user and port if
    there are any; path follows up to ``?`` or ``#``. A URL that is null or without ``://`` has both
    empty. Rules with a null or another verdict are ignored; repeated rules count once, and block
    where they disagree. Every row of pages is judged, repeated ones too, texts of any length whole;
    empty tables give no rows, or only the default. A column ``filter`` of pages is replaced.
    """
    names = [F.col(f"`{c}`") for c in pages.columns if c != "filter"]
    rules = checkpointed(_clean(rules))
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0))).first()[0]
    rows = pages.select(F.struct(*names).alias("_row"), host_of(f"`{url}`").alias("host"), path_of(f"`{url}`").alias("path"))
    if size <= file_bytes:
        judged = _by_file(rows, rules, "host", "path")
    else:
        table = checkpointed(_by_shards(rows.select("host", "path").distinct(), rules, -(-size // shard_bytes)))
        judged = lookup_join(rows, table, ["host", "path"])
    text = F.concat("_rule.host", "_rule.path")
    verdict = F.when(F.col("_rule.blocked"), BLOCK).when(~F.col("_rule.blocked"), ALLOW).otherwise(default)
    return judged.select("_row.*", F.struct("host", "path", text.alias("rule"), verdict.alias("verdict")).alias("filter"))
