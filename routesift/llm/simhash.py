"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into two halves of 32. Two fingerprints within three bits
differ by at most one bit in some half, so a threshold of one is enough per half. The anchors
of a half are the words of the perfect [31, 26] Hamming code, whose covering radius is one,
with the 32nd bit beside them. Every fingerprint has one home anchor per half, within the
covering radius, and is replicated to every anchor within radius plus threshold (sixteen with
its own 32nd bit, one with that bit flipped). If y is within one bit of x, the home anchor of x is
among the anchors of y, so comparing homes with all rows of an anchor finds every link.

``near_groups`` does the same for a similarity, with two wider fingerprints. A probe over a
text's distinct words, which changes least between near copies, is cut into parts of 23 bits;
the anchors of a part are the words of the perfect [23, 12] Golay code, covering radius three,
with a threshold of one bit. Rows that meet at an anchor are compared by a fingerprint of 256
bits over distinct shingles of five words, whose differing bits estimate the similarity.

Exact copies meet as one fingerprint. An anchor with more rows than a cell may hold is split
into a grid of cells (home chunks by row chunks), each compared in a task of its own. A cell
returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, connected_components, edge_batch, forest_of, lookup_join, pieces

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Homes and rows that one cell compares.
CELL_HOMES, CELL_ROWS = 1024, 4096
#: Fingerprints of null ids only are numbered from here; doc_ids are smaller.
NAMELESS = 2**62


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text in UTF-8."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pieces(texts):
        values = np.fromiter((fingerprint(t or b"") for t in binary_values(column)), np.uint64, len(column))
        yield pa.array(values.view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` and the column ``fp``, the fingerprint as a signed long. A null text is empty. A column of ``docs`` named fp is replaced."""
    return docs.drop("fp").withColumn("fp", F.arrow_udf(fingerprints, "long")("text"))


def syndromes(words: np.ndarray) -> np.ndarray:
    """Hamming syndromes of words of 31 bits: the xor of the positions (from 1) of set bits."""
    positions = np.arange(1, 32)
    out = np.zeros(len(words), np.int64)
    for bit in range(5):
        mask = int(sum(1 << (p - 1) for p in positions.tolist() if p >> bit & 1))
        out |= (np.bitwise_count(words & mask).astype(np.int64) & 1) << bit
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and home flag of every replica of the fingerprints (uint64)."""
    rows, keys, homes = [], [], []
    n = np.arange(len(fps))
    for half in (0, 1):
        word = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, top = word & 0x7FFFFFFF, word >> 31
        s = syndromes(low)
        code = np.where(s > 0, low ^ (1 << np.maximum(s - 1, 0)), low)
        key = (half << 32) | (top << 31)
        rows += [n, n]
        keys += [key | code, (key ^ (1 << 31)) | code]
        homes += [np.ones(len(n), bool), np.zeros(len(n), bool)]
        for p in range(1, 32):
            q = p ^ s
            near = (s > 0) & (q > p)  # each pair of positions whose xor is the syndrome, once
            rows.append(n[near])
            keys.append((key | (low ^ (1 << (p - 1)) ^ (1 << np.maximum(q - 1, 0))))[near])
            homes.append(np.zeros(int(near.sum()), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


ANCHORED = "anchor long, fp long, node long, home boolean"


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, nodes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        row, key, home = anchors_of(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(nodes[row]), pa.array(home)], names=["anchor", "fp", "node", "home"])


def narrow(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)


def within(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (words of 64 bits) differ in at most ``bits`` bits."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return apart <= bits


def comparison(bits: int, read: Callable[[pa.Array], np.ndarray] = narrow) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that links rows within the runs of equal (anchor, i, j); rows come sorted, homes first."""

    def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in _and_end(batches):
            now = None if batch is None else (*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5)), read(batch.column(4)))
            if held is not None:
                now = held if now is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            if now is None or not len(now[0]):
                held = None
                continue
            anchor, i, j, home, node, codes = now
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts = np.concatenate([[0], new])
            last = len(anchor) if batch is None else starts[-1]
            held = None if batch is None else tuple(x[last:] for x in now)
            ends = np.concatenate([new, [len(anchor)]])
            work = np.flatnonzero((ends - starts > 1) & home[starts].astype(bool) & (starts < last))
            edges: list[tuple[int, int]] = []
            for a, b in zip(starts[work].tolist(), ends[work].tolist(), strict=True):
                n = int(np.count_nonzero(home[a:b]))
                near = within(codes[a : a + n], codes[a:b], bits)
                if near.sum() > n:
                    edges += forest_of(node[a : a + n], node[a:b], near)
            if edges:
                yield edge_batch(edges)

    return compare_runs


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, anchored: Callable | None = None, schema: str = ANCHORED, compare: Callable | None = None) -> DataFrame:
    """Edges ``(u, v)`` between nodes, enough to connect all linked fingerprints of (fp, ..., node)."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row becomes many, so the small table is spread over more tasks than its size asks for
    rows = distinct.repartition(parts, "fp").mapInArrow(anchored or replicate, schema)
    sizes = rows.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    hot = checkpointed(sizes.where((F.col("homes") > 0) & (F.col("all") > CELL_ROWS)))
    rows = lookup_join(rows, hot, ["anchor"])
    across = F.ceil(F.coalesce("homes", F.lit(1)) / CELL_HOMES).cast("int")
    down = F.ceil(F.coalesce("all", F.lit(1)) / CELL_ROWS).cast("int")
    mixed = F.xxhash64("fp")
    chunk_i, chunk_j = F.pmod(mixed, across).cast("int"), F.pmod(F.shiftright(mixed, 17), down).cast("int")
    # a home stands, as a home, in every cell of its own chunk of homes; as a row in the cells of the other chunks
    as_home = F.filter(F.transform(F.sequence(F.lit(0), down - 1), lambda j: F.struct(chunk_i.alias("i"), j.alias("j"), F.lit(True).alias("first"))), lambda c: F.col("home"))
    as_row = F.filter(F.transform(F.sequence(F.lit(0), across - 1), lambda i: F.struct(i.alias("i"), chunk_j.alias("j"), F.lit(False).alias("first"))), lambda c: ~F.col("home") | (c["i"] != chunk_i))
    placed = rows.withColumn("c", F.explode(F.concat(as_home, as_row))).select("anchor", F.col("c.i").alias("i"), F.col("c.j").alias("j"), F.col("c.first").alias("first"), "fp", "node")
    ordered = placed.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.col("first").desc())
    return ordered.mapInArrow(compare or comparison(MAX_BITS), "u long, v long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document: ``(doc_id, fp, component_id)``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Empty, blank and
    null texts have fingerprint zero and link like any other. Repeated rows of a doc_id stay.
    A null doc_id is never a component's smallest id; a component of null ids only has a
    null component_id.
    """
    marked = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    tied = distinct.withColumn("node", F.coalesce("node", NAMELESS + F.pmod(F.xxhash64("fp"), F.lit(2**61))))
    roots = connected_components(links(tied.select("fp", "node")))
    root = F.coalesce("root", "node")
    named = checkpointed(tied.join(roots, "node", "left").select("fp", F.when(root < NAMELESS, root).alias("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: The wide fingerprint: shingle words, words of 64 bits, and differing bits up to which two texts link.
WIDE_WORDS, WIDE, WIDE_BITS = 5, 4, 46
#: Fixed value: generator polynomial of the Golay code.
GOLAY = 0b101011100011
PART, RADIUS, STEP = 23, 3, 1
#: Rows of an anchor from which on more bits name it, and the share of near copies that parts shall find.
ANCHOR_ROWS, FOUND = 16_384, 0.95
#: Share of probe bits that differ between near copies at the threshold, for the number of parts.
DRIFT = 0.09
#: Words whose hashes a task remembers before it starts anew.
MEMORY = 500_000
#: Fixed odd multipliers of the places in a shingle.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


#: Odd multipliers of the lanes: powers, so that none is a small multiple of another.
LANES = np.array([pow(PLACES[0], 3 + k, 2**64) for k in range(128)], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def majority(hashes: np.ndarray, lanes: int) -> bytes:
    """A fingerprint of ``lanes`` words of 64 bits; every lane mixes the hashes anew."""
    n = len(hashes)
    g = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(31)
    h = g[:, None] * LANES[:lanes]
    h ^= h >> np.uint64(32)
    h = np.concatenate([h, np.zeros((-n % 255, lanes), np.uint64)]).reshape(-1, 255, lanes)  # 255 bits fit a byte's count
    counts = np.empty((lanes * 8, 8), np.int64)
    for bit in range(8):
        held = ((h >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1)
        counts[:, bit] = held.view(np.uint8).reshape(-1, lanes * 8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").tobytes()


def wide_fingerprint(text: bytes, lanes: int, hashes: WordHashes, words: int = WIDE_WORDS) -> tuple[bytes, bytes]:
    """Wide fingerprint and probe of one text in UTF-8; zeros for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8 * WIDE), bytes(8 * lanes)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    if len(h) < words:
        shingles = np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    else:
        n = len(h) - words + 1
        shingles = h[:n] * np.uint64(PLACES[0])
        for i in range(1, words):
            shingles += h[i : i + n] * np.uint64(pow(PLACES[i % len(PLACES)], 1 + i // len(PLACES), 2**64))
        shingles = np.unique(shingles)
    return majority(shingles, WIDE), majority(np.unique(h), lanes)


def _remainders() -> np.ndarray:
    """Remainder of every single bit of a part by the generator polynomial."""
    out = []
    for bit in range(PART):
        x = 1 << bit
        for top in range(PART - 1, 10, -1):
            if x >> top & 1:
                x ^= GOLAY << (top - 11)
        out.append(x)
    return np.array(out, np.int64)


class Golay:
    """Anchors of words of 23 bits: the codewords within radius plus threshold, the nearest of them first."""

    def __init__(self) -> None:
        single = _remainders()
        low = np.array([0]), np.array([0])
        errors, sums = [low[0]], [low[1]]
        for weight in range(1, RADIUS + STEP + 1):
            at = np.array(list(combinations(range(PART), weight)), np.int64)
            errors.append((1 << at).sum(axis=1))
            sums.append(np.bitwise_xor.reduce(single[at], axis=1))
        self.errors, remainder = np.concatenate(errors), np.concatenate(sums)
        order = np.argsort(remainder, kind="stable")  # lightest first: one within the radius in each
        self.errors, self.counts = self.errors[order], np.bincount(remainder, minlength=2048)
        self.starts = np.cumsum(self.counts) - self.counts
        self.single = single

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, codeword and home flag of every anchor of each word."""
        remainder = np.zeros(len(words), np.int64)
        for bit in range(PART):
            remainder ^= (words >> bit & 1) * self.single[bit]
        counts = self.counts[remainder]
        ends = np.cumsum(counts)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        row = np.repeat(np.arange(len(words)), counts)
        return row, words[row] ^ self.errors[self.starts[remainder][row] + place], place == 0


def cover_of(rows: int) -> tuple[int, int]:
    """Bits beside its codeword that name an anchor, and parts, for so many rows.

    More rows need more bits, so that anchors stay small, and more parts to find as many near copies.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) * 5.3 / 4096 / ANCHOR_ROWS)))
    one = ((1 - DRIFT) ** PART + PART * DRIFT * (1 - DRIFT) ** (PART - 1)) * (1 - DRIFT) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - one))


def near_groups(docs: DataFrame, words: int = WIDE_WORDS, max_bits: int = WIDE_BITS) -> DataFrame:
    """(doc_id, group_id) of every document: groups of near duplicates by shingles of ``words`` words.

    Two texts link if their wide fingerprints differ in at most ``max_bits`` of 256 bits (39 bits are
    expected at a Jaccard similarity of 0.8, 49 at 0.7) and they meet at an anchor. The smallest doc_id
    of a group names it. Nulls, empty texts, repeated rows and null ids are as in ``simhash_components``.
    """
    extra, parts = cover_of(docs.count())
    lanes = math.ceil(PART * parts / 64)

    @F.arrow_udf("struct<wide:binary,probe:binary>")
    def marks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for column in pieces(texts):
            made = [wide_fingerprint(t or b"", lanes, hashes, words) for t in binary_values(column)]
            yield pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.binary()) for i in (0, 1)], names=["wide", "probe"])

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps, probe, nodes = batch.slice(at, 4096).columns
                bits = np.unpackbits(np.frombuffer(b"".join(probe.to_pylist()), np.uint8).reshape(len(probe), -1), axis=1, bitorder="little")[:, : PART * parts]
                cut = bits.reshape(len(bits), parts, PART) @ (1 << np.arange(PART, dtype=np.int64))
                for part in range(parts):
                    row, word, home = code.near(cut[:, part])
                    beside = np.zeros(len(cut), np.int64)
                    for k in range(extra):  # bits of the parts that follow
                        beside |= (cut[:, (part + 1 + k // PART) % parts] >> k % PART & 1) << k
                    key = (np.int64(part) << (PART + extra)) | (beside[row] << PART) | word
                    yield pa.RecordBatch.from_arrays([pa.array(key), fps.take(pa.array(row)), nodes.take(pa.array(row)), pa.array(home)], names=["anchor", "fp", "node", "home"])

    def read(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)

    marked = checkpointed(docs.select("doc_id", marks("text").alias("m")).select("doc_id", F.col("m.wide").alias("fp"), F.col("m.probe").alias("probe")))
    distinct = checkpointed(marked.groupBy("fp", "probe").agg(F.min("doc_id").alias("node")))
    tied = distinct.withColumn("node", F.coalesce("node", NAMELESS + F.pmod(F.xxhash64("fp", "probe"), F.lit(2**61))))
    edges = links(tied.select("fp", "probe", "node"), anchored, "anchor long, fp binary, node long, home boolean", comparison(max_bits, read))
    root = F.coalesce("root", "node")
    named = checkpointed(tied.join(connected_components(edges), "node", "left").select("fp", "probe", F.when(root < NAMELESS, root).alias("group_id")))
    return marked.join(named, ["fp", "probe"]).select("doc_id", "group_id")


def keep_one(docs: DataFrame, words: int = WIDE_WORDS, max_bits: int = WIDE_BITS) -> DataFrame:
    """The documents whose doc_id is the smallest of their group of near duplicates; columns as given.

    Rows that repeat a kept doc_id are that document and stay. A null doc_id stays.
    """
    out = near_groups(docs, words, max_bits).where("doc_id <> group_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti")
