"""Exact top-k inner products with a pivot-distance index.

With a further component sqrt(M - |x|^2), M the largest squared norm, all vectors have one length,
so the largest inner products with a query are its nearest vectors. Vectors are keyed by their
nearest pivot and their distance to it. The keys of a pivot, sorted by distance, form annuli
(rings). The triangle inequality bounds the distance between a query and any vector of a ring
from below: by the gap between the query's distance to the pivot and the ring, and by the gaps
to a few further reference pivots, whose nearest and farthest distances each ring keeps. Every
query expands its rings from the best bound down, in rounds; rings whose bound is below the
query's k-th score so far are never opened, which leaves the result exact.

Identical vectors beyond the k + 1 smallest ids can't be among the k best and aren't indexed.
Pivots and rings grow with the rows. Rings are cut into blocks, queries into packs of neighbouring
ones, both of bounded size; a pack is sent once for a group of the blocks it opens, with a mask of the
queries that open each, so neither a ring nor a query's copies grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SCALE = 256
K = 5
EVERY = 50
#: Bound of the sample that pivots and ring limits are taken from.
SAMPLE = 4096
#: Bounds of the pivots, of the rings of one pivot, and pivots that bound the distances of every ring.
PIVOTS, RINGS, REFERENCES = (16, 512), (2, 64), 16
BLOCK, PACK = 2048, 256
#: Blocks that a pack is sent to at a time.
GROUP = 8
#: Rings a query opens in each round; None: all whose bound still reaches its k-th score.
ROUNDS = (1, 8, None)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<double>), x = scale * embedding, of the vectors with an id and without null or non-finite components."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", x.alias("x"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None] < sizes[:, None]] = values
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """A few Lloyd steps from evenly spaced sample rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].astype(np.float64)
    for _ in range(5):
        near = distances(sample, centres).argmin(axis=1)
        for p in range(len(centres)):
            if (near == p).any():
                centres[p] = sample[near == p].mean(axis=0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the k best of every row without the query's own id; ties to smaller ids."""
    mine = ids[None, :] == own[:, None]
    rank = np.where(mine, np.iinfo(np.int64).min, scores.astype(np.int64))
    at = max(0, rank.shape[1] - k)
    row, col = np.nonzero((rank >= np.partition(rank, at, axis=1)[:, at, None]) & ~mine)
    order = np.lexsort((ids[col], -rank[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col = row[first], col[first]
    return own[row], ids[col], rank[row, col]


def top_inner_products(vectors: DataFrame, k: int = K, every: int = EVERY, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose vec_id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components, and rows without an id, take
    no part. Shorter vectors count as padded with zeros. vec_id is a key: a row with the query's
    id is never its candidate; repeated rows of another id are candidates each. Scores are exact
    integers; components so large that a score could exceed a long raise an error. An empty table
    gives no rows. Columns other than vec_id and embedding are ignored. ``stats`` is given the
    number of vectors, queries and compared pairs.
    """
    spark = vectors.sparkSession
    rough = usable(vectors)
    sizes = rough.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v) + 1, 2)))).first()
    n, width, top = sizes[2], max(1, sizes[0] or 0), (sizes[1] or 0.0) + 1
    if width * top * top >= 2**63:
        raise ValueError(f"components up to {top / SCALE:.3g} give inner products that no long holds")
    small, longest = width * top * top < 2**53, sizes[3] or 0.0
    kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
    pivot_count = int(np.clip(np.sqrt(n) / 2, *PIVOTS))
    ring_count = int(np.clip(-(-n // (pivot_count * BLOCK)), *RINGS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.floor(matrix(batch.column(1), width)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary())], names=["vec_id", "vec"])

    def read(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float64)

    def extended(m: np.ndarray) -> np.ndarray:
        """With the component that makes all lengths equal."""
        return np.column_stack([m, np.sqrt(np.maximum(longest - (m * m).sum(1), 0))])

    integers = checkpointed(rough.mapInArrow(whole, "vec_id long, vec binary"))
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if not n:
        return found.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    taken = integers.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vec").toPandas()["vec"].tolist()  # bounded
    sample = extended(read(pa.array([bytes(x) for x in taken], pa.binary())))
    pivots = choose_pivots(sample, pivot_count)
    references = pivots[:REFERENCES]
    apart = distances(sample, pivots)
    nearest = apart.argmin(axis=1)
    limits = [np.quantile(apart[nearest == p, p], np.linspace(0, 1, ring_count + 1)[1:-1]) if (nearest == p).any() else np.zeros(ring_count - 1) for p in range(len(pivots))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = extended(read(batch.column(1)))
            far = distances(m, pivots)
            p = far.argmin(axis=1)
            r = far[np.arange(len(m)), p]
            ring = np.array([np.searchsorted(limits[a], b) for a, b in zip(p, r, strict=True)], np.int32)
            refs = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(references)), pa.array(far[:, : len(references)].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p.astype(np.int32) * ring_count + ring), pa.array(r), refs], names=["vec_id", "vec", "ring", "far", "refs"])

    copies = Window.partitionBy("vec").orderBy("vec_id")
    rows = integers.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "vec")
    index = checkpointed(rows.mapInArrow(keyed, "vec_id long, vec binary, ring int, far double, refs array<double>"))
    bounds = [f(F.col("refs")[i]).alias(f"{name}{i}") for i in range(len(references)) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    facts = index.groupBy("ring").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far"), *bounds).toPandas().sort_values("ring")  # pivots x rings
    ring_ids, ring_size, ring_near, ring_far = (facts[c].to_numpy() for c in ("ring", "n", "near", "far"))
    ring_lo, ring_hi = (facts[[f"{name}{i}" for i in range(len(references))]].to_numpy() for name in ("lo", "hi"))
    of_pivot = (ring_ids // ring_count).astype(int)
    place = np.zeros(len(pivots) * ring_count, np.int64)
    place[ring_ids] = np.arange(len(ring_ids))
    parts_of = -(-ring_size // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(parts_of)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, vec_id, vec): the rows of a ring are dealt to its blocks."""
        for batch in batches:
            ring, ids = place[batch.column(2).to_numpy()], batch.column(0).to_numpy().view(np.uint64)
            part = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % parts_of[ring].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block_at[ring] + part.astype(np.int64)), *batch.columns[:2]], names=["block", "vec_id", "vec"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by their first column as one row of bytes per value; a third column holds the queries' least scores."""
        held: list = []

        def out() -> pa.RecordBatch:
            key, ids, vecs, *least = zip(*held, strict=True)
            raw = [np.array(ids, np.int64).tobytes(), b"".join(vecs), *(np.array(x, np.float64).tobytes() for x in least)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), *(pa.array([x], pa.binary()) for x in raw)], names=names[: 1 + len(raw)])

        names = ["key", "ids", "vecs", "least"]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    rows = index.select("vec_id", "vec", "ring").mapInArrow(dealt, "block long, vec_id long, vec binary").repartition("block").sortWithinPartitions("block", "vec_id")
    blocks = checkpointed(rows.mapInArrow(joined, "key long, ids binary, vecs binary").withColumnRenamed("key", "block"))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(np.column_stack([m := read(batch.column(1)), np.zeros(len(m))]), pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "vec", "pivot"])

    asking = checkpointed(integers.where(F.col("vec_id") % every == 0).mapInArrow(beside, "vec_id long, vec binary, pivot int")).withColumn("key", F.monotonically_increasing_id())
    asked_at = np.zeros(len(pivots) + 1, np.int64)
    for r in asking.groupBy("pivot").count().collect():  # one row per pivot
        asked_at[r["pivot"] + 1] = r["count"]
    asked_at = np.cumsum(asked_at)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, vec_id, vec): the queries of a pivot are dealt to neighbouring packs."""
        for batch in batches:
            near, key = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            pack = (asked_at[near] + key % np.maximum(asked_at[near + 1] - asked_at[near], 1)) // PACK
            yield pa.RecordBatch.from_arrays([pa.array(pack), *batch.columns[:2]], names=["pack", "vec_id", "vec"])

    queries = checkpointed(asking.mapInArrow(packed, "pack long, vec_id long, vec binary"))
    groups = max(1, int(block_at[-1]) // GROUP)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def opened(count: int | None):
        """(pack, block, mask, bound, pairs): blocks of the rings that queries of a pack open in a round, by bound, while they reach its k-th score."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pack, ids, vecs, raw, done in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                m, least = np.frombuffer(vecs, kind).reshape(-1, width).astype(np.float64), np.frombuffer(raw, np.float64)
                norm2 = (m * m).sum(1)[:, None]
                far = distances(np.column_stack([m, np.zeros(len(m))]), pivots)
                q = far[:, of_pivot]
                gap = np.maximum(ring_near[None] - q, q - ring_far[None])
                for i in range(len(references)):
                    gap = np.maximum(gap, np.maximum(ring_lo[None, :, i] - far[:, i, None], far[:, i, None] - ring_hi[None, :, i]))
                # the distances' rounding grows with their squares
                gap = np.maximum(0, gap - 1e-6 * (1 + q) - 1e-13 * (norm2 + longest))
                bound = np.minimum((norm2 + longest - gap * gap) / 2, np.sqrt(norm2 * longest)) + 1e-6 * (1 + longest)
                for d in done or ():  # what earlier rounds opened
                    bound[np.unpackbits(np.frombuffer(d["mask"], np.uint8), count=len(m)).astype(bool), d["ring"]] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")[:, :count]
                row, col = np.nonzero(np.take_along_axis(bound, order, 1) >= np.maximum(least, np.finfo(np.float64).min)[:, None])
                hit = np.zeros(bound.shape, bool)
                hit[row, order[row, col]] = True
                rings = np.flatnonzero(hit.any(0))
                at = np.repeat(np.arange(len(rings)), parts_of[rings])
                block = np.concatenate([np.zeros(0, np.int64), *(np.arange(block_at[r], block_at[r + 1]) for r in rings)])
                masks = [np.packbits(hit[:, r]).tobytes() for r in rings]
                pairs = hit[:, rings].sum(0) * ring_size[rings] / parts_of[rings]
                top = np.where(hit, bound, -np.inf).max(0)[rings] if len(rings) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pack)), pa.array(rings[at].astype(np.int32)), pa.array(block), pa.array([masks[i] for i in at], pa.binary()), pa.array(top[at]), pa.array(pairs[at], pa.float64())], names=["pack", "ring", "block", "mask", "bound", "pairs"])

        return choose

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, asked = np.float64 if small else np.int64, None
        for ids, vecs, mask in (r for batch in batches for i in range(batch.num_rows) for r in zip(*(c.slice(i, 1).to_pylist() for c in batch.columns), strict=True)):
            ids, vecs = np.frombuffer(ids, np.int64), np.frombuffer(vecs, kind).reshape(-1, width).astype(exact)
            if mask is None:
                asked = ids, vecs
                continue
            on = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(asked[0])).astype(bool)
            q, v, s = _top(asked[1][on] @ vecs.T, ids, asked[0][on], k)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    compared, before = 0.0, None
    for count in ROUNDS:
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
        asked = queries.join(kth, "vec_id", "left").select("pack", "vec_id", "vec", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"))
        packs = checkpointed(asked.repartition("pack").sortWithinPartitions("pack", "vec_id", "vec").mapInArrow(joined, "key long, ids binary, vecs binary, least binary").withColumnRenamed("key", "pack"))
        done = F.lit(None).cast("array<struct<ring:int,mask:binary>>")
        known = packs.withColumn("done", done) if before is None else packs.join(before.groupBy("pack").agg(F.collect_list(F.struct("ring", "mask")).alias("done")), "pack", "left")  # few rings a query
        pairs = checkpointed(known.mapInArrow(opened(count), "pack long, ring int, block long, mask binary, bound double, pairs double"))
        compared += pairs.agg(F.sum("pairs")).first()[0] or 0.0
        new = pairs.select("pack", "ring", "mask").distinct()
        before = new if before is None else before.unionByName(new)
        sent = pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
        mine = sent.select("pack", "part").distinct().join(packs, "pack").select("pack", "part", F.lit(None).cast("double").alias("bound"), "ids", "vecs", F.lit(None).cast("binary").alias("mask"))
        theirs = sent.join(blocks, "block").select("pack", "part", "bound", "ids", "vecs", "mask")
        both = mine.unionByName(theirs).repartition("pack", "part").sortWithinPartitions("pack", "part", F.desc_nulls_first("bound"))
        got = both.select("ids", "vecs", "mask").mapInArrow(compare, "query_id long, vec_id long, score long")
        ranked = found.unionByName(got).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = checkpointed(ranked).select("query_id", "vec_id", "score")
    if stats is not None:
        stats.update(vectors=int(ring_size.sum()), queries=queries.count(), compared=round(compared))
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")
