"""Hard negatives by a cover tree over norm-augmented candidates.

With a further component sqrt(M - |x|^2), M the largest squared norm, all candidates lie on one sphere,
and the inner product with an anchor is a decreasing function of the distance to it. A cover tree over
the augmented candidates has nodes whose covering radii at least halve from level to level; a node's
centre and radius bound the inner products of all rows below it from both sides.

The top of the tree is fitted on a bounded sample; every row goes to its nearest cell there, cells are
cut into blocks of neighbouring rows, and each block grows the levels below as a tree of its own. Radii
are taken from all rows. Anchors are sorted by cell and packed; a pack meets a block where, by the
cell's bounds, a row of it may lie in a window of one of the pack's anchors and beat what that window
holds. There the block's tree is descended best first: a node is left alone for the anchors whose windows
it lies outside of or whose fifth score it can't reach, and leaves are compared exactly.

Two searches use this descent: an anchor's positives (one window without limits, equal labels), then
the negatives of each positive (a window below its score, other labels). Each has a round over the best
cells, which raises the bounds, and a round over all cells that are left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .topk import SCALE, distances, matrix

POSITIVES = NEGATIVES = 5
EVERY = 100
#: A negative's score is at least this many and at most that many hundredths of the positive's.
LOW, HIGH = 80, 100
#: Bound of the sample that the top of the tree is fitted on, and bounds of its cells.
SAMPLE, CELLS = 4096, (16, 512)
#: Rows of a block, anchors of a pack, blocks that a pack is sent to at a time, rows of a leaf.
BLOCK, PACK, GROUP, LEAF = 2048, 512, 8, 64
#: Scores that are ranked at a time.
AT_ONCE = 1 << 20
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def net(points: np.ndarray, radius: float, most: int, start: int = 0) -> np.ndarray | None:
    """Indices of centres such that every point is within ``radius`` of one and centres are further apart; None if over ``most`` were needed."""
    centres = [start]
    near = distances(points, points[start : start + 1])[:, 0]
    while near.max() > radius:
        if len(centres) == most:
            return None
        centres.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[centres[-1] : centres[-1] + 1])[:, 0])
    return np.array(centres)


def top_cells(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest level of the sample's cover tree that has at most ``most`` nodes."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = np.array([0])
    radius = float(distances(sample, sample[:1]).max())
    while radius > 0 and (finer := net(sample, radius / 2, most)) is not None:
        centres, radius = finer, radius / 2
    if len(centres) < most // 4:  # the next level has far more nodes: its first ones
        near = distances(sample, sample[centres]).min(1)
        centres = centres.tolist()
        while len(centres) < most and near.max() > 0:
            centres.append(int(near.argmax()))
            near = np.minimum(near, distances(sample, sample[centres[-1:]])[:, 0])
    return sample[np.array(centres)]


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree of few points: their order, and nodes (centre, first row, end, first child, children) with rows in that order.

    A node's children have at most half its radius and are a contiguous part of it; where halving
    would need nearly as many children as leaves have room for, a node stays a leaf.
    """
    root = int(distances(points, points.mean(axis=0)[None])[:, 0].argmin())
    order = np.arange(len(points))
    nodes = [[root, 0, len(points), 0, 0]]
    for at in range(len(points) * 2):
        if at == len(nodes):
            break
        centre, first, end = nodes[at][:3]
        rows = order[first:end].copy()
        if len(rows) <= LEAF:
            continue
        here = points[rows]
        reach = float(distances(here, points[centre : centre + 1]).max())
        centres = net(here, reach / 2, max(2, len(rows) * 2 // LEAF), int(np.flatnonzero(rows == centre)[0]))
        if reach == 0 or centres is None or len(centres) < 2:
            continue
        child = distances(here, here[centres]).argmin(1)
        order[first:end] = rows[np.argsort(child, kind="stable")]
        ends = first + np.cumsum(np.bincount(child, minlength=len(centres)))
        nodes[at][3:] = len(nodes), len(centres)
        nodes += [[int(rows[c]), int(a), int(b), 0, 0] for c, a, b in zip(centres, [first, *ends[:-1]], ends, strict=True)]
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    nodes = np.array(nodes, np.int64)
    nodes[:, 0] = place[nodes[:, 0]]
    return order, nodes


def bounds(dots: np.ndarray, norm2: np.ndarray, radius: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of anchors (norm2) with rows within ``radius`` of centres whose inner products are ``dots``."""
    size2 = norm2[:, None] + longest
    far = np.sqrt(np.maximum(size2 - 2 * dots, 0))
    # rounding of squares makes near distances of large vectors uncertain
    slack = 1e-6 * (1 + far + np.sqrt(size2))
    near, out = np.maximum(far - radius[None] - slack, 0), far + radius[None] + slack
    room, more = np.sqrt(norm2)[:, None] * radius[None], 1e-6 * (1 + np.abs(dots)) + 1e-12 * size2
    return np.maximum((size2 - out * out) / 2, dots - room) - more, np.minimum((size2 - near * near) / 2, dots + room) + more


class Search:
    """A pack's windows: anchor, limits, and the k best scores so far with their ids."""

    def __init__(self, keys, own, labels, vecs, windows, same: bool, k: int, longest: float, kind: type) -> None:
        self.keys, self.own, self.labels, self.vecs = keys, own, labels, vecs
        self.anchor, self.slot, self.low, self.high, least = windows
        self.same, self.k, self.longest, self.kind = same, k, longest, kind
        self.norm2 = (vecs.astype(np.float64) ** 2).sum(1)
        self.least = least.copy()  # the k-th score
        self.scores = np.full((len(self.anchor), k), LEAST, np.int64)
        self.ids = np.full((len(self.anchor), k), MOST, np.int64)
        self.compared = 0

    def descend(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> None:
        """Best first through one block's tree."""
        dots = self.vecs.astype(np.float64) @ vecs[nodes[:, 0]].astype(np.float64).T
        low, high = (b[self.anchor] for b in bounds(dots, self.norm2, radius, self.longest))
        heap = [(-np.inf, 0)]
        while heap:
            _, at = heapq.heappop(heap)
            open_ = np.flatnonzero((high[:, at] >= np.maximum(self.least, self.low)) & (low[:, at] <= self.high))
            if not len(open_):
                continue
            _, first, end, child, children = nodes[at]
            if children:
                for c in range(child, child + children):
                    heapq.heappush(heap, (-float(high[open_, c].max()), c))
            else:
                self.verify(open_, ids[first:end], labels[first:end], vecs[first:end])

    def verify(self, windows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        """Compare windows with all rows of a leaf exactly."""
        step = max(1, AT_ONCE // (len(ids) + self.k))
        for part in (windows[i : i + step] for i in range(0, len(windows), step)):
            anchors, back = np.unique(self.anchor[part], return_inverse=True)
            self.compared += len(anchors) * len(ids)
            scores = (self.vecs[anchors].astype(self.kind) @ vecs.astype(self.kind).T).astype(np.int64)
            fits = (self.labels[anchors][:, None] == labels[None]) == self.same
            scores[~fits | (self.own[anchors][:, None] == ids[None])] = LEAST
            scores = scores[back]
            scores[(scores < np.maximum(self.least, self.low)[part, None]) | (scores > self.high[part, None])] = LEAST
            busy = (scores > LEAST).any(axis=1)
            part, scores = part[busy], np.concatenate([self.scores[part[busy]], scores[busy]], axis=1)
            if not len(part):
                continue
            rows = np.concatenate([self.ids[part], np.broadcast_to(ids, (len(part), len(ids)))], axis=1)
            self.keep(part, scores, rows)

    def keep(self, part: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        at = max(0, scores.shape[1] - self.k)
        limit = np.maximum(np.partition(scores, at, axis=1)[:, at], LEAST + 1)
        row, col = np.nonzero(scores >= limit[:, None])
        order = np.lexsort((rows[row, col], -scores[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, place = row[place < self.k], col[place < self.k], place[place < self.k]
        self.scores[part], self.ids[part] = LEAST, MOST
        self.scores[part[row], place], self.ids[part[row], place] = scores[row, col], rows[row, col]
        self.least[part] = np.maximum(self.least[part], self.scores[part, self.k - 1])

    def found(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.scores > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[self.anchor[row]]), pa.array(self.slot[row]), pa.array(self.ids[row, col]), pa.array(self.scores[row, col])], names=["key", "slot", "vec_id", "score"])


class Space:
    """What tasks need to know of the vectors: their width, type and length, the cells' centres and the blocks and packs of each cell."""

    def __init__(self, width: int, kind: type, exact: type, longest: float) -> None:
        self.width, self.kind, self.exact, self.longest = width, kind, exact, longest
        self.cells = self.radius = np.zeros(0)
        self.block_at = self.pack_at = np.zeros(0, np.int64)
        self.rows_in = self.anchors_in = np.zeros(0, np.int64)

    def read(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.width)

    def extended(self, m: np.ndarray) -> np.ndarray:
        """With the component that brings all rows to one length."""
        m = m.astype(np.float64)
        return np.column_stack([m, np.sqrt(np.maximum(self.longest - (m * m).sum(1), 0))])

    def placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, label, vec) and the nearest cell with its distance."""
        for batch in batches:
            far = distances(self.extended(self.read(batch.column(2))), self.cells)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["vec_id", "label", "vec", "cell", "far"])

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, vec_id, label, vec): rows of a cell are dealt to its blocks."""
        for batch in batches:
            cell, ids = batch.column(3).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            parts = self.block_at[cell + 1] - self.block_at[cell]
            part = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % parts.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(self.block_at[cell] + part.astype(np.int64)), *batch.columns[:3]], names=["block", "vec_id", "label", "vec"])

    def grown(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block as one row per block, with its tree."""
        for held in _runs(batches):
            blocks, ids, labels, vecs = zip(*held, strict=True)
            ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
            vecs = np.frombuffer(b"".join(vecs), self.kind).reshape(len(ids), self.width)
            points = self.extended(vecs)
            order, nodes = grow(points)
            points = points[order]
            radii = np.array([distances(points[a:b], points[c : c + 1]).max() for c, a, b in nodes[:, :3]])
            yield _row(blocks[0], ["block", "ids", "labels", "vecs", "nodes", "radii"], ids[order], labels[order], vecs[order], nodes, radii)

    def packed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, key, vec_id, label, vec): anchors of a cell are dealt to neighbouring packs."""
        for batch in batches:
            cell, keys = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            pack = (self.pack_at[cell] + keys % np.maximum(self.anchors_in[cell], 1)) // PACK
            yield pa.RecordBatch.from_arrays([pa.array(pack), batch.column(5), *batch.columns[:3]], names=["pack", "key", "vec_id", "label", "vec"])

    def together(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors sorted by pack as one row per pack."""
        for held in _runs(batches):
            packs, keys, own, labels, vecs, windows = zip(*held, strict=True)
            flat = np.array([(i, w["slot"], w["low"], w["high"], w["least"]) for i, ws in enumerate(windows) for w in ws], np.int64).T
            yield _row(packs[0], ["pack", "keys", "own", "labels", "vecs", "windows"], *(np.array(x, np.int64) for x in (keys, own, labels)), np.frombuffer(b"".join(vecs), np.uint8), np.ascontiguousarray(flat))

    def search(self, keys: bytes, own: bytes, labels: bytes, vecs: bytes, windows: bytes, same: bool, k: int) -> Search:
        keys, own, labels = (np.frombuffer(x, np.int64) for x in (keys, own, labels))
        return Search(keys, own, labels, np.frombuffer(vecs, self.kind).reshape(len(keys), self.width), np.frombuffer(windows, np.int64).reshape(5, -1), same, k, self.longest, self.exact)

    def opened(self, same: bool, k: int, first: bool):
        """(pack, cell, block, bound) of the cells that a pack's windows may find rows in; ``first``: each window's best one only."""

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    s = self.search(*row, same, k)
                    dots = s.vecs.astype(np.float64) @ self.cells[:, : self.width].T
                    low, high = (b[s.anchor] for b in bounds(dots, s.norm2, self.radius, self.longest))
                    fits = (self.rows_in > 0)[None] & (high >= np.maximum(s.low, s.least)[:, None]) & (low <= s.high[:, None])
                    reach = np.where(fits, high, -np.inf)
                    keep = fits.any(0)
                    if first:
                        keep = np.zeros(len(keep), bool)
                        keep[reach[fits.any(1)].argmax(1)] = True
                    cells = np.flatnonzero(keep)
                    blocks = self.block_at[cells + 1] - self.block_at[cells]
                    cell = np.repeat(cells, blocks)
                    block = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.block_at[c], self.block_at[c + 1]) for c in cells)])
                    yield pa.RecordBatch.from_arrays([pa.array([pack] * len(cell), pa.int64()), pa.array(cell), pa.array(block), pa.array(reach.max(0)[cell])], names=["pack", "cell", "block", "bound"])

        return choose

    def compare(self, same: bool, k: int):
        """Packs, each followed by blocks: what the windows hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = None
            for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["keys"] is not None:
                    if search is not None:
                        yield search.found()
                    search = self.search(row["keys"], row["ids"], row["labels"], row["vecs"], row["more"], same, k)
                    continue
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                search.descend(ids, labels, np.frombuffer(row["vecs"], self.kind).reshape(len(ids), self.width), np.frombuffer(row["more"], np.int64).reshape(-1, 5), np.frombuffer(row["radii"], np.float64))
            if search is not None:
                yield search.found()

        return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each value of the first column, which come together."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _row(key: int, names: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=names)


PACKED = "pack long, keys binary, own binary, labels binary, vecs binary, windows binary"
FOUND = "key long, slot long, vec_id long, score long"
BLOCKED = "block long, ids binary, labels binary, vecs binary, nodes binary, radii binary"


class Tree:
    """The index over all candidates, the anchors beside it, and searches."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, space: Space, copies: int) -> None:
        self.space, self.spark = space, rows.sparkSession
        first = Window.partitionBy("vec", "label").orderBy("vec_id")
        few = rows.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= copies).select("vec_id", "label", "vec")
        schema = "vec_id long, label long, vec binary, cell int, far double"
        placed = checkpointed(few.mapInArrow(space.placed, schema))
        asking = checkpointed(anchors.select("vec_id", "label", "vec").mapInArrow(space.placed, schema)).withColumn("key", F.monotonically_increasing_id())
        cells = len(space.cells)
        space.rows_in, space.anchors_in, space.radius = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells)
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row per cell
            space.rows_in[r["cell"]], space.radius[r["cell"]] = r["n"], r["far"]
        for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per cell
            space.anchors_in[r["cell"]] = r["n"]
        space.block_at = np.concatenate([[0], np.cumsum(-(-space.rows_in // BLOCK))])
        space.pack_at = np.concatenate([[0], np.cumsum(space.anchors_in)])
        self.groups = max(1, int(space.block_at[-1]) // GROUP)
        dealt = placed.mapInArrow(space.dealt, "block long, vec_id long, label long, vec binary")
        self.blocks = checkpointed(dealt.repartition("block").sortWithinPartitions("block", "vec_id").mapInArrow(space.grown, BLOCKED))
        self.anchors = checkpointed(asking.mapInArrow(space.packed, "pack long, key long, vec_id long, label long, vec binary"))

    def search(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """(key, slot, vec_id, score) of the ``k`` best rows in every window (key, slot, low, high); ties to smaller ids."""
        space = self.space
        found = self.spark.createDataFrame([], FOUND)
        best = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id")
        none, before = F.lit(None).cast("binary"), None
        for first in (True, False):
            least = found.groupBy("key", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            asked = windows.join(least, ["key", "slot"], "left").select("key", F.struct("slot", "low", "high", F.coalesce("least", F.lit(LEAST)).alias("least")).alias("window"))
            listed = self.anchors.join(asked.groupBy("key").agg(F.sort_array(F.collect_list("window")).alias("windows")), "key")  # an anchor's own
            packs = listed.select("pack", "key", "vec_id", "label", "vec", "windows").repartition("pack").sortWithinPartitions("pack", "key")
            packs = checkpointed(packs.mapInArrow(space.together, PACKED))
            pairs = checkpointed(packs.mapInArrow(space.opened(same, k, first), "pack long, cell long, block long, bound double"))
            if before is not None:
                pairs = pairs.join(before, ["pack", "block"], "left_anti")
            before = pairs.select("pack", "block")
            pairs = pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(self.groups)).cast("int"))
            mine = pairs.select("pack", "part").distinct().join(packs, "pack").select("pack", "part", F.lit(None).cast("double").alias("bound"), "keys", F.col("own").alias("ids"), "labels", "vecs", F.col("windows").alias("more"), none.alias("radii"))
            theirs = pairs.join(self.blocks, "block").select("pack", "part", "bound", none.alias("keys"), "ids", "labels", "vecs", F.col("nodes").alias("more"), "radii")
            rows = mine.unionByName(theirs).repartition("pack", "part").sortWithinPartitions("pack", "part", F.desc_nulls_first("bound"))
            ranked = found.unionByName(rows.mapInArrow(space.compare(same, k), FOUND)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            found = checkpointed(ranked.select("key", "slot", "vec_id", "score"))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label long, x array<double>) of the rows with an id, a label and a vector of finite components, scaled."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double") * SCALE).alias("x"))


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id, embedding and label (of an integer type); other columns are ignored. Rows
    whose id, label or vector is null, or whose vector holds null or non-finite components, take no
    part; shorter vectors, empty ones included, count as padded with zeros. An anchor's positives are
    the ``positives`` best other rows of its label, its negatives of a positive the ``negatives`` best
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score; ties go to
    smaller ids. vec_id is a key: a row with the anchor's id is never its candidate, repeated rows of
    another id are candidates each, equal anchor rows count once. A positive without such rows has none
    in the result, an empty table no rows. Components so large that a score could exceed a long raise
    an error.
    """
    rough = usable(vectors)
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v) + 1, 2))
    n, width, top, longest = rough.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.max(squares)).first()
    width, top = max(1, width or 0), (top or 0.0) + 1
    if width * top * top * max(100, abs(low), abs(high)) >= 2**63:
        raise ValueError(f"components up to {top / SCALE:.3g} give inner products that no long holds")
    kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
    space = Space(width, kind, np.float64 if width * top * top < 2**53 else np.int64, longest or 0.0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.floor(matrix(batch.column(2), width)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in m], pa.binary())], names=["vec_id", "label", "vec"])

    rows = checkpointed(rough.mapInArrow(whole, "vec_id long, label long, vec binary"))
    taken = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(SAMPLE).select("vec").toPandas()["vec"].tolist()  # bounded
    space.cells = top_cells(space.extended(space.read(pa.array([bytes(x) for x in taken], pa.binary()))), int(np.clip(np.sqrt(n) / 2, *CELLS)))
    tree = Tree(rows, rows.where(F.col("vec_id") % every == 0).distinct(), space, max(positives, negatives) + 1)
    own = tree.anchors.select("key", F.col("vec_id").alias("anchor_id"))
    free = own.select("key", F.lit(0).cast("long").alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = tree.search(free, True, positives).withColumn("slot", F.row_number().over(order).cast("long"))
    score = F.col("score")
    near = checkpointed(near.select("key", "slot", F.col("vec_id").alias("positive_id"), score.alias("positive_score"), (-F.expr(f"({-low} * score - pmod({-low} * score, 100L)) div 100")).alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100L)) div 100").alias("high")))
    far = tree.search(near.where("low <= high").select("key", "slot", "low", "high"), False, negatives)
    rank = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))
    far = far.select("key", "slot", rank.alias("rank"), F.col("vec_id").alias("negative_id"), score.alias("negative_score"))
    return far.join(near, ["key", "slot"]).join(own, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
