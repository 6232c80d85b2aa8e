"""Embedding near-duplicates by an epsilon grid order join.

Vectors are normalised; a cosine of at least ``t`` is a distance of at most sqrt(2 - 2t) = eps.
An orthonormal projection onto leading principal directions, with the length of what it leaves out
as one more coordinate, never lengthens distances, so vectors within eps lie in equal or adjacent
cells of a grid of width eps there. Vectors are range-sorted by label and cell, and the sequence
is cut into blocks with bounding boxes. Only pairs of blocks of one label in adjacent cells whose
boxes are within eps are joined; inside a pair, intervals are halved recursively and provably
distant halves skipped. A block's vectors are sent once for a group of the blocks it is joined with.

Identical vectors of a label are one class with a multiplicity. A block pair returns link counts
per class and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, forest_of

THRESHOLD = 0.93
#: Bound of the sample that the principal directions are fitted on.
SAMPLE = 4096
#: Principal directions of boxes, and those of them that make the grid's cells.
DIRECTIONS, CELLS = 12, 4
BLOCK = 2048
#: Blocks that one block is joined with in a group.
GROUP = 16
#: Intervals of at most so many rows are compared in full.
LEAF = 128


def directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Orthonormal leading principal directions, as columns; identity columns if there is no sample."""
    width = sample.shape[1]
    n = min(n, width)
    if not len(sample):
        return np.eye(width)[:, :n]
    return np.linalg.svd(sample - sample.mean(axis=0), full_matrices=len(sample) < width)[2][:n].T


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Where the cosine of rows of ``a`` and ``b`` (double precision) reaches the threshold."""
    return (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]) >= threshold


def apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether the boxes around two sets of projected rows are further apart than eps."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float((gap * gap).sum()) > eps * eps


class PairJoin:
    """Recursive join of two intervals of the sequence."""

    def __init__(self, a, b, pa_, pb, threshold: float, eps: float) -> None:
        self.a, self.b, self.pa, self.pb, self.threshold, self.eps = a, b, pa_, pb, threshold, eps
        self.hit = np.zeros((len(a), len(b)), bool)

    def run(self, i: slice, j: slice) -> None:
        n, m = i.stop - i.start, j.stop - j.start
        if apart(self.pa[i], self.pb[j], self.eps):
            return
        if n <= LEAF and m <= LEAF:
            self.hit[i, j] = linked(self.a[i], self.b[j], self.threshold)
        elif n >= m:
            half = i.start + n // 2
            self.run(slice(i.start, half), j)
            self.run(slice(half, i.stop), j)
        else:
            half = j.start + m // 2
            self.run(i, slice(j.start, half))
            self.run(i, slice(half, j.stop))


def link_classes(classes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, n) from classes (label, embedding, node, n): counts (b null) and edges (n null)."""
    eps = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-6) + 1e-6
    taken = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").toPandas()["embedding"].tolist()  # bounded
    sample = np.array([np.pad(np.asarray(v, np.float64), (0, width - len(v))) for v in taken]).reshape(-1, width)
    basis = directions(sample / np.sqrt((sample * sample).sum(1))[:, None] if len(sample) else sample, DIRECTIONS)
    cells = [f"c{i}" for i in range(min(CELLS, basis.shape[1]))]
    kind = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def rows_of(lists: pa.Array) -> np.ndarray:
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), width), kind)
        out[np.arange(width)[None] < sizes[:, None]] = values
        return out

    def project(m: np.ndarray) -> np.ndarray:
        """Principal coordinates of the normalised rows and the length of the rest."""
        m = m.astype(np.float64)
        unit = m / np.sqrt((m * m).sum(1))[:, None]
        main = unit @ basis
        return np.column_stack([main, np.sqrt(np.maximum(0, 1 - (main * main).sum(1)))])

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = rows_of(batch.column(1))
            at = np.floor(project(m)[:, : len(cells)] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([x.tobytes() for x in m], pa.binary()), *(pa.array(at[:, i]) for i in range(len(cells)))], names=["label", "node", "n", "vec", *cells])

    schema = "label string, node long, n long, vec binary, " + ", ".join(f"{c} int" for c in cells)
    order = ["label", *cells, "node"]
    keyed = classes.select(F.col("label").cast("string").alias("label"), "embedding", "node", "n").mapInArrow(celled, schema)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list = []
        sizes: list = []
        vecs: list = []
        last = None

        def out():
            raw = b"".join(vecs)
            box = project(np.frombuffer(raw, kind).reshape(-1, width))
            return pa.RecordBatch.from_pydict({"label": [last[0]], "c0": pa.array([last[1]], pa.int32()), "c1": pa.array([last[2]], pa.int32()), "block": [nodes[0]], "lo": [box.min(0).tolist()], "hi": [box.max(0).tolist()], "nodes": pa.array([np.array(nodes, np.int64).tobytes()], pa.binary()), "sizes": pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), "vecs": pa.array([raw], pa.binary())})

        for batch in batches:
            got = batch.to_pydict()
            for key, node, n, vec in zip(zip(got["label"], got["c0"], got.get("c1", got["c0"]), strict=True), got["node"], got["n"], got["vec"], strict=True):
                if nodes and (key != last or len(nodes) >= BLOCK):
                    yield out()
                    nodes, sizes, vecs = [], [], []
                last = key
                nodes.append(node)
                sizes.append(n)
                vecs.append(vec)
        if nodes:
            yield out()

    blocks = checkpointed(ordered.mapInArrow(blocked, "label string, c0 int, c1 int, block long, lo array<double>, hi array<double>, nodes binary, sizes binary, vecs binary"))
    here = blocks.select("label", "c0", "c1", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    near = blocks.select("label", F.explode(F.sequence(F.col("c0") - 1, F.col("c0") + 1)).alias("c0"), "c1", F.col("block").alias("b"), "lo", "hi")
    near = near.select("label", "c0", F.explode(F.sequence(F.col("c1") - 1, F.col("c1") + 1)).alias("c1"), "b", "lo", "hi")
    gaps = F.zip_with(F.zip_with("alo", "hi", lambda x, y: x - y), F.zip_with("lo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    reach = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps
    pairs = here.join(near, ["label", "c0", "c1"]).where((F.col("a") <= F.col("b")) & reach).select("label", "a", "b")
    groups = checkpointed(pairs).withColumn("part", F.floor(F.row_number().over(Window.partitionBy("label", "a").orderBy("b")) / GROUP).cast("int"))
    held = [F.col(c) for c in ("nodes", "sizes", "vecs")]
    first = groups.select("label", "a", "part").distinct().join(blocks.select("label", F.col("block").alias("a"), *held), ["label", "a"]).withColumn("b", F.lit(None).cast("long"))
    second = groups.join(blocks.select("label", F.col("block").alias("b"), *held), ["label", "b"])
    order = ["label", "a", "part", "b", "nodes", "sizes", "vecs"]
    rows = first.select(order).unionByName(second.select(order)).repartition("label", "a", "part").sortWithinPartitions("label", "a", "part", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            nodes, sizes = (np.frombuffer(row[c], np.int64) for c in ("nodes", "sizes"))
            raw = np.frombuffer(row["vecs"], kind).reshape(-1, width)
            block = nodes, sizes, raw.astype(np.float64), project(raw)
            if row["b"] is None:
                mine = block
                continue
            join = PairJoin(mine[2], block[2], mine[3], block[3], threshold, eps)
            join.run(slice(0, len(mine[0])), slice(0, len(nodes)))
            same = row["a"] == row["b"]
            if same:
                np.fill_diagonal(join.hit, True)  # a class links its own copies
            if not join.hit.any():
                continue
            a, n = [mine[0]], [join.hit @ sizes]
            if not same:
                a.append(nodes)
                n.append(mine[1] @ join.hit)
            a, n = np.concatenate(a), np.concatenate(n)
            a, n = a[n > 0], n[n > 0]
            edges = np.array(forest_of(mine[0], nodes, join.hit), np.int64).reshape(-1, 2)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, edges[:, 0]])), pa.concat_arrays([none, pa.array(edges[:, 1])]), pa.concat_arrays([pa.array(n), pa.nulls(len(edges), pa.int64())])], names=["a", "b", "n"])

    return checkpointed(rows.mapInArrow(compare, "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector, linked within equal labels.

    ``vectors`` needs vec_id, embedding (array of float) and label. A vector that is null,
    empty, zero or holds null or non-finite components, or whose label or vec_id is null, links
    with nothing: no links, its own component, kept (null if the id is null). Shorter vectors
    count as padded with zeros. An empty table gives no rows; other columns are ignored. vec_id is a key; rows that repeat one count as copies. Copies link with each other.
    """
    v = vectors.select("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    v = v.withColumn("embedding", F.when(usable, F.col("embedding")))
    classes = checkpointed(v.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = link_classes(classes, width, threshold)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg((F.sum("n") - 1).alias("n_links"))
    roots = connected_components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(counts, "node", "left").join(roots, "node", "left")
    named = checkpointed(named.select("label", "embedding", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    out = v.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
