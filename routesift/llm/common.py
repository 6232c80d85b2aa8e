"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join as _lookup_join
from ..operators.storage import checkpointed, shared_folder

#: Rows of texts that Python works on at a time.
PIECE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that the operators look up are checkpoints already.
lookup_join = partial(_lookup_join, stored=True)


class Forest:
    """Union-find over arbitrary integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest_of(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Few edges that connect what the boolean matrix ``linked`` (rows x cols) connects.

    Every column is tied to its first row; a row is tied to the first rows of its columns.
    """
    hit = linked.any(axis=0)
    if not hit.any():
        return []
    linked, cols = linked[:, hit], cols[hit]
    first = linked.argmax(axis=0)
    edges = {(int(a), int(b)) for a, b in zip(cols, rows[first], strict=True) if a != b}
    forest = Forest()
    for i in np.flatnonzero(linked.any(axis=1)):
        for f in np.unique(first[linked[i]]):
            if f != i and forest.join(int(i), int(f)):
                edges.add((int(rows[i]), int(rows[f])))
    return list(edges)


__all__ = ["Forest", "binary_values", "checkpointed", "connected_components", "edge_batch", "forest_of", "lookup_join", "pieces", "read_table", "release_memory", "shared_folder"]

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def edge_batch(edges: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(list(edges), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], schema=EDGE)


def contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each Arrow batch, replace edges by stars around the smallest node."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        yield edge_batch((x, r) for x in list(forest.up) if (r := forest.root(x)) != x)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph with edges ``(u, v)`` of longs.

    Returns ``(node, root)`` for every node that isn't the smallest of its component.
    Batches of edges are first contracted to stars, then large-star and small-star steps
    alternate until only stars are left. Minima are materialised, so that each join has a
    plain exchange on both sides and AQE can split the edges of a hub. Nothing is collected
    but two counts a step. Self-loops and nulls are dropped; repeated edges count once.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = checkpointed(e.mapInArrow(contract_batches, "u long, v long").distinct())
    while True:
        least = checkpointed(e.groupBy("u").agg(F.min("v").alias("m")))
        large = e.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().cast("long").alias("moved"))
        large = checkpointed(large.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        seen = large.agg(F.sum("moved"), F.count("*")).first()
        if not seen[0] and seen[1] == least.count():
            return large.select(F.col("u").alias("node"), F.col("v").alias("root"))
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.select("u", "v").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(tied.mapInArrow(contract_batches, "u long, v long").distinct())


def binary_values(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def release_memory() -> None:
    """Give freed memory of this Python worker back; workers are reused, and the executor's limit counts all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(columns: Iterator[pa.Array], rows: int = PIECE_ROWS) -> Iterator[pa.Array]:
    """Arrow batches in slices of few rows, so that what Python makes of a batch stays small."""
    for column in columns:
        for at in range(0, len(column), rows):
            yield column.slice(at, rows)
    release_memory()
