"""Ordered folds over a key's sorted rows: streamed by key, or as a prefix scan over partitions of a total order.

``fold_sorted`` sends a key to one task. ``scan_sorted`` sorts all rows by ranges, so a key of any
size spreads over as many tasks as its rows fill. What a partition's first run does to the state that
reaches it is summed up as a small function of that state; the functions are chained in the order of
the partitions, one row each, and then every partition folds its rows from its own entry state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import checkpointed

RUN = "_run"


class Fold(Protocol):
    """A fold whose effect on an unknown state can be summed up. A state of None is that of a new key."""

    def summary(self, values: np.ndarray) -> Any:
        """What a run of values does to any state that reaches it."""

    def enter(self, summary: Any, state: Any) -> Any:
        """The state after a run that the state reaches."""

    def run(self, values: np.ndarray, state: Any) -> tuple[list[pa.Array], Any]:
        """Results for every value, and the state after the run."""


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], value: str, start: Callable[[], Callable], out: str) -> DataFrame:
    """``rows`` and the columns ``out`` (DDL): what the key's step function returns for each value, in order.

    ``start`` gives the step function of a new key. Rows are sorted by Spark, which spills, and
    pass through in Arrow batches, so a key of any length costs no memory.
    """
    added = StructType.fromDDL(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added]
        held, step = None, None
        for batch in batches:
            results = []
            for key, v in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(value).to_pylist(), strict=True):
                if key != held:
                    held, step = key, start()
                results.append(step(v))
            columns = [pa.array([r[i] for r in results], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, names=batch.schema.names + added.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType(rows.schema.fields + added.fields))


def quiet_runs(rows: DataFrame, key: str, seconds: Column, gap: float) -> DataFrame:
    """``rows`` and ``_run``: rows of a key in different runs are more than ``gap`` seconds apart.

    Runs are the islands of non-empty cells of that width, so one row per key and cell is sorted
    and a key is spread over tasks wherever it is quiet.
    """
    placed = rows.withColumn("_cell", F.floor(seconds / (gap * (1 + 1e-9) + 1e-6)))
    w = Window.partitionBy("_k").orderBy("_c")
    cells = placed.select(F.col(key).alias("_k"), F.col("_cell").alias("_c")).distinct().withColumn("_before", F.lag("_c").over(w))
    begins = F.when(F.col("_before").isNull() | (F.col("_c") - F.col("_before") > 1), F.col("_c"))
    cells = cells.select("_k", "_c", F.last(begins, True).over(w).alias(RUN))
    return placed.join(cells, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c"))).drop("_k", "_c", "_cell")


def _bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin and end in a batch."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change |= np.diff(codes) != 0
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])


def _values(batch: pa.RecordBatch, value: str) -> np.ndarray:
    return batch.column(value).to_numpy(zero_copy_only=False)


def scan_sorted(rows: DataFrame, keys: list[str], order: list[str], value: str, fold: Fold, out: str, last: bool = False) -> DataFrame:
    """``rows`` and the columns ``out`` (DDL): what the fold gives for each value, in order; with ``last`` for the last row of each run only.

    With ``last`` a key that reaches over several partitions has a row in each; the last in order counts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    held = checkpointed(ordered.withColumn("_part", F.spark_partition_id()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per partition: its first key and what the first run does to a state; its last key and that run's state, if it is another."""
        first: list = []
        first_key, part, state, key = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            edges, values = _bounds(batch, keys), _values(batch, value)
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(batch.column(k)[int(a)].as_py() for k in keys)
                if first_key is None:
                    first_key = now
                if now == first_key:
                    first.append(values[a:b])
                elif b == edges[-1]:
                    state = fold.run(values[a:b], state if now == key else None)[1]
                key = now
        if part is not None:
            whole = key == first_key
            row = (first_key, fold.summary(np.concatenate(first)), whole, key, None if whole else state)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(row)], pa.binary())], names=["part", "row"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            entries = []
            for raw in batch.column(1).to_pylist():
                first_key, summary, whole, last_key, end = pickle.loads(raw)
                entry = state if first_key == key else None
                entries.append(pickle.dumps((first_key, entry)))
                key, state = last_key, fold.enter(summary, entry) if whole else end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entries, pa.binary())], names=["part", "entry"])

    sums = held.select(*keys, value, "_part").mapInArrow(summed, "part int, row binary")
    chain = sums.repartition(1).sortWithinPartitions("part").mapInArrow(chained, "part int, entry binary")  # one row per partition
    entries = {r["part"]: bytes(r["entry"]) for r in chain.collect()}
    added = StructType.fromDDL(out)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kept = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if key is None:
                key, state = pickle.loads(entries[batch.column("_part")[0].as_py()])
            edges, values = _bounds(batch, keys), _values(batch, value)
            pieces, ends = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                now = tuple(batch.column(k)[int(a)].as_py() for k in keys)
                columns, state = fold.run(values[a:b], state if now == key else None)
                if last and kept is not None and a == 0 and now != key:
                    yield kept
                key = now
                pieces.append([c.slice(len(c) - 1) for c in columns] if last else columns)
                ends.append(int(b) - 1)
            results = [pa.concat_arrays([p[i] for p in pieces]) for i in range(len(added))]
            base = batch.select([n for n in batch.schema.names if n != "_part"])
            done = pa.RecordBatch.from_arrays([*(base.take(pa.array(ends)) if last else base).columns, *results], names=base.schema.names + added.names)
            if last:
                yield done.slice(0, done.num_rows - 1)
                kept = done.slice(done.num_rows - 1)
            else:
                yield done
        if kept is not None:
            yield kept

    return held.mapInArrow(scanned, StructType(rows.schema.fields + added.fields))


class MovingAverage:
    """Exponential mean and variance. A mean is affine in the mean that reaches the run; a variance affine in the variance and quadratic in the mean.

    Values are taken relative to the run's first one, which keeps the quadratic small.
    """

    def __init__(self, alpha: float, before: bool) -> None:
        self.alpha, self.before = alpha, before

    def summary(self, values: np.ndarray) -> tuple[float, ...]:
        a, b = self.alpha, 1 - self.alpha
        base, share, mean, square, linear, constant = float(values[0]), 1.0, 0.0, 0.0, 0.0, 0.0
        for x in (values - base).tolist():
            delta = x - mean
            square, linear, constant = b * (square + a * share * share), b * (linear - 2 * a * share * delta), b * (constant + a * delta * delta)
            mean, share = mean + a * delta, share * b
        return base, share, mean, square, linear, constant, len(values)

    def enter(self, summary: tuple[float, ...], state: tuple[float, float, int] | None) -> tuple[float, float, int]:
        base, share, mean, square, linear, constant, n = summary
        ema, var, before = state or (base, 0.0, 0)
        e = ema - base
        return base + mean + share * e, share * var + square * e * e + linear * e + constant, before + n

    def run(self, values: np.ndarray, state: tuple[float, float, int] | None) -> tuple[list[pa.Array], tuple[float, float, int]]:
        a, b = self.alpha, 1 - self.alpha
        ema, var, n = state or (0.0, 0.0, 0)
        means, variances = [], []
        for i, x in enumerate(values.tolist(), n):
            if self.before:
                means.append(ema)
                variances.append(var)
            if i:
                delta = x - ema
                ema, var = ema + a * delta, b * (var + a * delta * delta)
            else:
                ema, var = x, 0.0
            if not self.before:
                means.append(ema)
                variances.append(var)
        counts = np.arange(len(values)) + (n if self.before else n + 1)
        # a null value leaves no state behind
        columns = [pa.array(np.array(c, np.float64), from_pandas=True) for c in (means, variances)]
        return [*columns, pa.array(counts, pa.int64())], (ema, var, n + len(values))


class AnchoredTimes:
    """Times (microseconds) of which one counts as new if the last new one is at least ``ttl`` before it.

    Every time has a pointer to the first one at least ``ttl`` later; following the pointers, whose
    ends are found by doubling them, tells for each time that may be the first new one of a run which
    is the run's last. Only times within ``ttl`` of the run's begin, and the next one, may be the first.
    """

    NONE = np.iinfo(np.int64).min

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def summary(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times = values[values != self.NONE]
        jump = np.maximum(np.searchsorted(times, times + self.ttl), np.arange(1, len(times) + 1))
        end = np.arange(len(times))
        far = np.append(jump, len(times))
        while len(times) and (far[:-1] < len(times)).any():
            # what a pointer leads to, after 1, 2, 4... steps
            onward = far[:-1] < len(times)
            end = np.where(onward, np.append(end, 0)[far[:-1]], end)
            far = np.append(far[far[:-1]], len(times))
        first = np.searchsorted(times, times[0] + self.ttl) + 1 if len(times) else 0
        return times[:first], times[end[:first]]

    def enter(self, summary: tuple[np.ndarray, np.ndarray], state: int | None) -> int | None:
        times, ends = summary
        at = 0 if state is None else int(np.searchsorted(times, state + self.ttl))
        return int(ends[at]) if at < len(times) else state

    def run(self, values: np.ndarray, state: int | None) -> tuple[list[pa.Array], int | None]:
        skip = int(np.searchsorted(values, self.NONE, "right"))
        times, new = values[skip:], np.zeros(len(values), bool)
        at = 0 if state is None else int(np.searchsorted(times, state + self.ttl))
        while at < len(times):
            new[skip + at] = True
            state = int(times[at])
            at = max(at + 1, int(np.searchsorted(times, state + self.ttl)))
        return [pa.array(new, mask=values == self.NONE)], state
