"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, hashed
to ``2 ** BITS`` coordinates. Training rows are a bounded, hash-chosen sample of labelled rows,
dealt to shards; each shard runs FTRL with per-coordinate rates, and the shards' states are
averaged per coordinate over the shards that met it. L1 leaves few weights, which are broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces

BITS = 20
#: Bound of the training sample: labelled rows of each class.
MAX_POSITIVE, MAX_NEGATIVE = 8_000, 16_000
#: Rows that a shard should have at least, and most shards.
SHARD_ROWS, MAX_SHARDS = 3_000, 8
EPOCHS = 6
#: A strong L1 keeps the features of rare words, which are noise, at zero.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
#: Words whose hashes a task remembers before it starts anew.
MEMORY = 500_000
#: Fixed odd multipliers that tell the kinds of features and the places in a pair apart.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def coordinates(text: str, hashes: WordHashes) -> np.ndarray:
    """Coordinates of all features, repeats included, from 1; 0 is the bias."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    a, b, c, d, e = MIX
    made = np.concatenate([h * a, h[:-1] * b + h[1:] * c, h[:-2] * d + h[2:] * e])
    return 1 + ((((made ^ (made >> np.uint64(29))) * a) >> np.uint64(64 - BITS)) % np.uint64((1 << BITS) - 1)).astype(np.int32)


def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for column in pieces(texts):
        yield pa.array([np.unique(coordinates(t or "", hashes)) for t in column.to_pylist()], pa.list_(pa.int32()))


def train_shard(rows: pa.Table) -> pa.Table:
    """FTRL over one shard: state of every coordinate met at least twice."""
    order = np.argsort(rows.column("order").to_numpy())
    lists = rows.column("features").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    label, weight = (rows.column(c).to_numpy().astype(np.float64) for c in ("label", "weight"))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(EPOCHS):
        for r in order:
            at = np.append(flat[ends[r] : ends[r + 1]], 0)
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            g = weight[r] * (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label[r])
            z[at] += g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] += g * g
    met = np.bincount(flat, minlength=1 << BITS) >= 2
    met[0] = True
    at = np.flatnonzero(met)
    return pa.table({"at": pa.array(at.astype(np.int32)), "z": z[at], "n": n[at]})


@dataclass
class ToxicityModel:
    """Sparse weights: coordinates (int32) and values (float32)."""

    at: np.ndarray
    weight: np.ndarray


def sample(labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> DataFrame:
    """(doc_id, label, weight, order): at most so many rows of each class, chosen by a hash of doc_id.

    Weights restore the classes' shares. Rows with a null id or label are left out; of the labels of
    one id the smallest counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("label")).withColumn("order", F.xxhash64(F.lit("toxic"), "doc_id"))
    classes = []
    for label, most in ((1, max_positive), (0, max_negative)):
        own = known.where(F.col("label") == label)
        n = own.count()
        classes.append(own.orderBy("order", "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, n / most))))
    return classes[0].unionByName(classes[1])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> ToxicityModel:
    """Train on the labelled rows of ``labels`` (doc_id, toxic). Without any, all weights are zero.

    A labelled id is one training row, however many documents repeat it: of their texts the one that
    sorts first, found by an aggregate that combines before the shuffle.
    """
    chosen = checkpointed(sample(labels, max_positive, max_negative))
    shards = min(MAX_SHARDS, max(1, chosen.count() // SHARD_ROWS))
    once = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # bounded by the sample's size
    rows = once.join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.pmod("order", F.lit(shards)).alias("shard"), "order", "label", "weight", F.arrow_udf(features, "array<int>")("text").alias("features"))
    trained = rows.groupBy("shard").applyInArrow(train_shard, "at int, z double, n double")
    merged = trained.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))
    w = (F.signum("z") * L1 - F.col("z")) / ((BETA + F.sqrt("n")) / ALPHA + L2)
    kept = merged.where(F.abs("z") > L1).select("at", w.alias("w")).toPandas()  # at most 2 ** BITS, few after L1
    return ToxicityModel(kept["at"].to_numpy(np.int32), kept["w"].to_numpy(np.float32))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` and ``score``, the probability of label 1. An empty or null text scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.at, model.weight))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        bias, hashes = float(dense[0]), WordHashes()
        dense[0] = 0
        for column in pieces(texts):
            out = np.empty(len(column))
            for i, text in enumerate(column.to_pylist()):
                at = coordinates(text or "", hashes)
                at = at[dense[at] != 0]
                out[i] = bias + float(dense[np.unique(at)].sum(dtype=np.float64))
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn("score", scored("text"))


def held_out(doc_id: str = "doc_id"):
    """True for the rows never trained on: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that aren't held out and score every document: (doc_id, held_out, score, predicted).

    Texts are read whole, however long; null and empty ones score by the bias. Repeated rows are scored
    each and trained on once; a null id is scored and never trained on. An empty table gives no rows.
    """
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


