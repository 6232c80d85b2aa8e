"""Resampling documents towards a target distribution, by hashed n-gram features in Arrow kernels.

Texts are lower-cased (``ascii_lower``), split at everything that stands in no word
(``split_pattern_regex``), flattened and dictionary-encoded, so that a word is an index. Indices
shifted by one make pairs with the n-grams before them; only distinct n-grams get a CRC, which
continues the CRC of their first words. Buckets are looked up with ``take`` and their gains summed by
segments of rows. Gains are integers, so sums don't depend on the order of rows or tasks.

Counts are taken over all documents and all target texts: a task adds its rows to one array of
``buckets`` numbers and returns it once. What reaches the driver is that array.

The draw is by Gumbel noise of a hash of the id: the best ``percent`` percent of all documents with
enough words. Ranks come from a range sort over all of them and the sizes of its partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release_memory

#: What stands between words of lower-cased texts.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N, BUCKETS = 1, 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Bytes of text that are split at a time; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def by_bytes(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of a text column whose texts have at most ``limit`` bytes together, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield column.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and dictionary index of every word, in order, and the dictionary. Null texts have no words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    if b"" in words:  # before a first and after a last separator
        keep = ids != words.index(b"")
        ids, rows = ids[keep], rows[keep]
    return rows, ids, words


def hashed(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``n`` words, and the number of words of every row."""
    rows, ids, words = word_ids(texts)
    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
    spaced = [b" " + w for w in words]
    grams, start = ids, np.arange(len(ids))
    out_rows, out_buckets = [rows], [(crcs % buckets)[ids].astype(np.int64)]
    for size in range(2, n + 1):
        end = np.minimum(start + size - 1, len(ids) - 1)
        within = (start + size - 1 == end) & (rows[end] == rows[start])
        start, end = start[within], end[within]
        pairs, grams = np.unique(grams[within] * len(words) + ids[end], return_inverse=True)
        heads, tails = np.divmod(pairs, max(1, len(words)))
        crcs = np.array([zlib.crc32(spaced[w], int(crcs[g])) for g, w in zip(heads, tails, strict=True)], np.uint32)
        out_rows.append(rows[start])
        out_buckets.append((crcs % buckets)[grams].astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out_buckets), np.bincount(rows, minlength=len(texts))


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of the column ``text``: how many features each bucket holds. Empty buckets have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in by_bytes(batch.column(0)):
                total += np.bincount(hashed(piece, n, buckets)[1], minlength=buckets)
        release_memory()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: a thousandfold log ratio of the smoothed target and source rates, rounded down."""
    counted = bucket_counts(docs, n, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counted = counted.unionByName(bucket_counts(target, n, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counted = counted.unionByName(docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    summed = checkpointed(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = summed.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return summed.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(key: str = "doc_id", seed: str = SEED) -> Column:
    """A thousandfold Gumbel draw of the hash of the seed and the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


IMPORTANCE = "struct<n_words:long,n_features:long,weight:long,score:long>"


def weigh(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """``docs`` with the struct ``importance`` of n_words, n_features, weight and score.

    A null or empty text, or one without words, has no features and the weight 0; texts are read
    whole; rows that repeat a doc_id are weighed each; a null doc_id draws its noise as the empty
    text. With an empty target the weights follow the smoothing alone. A column of docs called
    ``importance`` is replaced.
    """
    table = gains(docs, target, n, buckets).toPandas()  # ``buckets`` rows
    gain = np.zeros(buckets, np.int64)
    gain[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    weighed = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weights(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for piece in by_bytes(column):
                rows, bucket, words = hashed(piece, n, buckets)
                order = np.argsort(rows, kind="stable") if n > 1 else slice(None)
                sums = np.concatenate([[0], np.cumsum(gain.take(bucket[order]))])
                ends = np.cumsum(features := np.bincount(rows, minlength=len(piece)))
                out.append(pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(sums[ends] - sums[ends - features], pa.int64())], names=["n_words", "n_features", "weight"]))
            yield pa.concat_arrays(out) if out else pa.array([], weighed)
        release_memory()

    marked = docs.drop("importance").withColumn("importance", weights("text"))
    return marked.withColumn("importance", F.struct("importance.n_words", "importance.n_features", "importance.weight", (F.col("importance.weight") + gumbel(seed=seed)).alias("score")))


def ranked(rows: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score) and ``rank``: 1, 2, 3... of the drawn ones, null of the others.

    Of the N rows of at least ``min_words`` words the floor(percent * N / 100) highest scores are
    drawn, ties to smaller ids, null ids last; rows that repeat an id are rows each. An empty table
    gives no rows. All are sorted by ranges; a partition's first rank is the number of rows before it.
    """
    spark = rows.sparkSession
    able = F.col("n_words") >= min_words
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row, order = F.col("_row"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_features")]
    at = F.monotonically_increasing_id()  # partition and position, of a checkpoint that stays as it is
    ordered = rows.where(able).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered).withColumn("_row", at).withColumn("_part", F.shiftright(row, 33)).withColumn("rank", row - F.shiftleft(F.col("_part"), 33) + 1)
    sizes = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row per partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    drawn = before[-1] * percent // 100
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    placed = ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.col("rank") + F.col("_before"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.select(*rows.columns, "rank").unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def importance_ranks(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    weighed = checkpointed(weigh(docs.select("doc_id", "text"), target, n, buckets, seed).select("doc_id", "importance.*"))
    return ranked(weighed, min_words, percent)


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """The drawn documents with their texts and ``importance``.

    The ranks' last drawn row is the cut; documents at or above it are read again and stay in their
    files' order, so texts aren't shuffled. Rows that repeat the cut's id are all drawn.
    """
    weighed = weigh(docs, target, n, buckets, seed)
    last = ranked(checkpointed(weighed.select("doc_id", "importance.*")), min_words, percent).where("rank is not null").orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return weighed.limit(0)
    score, ident = F.col("importance.score"), F.col("doc_id")
    tie = F.lit(True) if last["doc_id"] is None else F.coalesce(ident <= last["doc_id"], F.lit(False))
    return weighed.where((F.col("importance.n_words") >= min_words) & ((score > last["score"]) | (score == last["score"]) & tie))
