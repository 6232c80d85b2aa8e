"""Mixing sources to target weights by Poisson replication.

A document of a source with ``n`` documents, target share ``w`` and output size ``N`` is repeated
Poisson(``N * w / n``) times. The count is the inverse of the Poisson distribution at a uniform
number that a hash of the seed and the document's key gives, so a rerun repeats it. Copies are
dealt to partitions by a hash of key and copy and sorted by it within each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lookup_join

SEED = "mix-1"
#: Shares follow (documents of the source) ** POWER unless weights are given.
POWER = 0.7
#: Copies of one row that one task makes, where some row has more.
CHUNK = 1000
#: A rate above this is split into equal parts whose counts are added (exp(-rate) must stay a normal double).
MAX_RATE = 32.0


def uniform(*parts):
    """A double in [0, 1) from the first 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_inverse(u, rate):
    """The smallest k whose cumulative Poisson probability exceeds ``u``; 0 where the rate isn't positive."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    step = lambda s, k: F.when(s["u"] >= s["cum"], F.struct((s["k"] + 1).alias("k"), (s["p"] * rate / k).alias("p"), (s["cum"] + s["p"] * rate / k).alias("cum"), s["u"].alias("u"))).otherwise(s)
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cum"), u.alias("u"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, size: float | None = None) -> DataFrame:
    """(source, rate) per source. Null sources form one source, named by the empty string.

    ``weights`` maps sources to shares (normalised over the sources found; a source without one
    has rate 0). ``size`` is the expected number of output rows, by default that of the input.
    """
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, w double")
        weighed = counts.join(given, "_source", "left").na.fill(0.0, ["w"])
    weighed = checkpointed(weighed)
    total = weighed.agg(F.sum("w"), F.sum("n")).first()
    out = float(size if size is not None else total[1] or 0)
    return weighed.select("_source", (F.lit(out) * F.col("w") / F.lit(total[0] or 1.0) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, by_source: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` once per copy, with ``copy`` (from 0), ``rate`` and ``shuffle_key``, not yet shuffled.

    The key of a row is its doc_id (a null one is the empty text); rows that repeat a doc_id get
    the same count. Documents with count 0 are left out by design of the method. Where some source's
    rate is above CHUNK its rows are first dealt to tasks in chunks of copies. Texts aren't read.
    An empty table gives no rows. Columns of ``docs`` named like a result are replaced.
    """
    docs = docs.drop("copy", "rate", "shuffle_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.coalesce("source", F.lit("")).alias("_source"))
    held = lookup_join(rows, by_source, ["_source"])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    one = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson_inverse(uniform(F.lit(seed), key, i.cast("string")), F.col("rate") / parts))
    counted = held.withColumn("_n", one).where("_n > 0").withColumn("_from", F.lit(0))
    if (by_source.agg(F.max("rate")).first()[0] or 0.0) > CHUNK:
        counted = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(CHUNK)))).repartition("doc_id", "_from")
        last = F.least(F.col("_from") + CHUNK, F.col("_n")) - 1
    else:
        last = F.col("_n") - 1
    copies = counted.withColumn("copy", F.explode(F.sequence(F.col("_from"), last)))
    return copies.select("_row.*", "rate", "copy", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")).cast("binary")).alias("shuffle_key"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, size: float | None = None, seed: str = SEED) -> DataFrame:
    """The mixture, globally shuffled: partition by a hash of ``shuffle_key``, sorted by it inside."""
    return replicate(docs, rates(docs, weights, power, size), seed).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
