"""Quality by hierarchical empirical Bayes.

Evidence of a document is the sum of log likelihood ratios of its binned surface features, from
smoothed counts of labelled rows. Hosts and paths get posterior rates of good documents: the
documents' own probabilities are summed per group and shrunk, paths towards their host and
hosts towards the global rate, so that sparse sites follow their parent. How strongly is estimated
from the data: the variance within groups over the variance between them, by moments. The
posterior of a document joins its evidence with the rate of its path without that document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, lookup_join, pieces
from .urlfilter import host_of, path_of

#: Bounds of the documents that a parent's rate counts as; the upper one stands where groups don't differ.
STRENGTHS = (1.0, 1000.0)
#: Documents with a smaller posterior are rejected.
THRESHOLD = 0.3
#: Pseudo-documents spread over the bins of a feature in each class.
SMOOTHING = 5.0
#: Log likelihood ratio that one feature can give at most.
MAX_RATIO = 4.0
BINS = 12
FEATURES = ("symbols", "exclamations", "pipes", "upper", "digits", "repeats", "top_word", "word_length", "words")
_CLASS = np.zeros(256, np.int8)
for _chars, _i in (("#$%&*+<=>@\\^_`{}~[]", 1), ("!", 2), ("|", 3), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), ("0123456789", 5), (" \t\n\r\x0b\x0c", 6)):
    for _c in _chars:
        _CLASS[ord(_c)] = _i


def measures(text: bytes) -> list[float]:
    """The features' raw values; all zero for an empty text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    held = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    solid = max(1, len(text) - int(held[6]))
    repeats = sum(map(bytes.__eq__, words[1:], words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values()) if len(words) >= 20 else 0
    return [held[1] / solid, held[2] / solid, held[3] / solid, held[4] / solid, held[5] / solid, repeats / len(words), top / len(words), solid / len(words) / 64, len(words) / 4096]


def bin_of(value: float) -> int:
    """0 for none, then one bin per doubling from 1/1024."""
    return 0 if value <= 0 else 1 + min(BINS - 2, max(0, int(math.log2(value * 1024))) if value * 1024 >= 1 else 0)


def bins(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pieces(texts):
        yield pa.array([[bin_of(v) for v in measures(t or b"")] for t in binary_values(column)], pa.list_(pa.int32()))


@dataclass
class QualityModel:
    """``ratios``: log likelihood ratio per feature and bin; ``prior``: global rate; ``rates``: (_host, _path, host_rate, good, n); ``strengths``: of the prior for hosts, and of a host's rate for its paths."""

    ratios: list[list[float]]
    prior: float
    rates: DataFrame
    strengths: tuple[float, float]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def evidence(binned: str, ratios: list[list[float]]) -> Column:
    """Sum of the bins' log likelihood ratios."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in ratios])
    return F.aggregate(F.zip_with(table, binned, lambda row, b: F.get(row, b)), F.lit(0.0), lambda a, b: a + b)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def with_bins(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(_row, doc_id, _host, _path, _bins): the row of ``docs`` as a struct, so that no names clash; null hosts and paths become the empty text."""
    site = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((host, "_host"), (path, "_path"))]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", *site, F.arrow_udf(bins, "array<int>")("text").alias("_bins"))


def ratios_of(binned: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """Smoothed log likelihood ratios and the global rate from all labelled rows.

    A label counts once per document; null labels and ids are left out. Without labels of both
    classes every ratio is 0.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cells = binned.join(known, "doc_id").select("quality", F.posexplode("_bins").alias("feature", "bin")).groupBy("quality", "feature", "bin").count().collect()  # features x bins
    counts = np.zeros((2, len(FEATURES), BINS))
    for r in cells:
        counts[r["quality"], r["feature"], r["bin"]] += r["count"]
    bad, good = counts[:, 0].sum(axis=1)
    share = (counts + SMOOTHING / BINS) / (counts.sum(axis=2, keepdims=True) + SMOOTHING)
    ratios = np.clip(np.log(share[1] / share[0]), -MAX_RATIO, MAX_RATIO)
    return ratios.tolist() if bad and good else np.zeros(ratios.shape).tolist(), float((good + 1) / (good + bad + 2))


def strength(within: float, between: float, documents: float, groups: float, parents: float, spread: float) -> float:
    """Documents that a parent counts as, from sums of squares within and between ``groups`` of ``parents``.

    ``spread`` is the sum over parents of the groups' squared sizes over the parent's size.
    """
    low, high = STRENGTHS
    if documents <= groups or documents <= spread:
        return high
    inner = max(0.0, within) / (documents - groups)
    outer = (between - (groups - parents) * inner) / (documents - spread)
    return high if outer <= inner / high else max(low, inner / outer)


def rates_of(binned: DataFrame, ratios: list[list[float]], prior: float) -> tuple[DataFrame, tuple[float, float]]:
    """(_host, _path, host_rate, good, n): hosts shrunk towards the prior, and the sums of their paths; and both strengths."""
    p = _sigmoid(evidence("_bins", ratios) + logit(prior))
    paths = checkpointed(binned.groupBy("_host", "_path").agg(F.sum(p).alias("good"), F.sum(p * p).alias("square"), F.count("*").alias("n")))
    part = F.col("good") * F.col("good") / F.col("n")
    hosts = checkpointed(paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum("n").alias("n"), F.sum(part).alias("parts"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("paths")))
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("paths").alias("paths"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum(part).alias("of_hosts"), F.sum("parts").alias("of_paths"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n2") / F.col("n")).alias("spread")).first()
    if sums["hosts"]:
        n = sums["n"]
        of_host = strength(sums["square"] - sums["of_hosts"], sums["of_hosts"] - sums["good"] ** 2 / n, n, sums["hosts"], 1, sums["n2"] / n)
        of_path = strength(sums["square"] - sums["of_paths"], sums["of_paths"] - sums["of_hosts"], n, sums["paths"], sums["hosts"], sums["spread"])
    else:
        of_host = of_path = STRENGTHS[1]
    shrunk = hosts.select("_host", ((F.col("good") + of_host * prior) / (F.col("n") + of_host)).alias("host_rate"))
    joined = lookup_join(paths, checkpointed(shrunk), ["_host"])
    return checkpointed(joined.select("_host", "_path", "host_rate", "good", "n")), (of_host, of_path)


def fit_binned(binned: DataFrame, labels: DataFrame) -> QualityModel:
    ratios, prior = ratios_of(binned, labels)
    return QualityModel(ratios, prior, *rates_of(binned, ratios, prior))


def posterior(binned: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``binned`` (the rows that the model was fitted on) with evidence, host_rate, path_rate, quality_score and keep."""
    joined = lookup_join(binned, model.rates, ["_host", "_path"]).withColumn("evidence", evidence("_bins", model.ratios))
    own, host, k = _sigmoid(F.col("evidence") + logit(model.prior)), F.coalesce("host_rate", F.lit(model.prior)), model.strengths[1]
    out = joined.withColumns({"host_rate": host, "path_rate": F.coalesce((F.col("good") - own + k * host) / (F.col("n") - 1 + k), host)}).drop("good", "n")
    out = out.withColumn("quality_score", _sigmoid(F.col("evidence") + F.ln(F.col("path_rate") / (1 - F.col("path_rate")))))
    return out.withColumn("keep", F.col("quality_score") >= threshold)


def document_site() -> tuple[Column, Column]:
    """Host and path of a row of ``documents``: its source, and its language below it."""
    return F.col("source"), F.col("lang")


def url_site(url: str = "url") -> tuple[Column, Column]:
    """Host and directory of a row with a URL; both empty without one."""
    return host_of(url), F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, site: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, quality_score, keep) of every document.

    ``site`` are the columns of host and path, by default source and language; ``url_site`` takes them from a URL.
    Empty and null texts have the features' zero bins; texts are measured whole. Null sources and
    languages form groups of their own. Repeated rows repeat their result and count again in their
    groups; a score equal to the threshold is kept. An empty table gives none. Other columns are ignored.
    """
    binned = checkpointed(with_bins(docs, *(site or document_site())).select("doc_id", "_host", "_path", "_bins"))
    out = posterior(binned, fit_binned(binned, labels), threshold)
    return out.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "evidence", "host_rate", "path_rate", "quality_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, site: tuple[Column, Column] | None = None) -> DataFrame:
    """The documents whose posterior reaches the threshold, with the columns of ``docs``."""
    binned = with_bins(docs, *(site or document_site()))
    model = fit_binned(checkpointed(binned.select("doc_id", "_host", "_path", "_bins")), labels)
    return posterior(binned, model, threshold).where("keep").select("_row.*")
