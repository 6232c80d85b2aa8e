"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

In every stage null and empty texts are documents without words, null sources and languages are
groups of their own, rows that repeat a doc_id are documents of their own (they share one fate
where a doc_id is dropped), null ids stay, texts are read whole, columns beside those of documents
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routesift.llm import linededup, mixing, quality, queries, simhash
from routesift.llm.common import read_table, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose posterior quality is below the threshold; one equal to it stays."""
    return quality.keep_good(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that occur in many documents; n_chars follows the text that is left."""
    cleaned = linededup.dedup_lines(docs.select(COLUMNS))
    return cleaned.select("doc_id", F.col("cleaned.text").alias("text"), "lang", "source", F.length("cleaned.text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of near duplicates: shingles of five words, a similarity of 0.8.

    README gives the recall by similarity. Texts without words are one group.
    """
    return simhash.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by their source's rate and shuffle them globally."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the mixture; one row per copy."""
    return queries.bpe_digests(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("bpe", encoding_stage)]

#: Near duplicates and byte-pair encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written to the shared folder and read again."""
    docs, place = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
