"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows that the stage before it kept. All but the last return the columns of
``documents``, and further columns, whatever their names, as they are.

Defined results of all stages. A null or empty text fails the quality rules; the
later stages keep such rows as they are, but for line dedup, which drops documents
without a word left. Repeated rows stay apart in the quality rules and the mix, and
are one in near-dedup. Ties go by document id, then by a hash. Very long texts are
worked on alone. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import linededup, mixing, neardup, pieces, quality, sessions


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, in all their columns. Rows are independent."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; a document of which no word is left goes."""
    cleaned = linededup.clean(docs, min_words=1)
    left = cleaned.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, a null id last. Texts without words are no copies of each other."""
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, up to three. A null source is a source of its own; a document without words is taken with its source's hash range."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as many rows as come in. Copies that the mix made of a document have equal ids, since nothing tells them apart."""
    return pieces.tokenize(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mix", mix_sources),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again, and what a stage needed is deleted after it."""
    sessions.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        path, since = f"{base}/{i}", sessions.kept()
        stage(spark, docs, sf_dir).write.parquet(path)
        sessions.sweep(spark, since)
        if before:
            sessions.delete(spark, before)
        docs, before = spark.read.parquet(path), path
        sessions.release(spark)
    return docs
