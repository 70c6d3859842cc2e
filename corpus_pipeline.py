"""A corpus pipeline of five stages; each works on what its predecessor wrote.

1. toxicity: documents whose score reaches the threshold go.
2. line_dedup: lines that match an earlier line go, and documents that lose all their lines.
3. near_dedup: one document of each group of near-duplicates stays: those whose SimHash of five-word shingles
   differs in up to 4 bits, or which have 0.8 of these shingles in common.
4. decontamination: documents that overlap a benchmark item go.
5. mixing: sources are mixed to their target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldmill.llm import decontam, lines, mixing, simhash, toxicity
from foldmill.llm.common import written
from foldmill.llm.learning import crc_fold

#: SQL has no trained compression dictionaries.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels of one fold in three are never learned from, as in the operator's query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 3) != 1)
    return toxicity.remove_toxic(docs, toxicity.fit(docs, labels))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=5, similar=True)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
