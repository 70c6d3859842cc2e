"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from foldmill.llm import chat, decontam, langid, lines, mixing, quality, secret_scan, simhash, sql, substring, toxicity
from foldmill.llm.learning import crc_fold


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_fold("doc_id", 3) != 1))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "windows", "toxic_windows")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(read(spark, sf_dir, "conversations"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_fold("doc_id", 4) != 2))
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), secret_scan.trained())
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, model)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", "class_id", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_toxicity, op2_decontamination, op3_chat, op4_language, op5_secrets, op6_substrings, op7_source_mixing, op8_quality, op9_lines, op10_simhash)
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": sql.OP3, "op6_substrings": sql.OP6, "op7_source_mixing": sql.OP7, "op9_lines": sql.OP9} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
