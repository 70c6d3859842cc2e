"""Each operator on one very long text, and on tables whose further columns have the names of inner ones."""

import random

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldmill.llm import chat, common, decontam, langid, lines, mixing, quality, secret_scan, simhash, substring, toxicity
from tests.llm.helpers import SCHEMA

CLASH = ["1 as row", "2 as n", "'x' as label", "3 as turn", "'k' as key", "4 as block", "5 as size", "'s' as sig", "6 as seeds", "7 as fold", "8 as weight", "'w' as words", "10 as item"]


@pytest.fixture(scope="module")
def long(spark):
    """Three megabytes of lines: a passage, a line and a secret stand near the end."""
    rng = random.Random(8)
    v = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(20000)]
    passage = " ".join(rng.choice(v) for _ in range(30))
    body = "\n".join(" ".join(rng.choice(v) for _ in range(12)) for _ in range(42000))
    text = f"{body}\n{passage}\napi_key = Zk93jQ82hd1xYq7Lm2\nthe end"
    rows = [(1, passage, "en", "a", 1), (2, text, "en", "a", 2), (3, "short one", "en", "b", 3)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASH), passage, text


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet").selectExpr("*", *CLASH, "'t' as text", "0 as least")


def test_line_and_substring(long):
    df, passage, text = long
    got = {r.doc_id: r for r in lines.remove_lines(df).collect()}
    assert got[2].n_removed == 1 and got[2].kept == text.replace(passage + "\n", "") and got[2].class_id == 1
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    assert got[2].n_removed == 30 and got[2].n_words == len(text.split())
    kept = simhash.one_of_each(df, 5, similar=True)
    assert kept.columns == df.columns and kept.count() == 3
    assert simhash.near_duplicates(df).count() == 3


def test_decontamination(spark, long):
    df, passage, text = long
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string").selectExpr("*", *CLASH, "1 as doc_id", "2 as item_text")
    got = {r.doc_id: r.n_tokens for r in decontam.find_overlaps(df, bench).collect()}
    assert got == {1: 30, 2: 30}
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == {3}


def test_models(spark, small, long, labels):
    df, _, text = long
    known = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", *CLASH)
    n = len(text.split())
    assert {r.doc_id: r.windows for r in toxicity.score(df, toxicity.fit(known, labels)).collect()}[2] > len(text) // 80
    rows = {r.doc_id: r for r in quality.apply_rules(df, quality.fit(known, labels)).collect()}
    assert rows[2].n_words == n and not rows[2].base_failed
    assert {r.doc_id for r in langid.predict(df, langid.fit(known, 20)).collect() if 0 <= r.score <= 1} == {1, 2, 3}
    found = [r.value for r in secret_scan.scan(df, secret_scan.trained()).collect() if r.is_secret]
    assert "Zk93jQ82hd1xYq7Lm2" in found
    mixed = {r.doc_id: r for r in mixing.mix_sources(df, labels).collect()}
    assert mixed[2]["size"] == n and all(0 <= r.taken <= 2 * r["size"] for r in mixed.values())


def test_chat(long):
    df, _, text = long
    turns = df.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", F.lit(1).alias("at"), F.lit("c").alias("c"), F.lit(2).alias("slice_"))
    got = {r.turn: r.message for r in chat.format_turns(turns).collect()}
    assert len(got[2]) > len(text)


def test_what_the_driver_has_made_is_not_sent(spark):
    """Functions of over a megabyte are broadcast by Spark, once for each use, into files that stay until the session ends."""
    common.powers(1)
    with common.scratch(spark):
        held = common.Sent(spark, np.random.default_rng(1).bytes(1 << 21))
        assert len(held.value) == 1 << 21
        assert len(cloudpickle.dumps(lambda: common.span_hashes(held.value))) < 1 << 18
    assert len(common.powers(1)[0]) > 1 << 18
