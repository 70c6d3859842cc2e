import math
import re
import zlib

import pyarrow as pa
import pytest

from foldmill.llm import queries, toxicity
from foldmill.llm.common import Words, scratch, text_bytes
from foldmill.llm.learning import labelled
from tests.llm.helpers import SCHEMA, docs


def test_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    bad, good = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) > 0.85 * len(bad) * len(good)
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.93 * len(held)


def test_scores_against_brute_force(spark, small):
    """Windows and summaries one by one, from the model's dictionaries, thresholds and weights."""
    df, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(df, labels)
    made = model.dictionaries.compressors()

    def score(text):
        raw = (text or "").encode()
        raw = bytes(c | 32 if 65 <= c <= 90 else c for c in raw)
        cut = {}
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
            cut.setdefault(m.start() // toxicity.WINDOW, []).append(m.span())
        saved = sorted((len(made[0].compress(w)) - len(made[1].compress(w)) for w in (raw[s[0][0] : s[-1][1]] for s in cut.values())), reverse=True)
        n = max(1, len(saved))
        above = [sum(s >= x for s in saved) for x in model.levels]
        x = [max(saved, default=0), sum(saved[:4]) / min(4, n), sum(saved) / n, above[0] / n, above[1] / n, math.log1p(above[1]), math.log1p(above[2])]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    few = spark.createDataFrame(df.limit(60).collect() + [(1000, None, None, None, 0)], df.schema)
    text = {r.doc_id: r.text for r in few.collect()}
    for r in toxicity.score(few, model).collect():
        assert r.score == pytest.approx(score(text[r.doc_id]), abs=1e-9)


def test_dictionaries_are_trained():
    """By zstandard, from either class: a trained dictionary begins with its magic number."""
    ordinary = [[b"the quick brown fox number %d jumps over the lazy dog %d" % (k, k % 7)] for k in range(400)]
    toxic = [[b"you are a dreadful %s and so on %d" % (w, k)] for k in range(60) for w in (b"nincompoop", b"scoundrel", b"blockhead", b"simpleton", b"numbskull", b"dunderhead", b"rapscallion")]
    made = toxicity.dictionaries([(0, x) for x in ordinary] + [(1, x) for x in toxic])
    magic = bytes.fromhex("37a430ec")
    assert made.ordinary.startswith(magic) and made.both.startswith(magic) and made.both.endswith(made.ordinary)
    assert b"nincompoop" in made.both and b"nincompoop" not in made.ordinary


def test_a_hot_id_is_one_row_of_the_sample(spark):
    rows = [(1, "bad words here")] * 500 + [(k, f"good text {k}") for k in range(2, 40)]
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 40)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with scratch(spark):
        got, counts = labelled(df, labels, "toxic", 1000, "max")
        assert got.count() == 39 and counts == {0: 38, 1: 1}
        few, _ = labelled(df, labels, "toxic", 1000, "max", 100)
        assert 0 < sum(len(r.text) for r in few.collect()) <= 100


def test_windows_hold_all_words():
    texts = ["", "a bc " * 200, " x ", "w" * 500 + " y"]
    found, row = toxicity.windows(Words(*text_bytes(pa.array(texts)), lower=True))
    for k, t in enumerate(texts):
        assert b" ".join(x for x, r in zip(found, row, strict=True) if r == k).split() == t.encode().split()


def test_awkward_rows_and_no_model(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(df, labels)
    got = toxicity.score(docs(spark), model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.fit(df, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs(spark), None).collect()} == {0.0}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0
