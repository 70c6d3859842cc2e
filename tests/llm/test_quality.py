import math
import re

import pytest

from foldmill.llm import quality, queries
from foldmill.llm.learning import crc_fold
from tests.llm.helpers import SCHEMA, docs, words


def brute(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else set(range(len(w)))
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in quality.apply_rules(df, None).collect()}
    assert got == want


def test_awkward_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["a\n\na\n a\na \n\r\na\r\n", "\n\n", "#a <b>|", "x y z x y z", "é" * 40 + "\nñ\nñ", None])]
    for df in (docs(spark), spark.createDataFrame(rows, SCHEMA)):
        want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in df.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in quality.apply_rules(df, None).collect()) == want
    assert quality.apply_rules(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_learned_from_labels(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.98 * len(rows)


def test_held_out_verdicts(spark, small):
    """Fitted on the rows of three folds in four, and held against those of the other."""
    sf = small.replace("0.001", "0.01")
    df, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(df, labels.where(crc_fold("doc_id", 4) != 2))
    truth = {r.doc_id: r.quality for r in labels.where(crc_fold("doc_id", 4) == 2).collect()}
    rows = [r for r in quality.apply_rules(df, model).collect() if r.doc_id in truth and not r.base_failed]
    assert len(rows) > 50 and sum(r.kept == (truth[r.doc_id] == 1) for r in rows) >= 0.95 * len(rows)


def test_scores_against_brute_force(spark, small):
    """N-grams are cut one by one; only the hash of a word is the operator's own."""
    df, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(df, labels)
    base, full = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mixed(h):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> 33)) * m & full
        return h ^ (h >> 33)

    def word_hash(word):
        return mixed((sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(word)) + len(word) * base) & full)

    def score(text):
        raw = (text or "").encode()
        h = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
        shift, kind = 64 - quality.DIM_BITS + 2, 1 << (quality.DIM_BITS - 2)
        grams = [[x >> shift for x in h], [(mixed((a * base + b) & full) >> shift) + kind for a, b in zip(h, h[1:])]]
        for k, n in ((2, 3), (3, 4)):
            grams.append([((int.from_bytes(raw[i : i + n], "big") * base & full) >> shift) + k * kind for i in range(len(raw) - n + 1)])
        z = model.bias + sum(100 * sum(float(model.weights[d]) for d in g) / max(1, len(g)) for g in grams)
        return 1 / (1 + math.exp(-(model.slope * z + model.shift)))

    few = spark.createDataFrame(df.limit(40).collect() + [(1000, None, None, None, 0), (1001, "x", None, None, 1)], df.schema)
    for r in few.join(quality.apply_rules(few, model).select("doc_id", "score", "kept", "base_failed"), "doc_id").collect():
        assert r.score == pytest.approx(score(r.text), abs=1e-6)
        assert r.kept == (not r.base_failed and r.score >= 0.5)


def test_no_labels(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(df, labels) is None
