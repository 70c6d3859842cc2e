import random

import numpy as np

from foldmill.llm import substring
from foldmill.llm.fmindex import FMIndex, WaveletMatrix, least_in, suffix_order
from tests.llm.helpers import SCHEMA, docs, words


def brute(rows, size):
    least = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if i is not None:
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - size + 1) for j in range(size) if i is not None and least[tuple(w[k : k + size])] < i}
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def same(df, size=13):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, size).collect())
    assert got == brute(rows, size)
    return got


def test_fm_index():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 6, 700), [0]])
    w = WaveletMatrix(text, 6)
    for at in (0, 1, 63, 64, 65, 500, len(text)):
        assert all(w.rank(np.array([c]), np.array([at]))[0] == (text[:at] == c).sum() for c in range(6))
    order = suffix_order(text, 8)
    assert sorted(order) == list(range(len(text)))
    grams = [tuple(text[i : i + 8]) for i in order]
    assert grams == sorted(grams)
    fm = FMIndex(text, 6, 5)
    start = np.array([i for i in range(len(text) - 5) if text[i : i + 5].all()])
    low, high = fm.search(start, 5)
    for s, a, b in zip(start, low, high, strict=True):
        assert sorted(fm.order[a:b]) == [i for i in range(len(text) - 4) if (text[i : i + 5] == text[s : s + 5]).all()]
    values = rng.integers(0, 1000, len(text))
    assert least_in(values, low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]


def test_against_brute_force(spark, small):
    got = same(spark.read.parquet(f"{small}/documents.parquet"))
    assert sum(r[2] for r in got) > 1000


def test_overlapping_copies_and_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 20)
    monkeypatch.setattr("foldmill.llm.blocks.BLOCK_BYTES", 3000)
    rng = random.Random(1)
    v = [f"w{k}" for k in range(30)] + ["ü"] * 10
    line = lambda n: [rng.choice(v) for _ in range(n)]
    shared = [line(n) for n in (13, 14, 25, 60, 12)]
    rows = []
    for i in range(120):
        w = line(20)
        for s in rng.sample(shared, 2):
            cut = rng.randrange(len(s) // 3 + 1)
            w += s[cut:] + line(rng.randrange(9))
        rows.append((rng.randrange(100), rng.choice([" ", "  ", "\n"]).join(w), None, None, None))
    same(spark.createDataFrame(rows, SCHEMA).repartition(3))
    same(spark.createDataFrame(rows, SCHEMA).repartition(2), 4)


def test_awkward_rows(spark):
    same(docs(spark))
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intervals(spark):
    rng = random.Random(3)
    v = [f"w{k}" for k in range(500)]
    base = [rng.choice(v) for _ in range(60)]
    texts = [" ".join(base), " ".join([rng.choice(v) for _ in range(9)] + base[5:45] + ["x"] + base[44:] + ["y"]), " ".join(base[:12])]
    df = spark.createDataFrame([((1 << 63) - 1 if k else 7, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    got = sorted(tuple(r) for r in substring.repeated_intervals(df).collect())
    assert got == [((1 << 63) - 1, 9, 40), ((1 << 63) - 1, 50, 16)]
    assert {r.doc_id for r in substring.remove_repeats(df).collect()} == {7, (1 << 63) - 1}
