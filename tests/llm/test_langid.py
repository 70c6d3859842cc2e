import math
import zlib

import numpy as np
import pytest

from foldmill.llm import langid, queries
from tests.llm.helpers import SCHEMA, docs


def summed(word, prob):
    """All segmentations of a word, one by one."""
    if not word:
        return 1.0
    return sum(summed(word[n:], prob) * (prob.get(word[:n], 0) + (langid.UNKNOWN if n == 1 else 0)) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "ab", "b", "ba", "▁ab", "▁b", "bab", "é"]
    prob = np.column_stack([np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2), np.zeros(2)])
    model = langid.Model(pieces, ["x", "y"], np.array([0.5, 0.5]), prob)
    words = ["abab", "b", "ééab", "zab", "babba"]
    z, n = langid.Scorer(model).texts(words + ["ab, b!", "12 \ufe0f\u0301"])
    for k, lang in enumerate(prob):
        p = dict(zip(pieces, lang, strict=False))
        for i, w in enumerate(words):
            assert z[i, k] == pytest.approx(math.log(summed("▁" + w, p)))
        assert z[5, k] == pytest.approx(sum(math.log(summed("▁" + w, p)) for w in ("ab", "b")))
    assert n.tolist() == [1, 1, 1, 1, 1, 2, 0]


def test_long_words_are_summed_whole():
    rng = np.random.default_rng(1)
    pieces = ["▁", "a", "ab", "b", "ba", "▁ab", "▁b", "bab", "abbaabba" * 2]
    prob = np.column_stack([rng.dirichlet(np.ones(len(pieces)), 2), np.zeros(2)])
    model = langid.Model(pieces, ["x", "y"], np.array([0.5, 0.5]), prob)
    words = ["".join(rng.choice(list("aab"), n)) for n in (33, 40, 40, 333)] + ["abbaabba" * 40, "z" * 5000 + "ab"]
    z, _ = langid.Scorer(model).texts(words)
    for k in range(2):
        p = dict(zip(pieces, prob[k], strict=False))
        for i, word in enumerate(words):
            w, alpha, scale = "▁" + word, [1.0], 0.0
            for j in range(1, len(w) + 1):
                alpha.append(alpha[j - 1] * langid.UNKNOWN + sum(alpha[j - n] * p.get(w[j - n : j], 0) for n in range(1, min(16, j) + 1)))
                if j % 10 == 0:
                    top = max(alpha[-16:])
                    alpha, scale = [a / top for a in alpha], scale + math.log(top)
            assert z[i, k] == pytest.approx(math.log(alpha[-1]) + scale)


def test_all_pieces_of_the_vocabulary():
    found = langid.load_pieces()
    assert max(map(len, found)) > 10 and any(len(p) > 10 and p.strip("▁") == "government" for p in found)


def test_expectation_maximisation_raises_the_likelihood():
    pieces = ["▁", "a", "b", "ab", "▁ab", "ba"]
    words, count = ["ab", "abab", "ba"], np.array([[5.0, 3, 1]])
    like = []
    for rounds in (1, 2, 4):
        prob = langid.expectation_maximisation(words, count, pieces, rounds)
        z, _ = langid.Scorer(langid.Model(pieces, ["x"], np.ones(1), prob)).texts(words)
        like.append(float(count[0] @ z[:, 0]))
    assert like[0] <= like[1] + 1e-3 <= like[2] + 2e-3


def test_held_out_accuracy(spark, small):
    sf = small.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_awkward_rows(spark, small):
    model = langid.fit(spark.read.parquet(f"{small}/documents.parquet"), 20)
    assert {r.lang_pred for r in langid.predict(docs(spark, [(1, "\u2764\ufe0f\U0001f44d\ufe0f \u0301", None, None, None)]), model).collect()} == {"und"}
    rows = [(1, "1234 ...", None, None, None), (2, "x" * 5000 + " İİ \U0001d400\U00020000", None, None, None)]
    got = langid.predict(docs(spark).unionByName(docs(spark, rows)), model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[9].lang_pred == "und" and got[10].lang_pred != "und"
    assert langid.fit(docs(spark).where("lang = 'x'")) is None
    assert {r.lang_pred for r in langid.predict(docs(spark), None).collect()} == {"und"}
    assert langid.predict(spark.createDataFrame([], SCHEMA), model).count() == 0
