import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from foldmill.llm import near_sets, simhash
from tests.llm.helpers import SCHEMA, docs, words


def shingles(text, n=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([" ".join(w)] if w else [])


def prints(texts):
    x = near_sets.Shingles(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), 5)
    return simhash.majority(x.value, x.row, len(texts))


def survivors(rows):
    """By brute force: the least id of each component of documents that are alike in eight of ten shingles, or whose fingerprints are."""
    sets, one = {}, {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
        one[shingles(text)] = text
    fp = dict(zip(sets, prints([one[s] for s in sets]), strict=True))
    left, out = set(sets), set()
    while left:
        group, front = set(), [left.pop()]
        while front:
            s = front.pop()
            group.add(s)
            near = {t for t in left if (10 * len(s & t) >= 8 * len(s | t) and s and t) or np.bitwise_count(fp[s] ^ fp[t]) <= 4}
            left -= near
            front += near
        out.add(min(i for s in group for i in sets[s]))
    return out


def varied(rng, text, n):
    text = list(text)
    for k in rng.sample(range(len(text)), n):
        text[k] = f"new{rng.random()}"
    return text


def test_all_pairs_of_the_similarity(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 30, 90, 250]))]
        at = text
        for _ in range(rng.randrange(6)):
            rows.append(" ".join(at))
            at = varied(rng, rng.choice([at, text]), rng.randrange(max(1, len(text) // 30) + 1))
    centre = [f"c{rng.randrange(300)}" for _ in range(200)]
    rows += [" ".join(varied(rng, centre, k)) for k in (1, 3, 4, 5, 9) for _ in range(15)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
    assert {r.doc_id for r in got} == survivors(rows) and len(got) == len(survivors(rows))


def test_documents(spark, small):
    df = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").limit(1500)
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r.doc_id for r in simhash.one_of_each(df, 5, similar=True).collect()}
    assert got == survivors([(r.doc_id, r.text) for r in df.collect()])


def test_clashing_columns(spark):
    df = docs(spark).selectExpr("*", "'s' as sig", "1 as __row", "2 as __fp", "3 as ROW_")
    got = simhash.one_of_each(df, 5, similar=True)
    assert got.columns == df.columns and got.count() == 6


def test_awkward_rows(spark):
    df = docs(spark)
    once = simhash.one_of_each(df, 5, similar=True)
    assert once.dtypes == df.dtypes
    assert sorted(map(str, (r.doc_id for r in once.collect()))) == sorted(map(str, [1, 4, 5, None, 7, 8]))
    assert simhash.one_of_each(spark.createDataFrame([], SCHEMA), 5, similar=True).count() == 0


def test_sketches_differ_in_no_more_shingles_than_the_sets(spark):
    rng = random.Random(7)
    texts, pairs = [], []
    for n in (60, 66, 120, 130, 255, 259, 500, 520, 1030):
        a = [f"a{rng.random()}" for _ in range(n)]
        for b in (a, a[: 1 + n * 4 // 5], varied(rng, a, 1), varied(rng, a, n // 20), [f"b{rng.random()}" for _ in range(n * 5 // 4)]):
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    sketches = near_sets.Shingles(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), 5).sketches().to_pylist()
    rows = [(i, j, sketches[i], sketches[j]) for i, j in pairs] + [(j, i, sketches[j], sketches[i]) for i, j in pairs]
    df = spark.createDataFrame(rows, "i long, j long, a array<long>, b array<long>")
    for r in df.withColumn("n", near_sets.differing(F.col("a"), F.col("b"))).collect():
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        assert r.n <= len(a ^ b) and (r.n == 0) == (a == b)
        assert len(a & b) or r.n > len(a) + len(b) - 2 * -(-8 * (len(a) + len(b)) // 18)


def test_texts_and_sets_are_not_shuffled(spark):
    """Long texts of about one length, of which each two share one rare passage."""
    rng = random.Random(5)
    texts = [[f"{rng.randrange(1 << 30)}" for _ in range(1200)] for _ in range(300)]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        a[600:700] = b[600:700]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, varied(rng, texts[0], 5)])]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    sc, key = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(True).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(True).size()))

    before, held = shuffled(), spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = {r.doc_id for r in simhash.one_of_each(df, 5, similar=True).select("doc_id").collect()}
    finally:
        spark.conf.set(key, held)
    assert got == survivors(rows)
    assert shuffled() - before < 1.5 * sum(len(t) for _, t in rows)
