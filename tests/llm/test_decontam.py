import random
import re

import pyarrow as pa

from foldmill.llm import decontam, queries
from tests.llm.helpers import SCHEMA, docs

ITEMS = "item_id long, text string"


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def seeded(a, b, shift):
    """Whether text and item have a seed in common on a diagonal."""
    same = [0 <= k + shift < len(a) and a[k + shift] == t for k, t in enumerate(b)]
    if len(b) < decontam.SPAN:
        return all(same)
    return any(all(same[k + o] for o in mask) for mask in decontam.MASKS for k in range(len(b) - decontam.SPAN + 1))


def holds(text, item):
    """Whether an alignment without gaps has a seed, and a best stretch of ten tokens, nine of them equal (or the whole item): the diagonals one by one."""
    a, b = toks(text), toks(item)
    for shift in range(-len(b), len(a)):
        best = score = length = equal = begin = 0
        for k, t in enumerate(b):
            if score < 0:
                score, begin = 0, k
            score += 1 if 0 <= k + shift < len(a) and a[k + shift] == t else -decontam.SUBSTITUTION
            if score > best:
                best, length = score, k - begin + 1
                equal = sum(0 <= j + shift < len(a) and a[j + shift] == b[j] for j in range(begin, k + 1))
        if length and length >= min(decontam.OVERLAP, len(b)) and equal >= min(decontam.EQUAL, len(b)) and seeded(a, b, shift):
            return True
    return False


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n)]


def test_exact_passages(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, small).collect()}
    want = {(r.doc_id, i.item_id) for r in df.collect() for i in items if " ".join(toks(i.text)) in " ".join(toks(r.text))}
    assert want <= found
    texts = {r.doc_id: r.text for r in df.collect()}
    items = {i.item_id: i.text for i in items}
    assert all(holds(texts[d], items[i]) for d, i in found)


def test_substitutions_and_blocks(spark):
    rng = random.Random(5)
    v = vocabulary(rng, 400)
    items = [(k, " ".join(rng.choice(v) for _ in range(n))) for k, n in enumerate([40, 30, 20, 16, 7, 5, 4])]
    rows = []
    for k, text in items:
        for every in (0, 9, 6):
            w = [rng.choice(v) if every and j % every == every // 2 else t.upper() for j, t in enumerate(text.split())]
            rows.append((10 * k + every, " ".join([rng.choice(v) for _ in range(50)] + w + [rng.choice(v) for _ in range(50)]), None, None, None))
    rows += [(1000 + j, " ".join(rng.choice(v) for _ in range(300)), None, None, None) for j in range(30)]
    bench = spark.createDataFrame(items, ITEMS)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench).collect()}
    assert got == {(r[0], k) for r in rows for k, t in items if holds(r[1], t)}
    assert {(10 * k + e, k) for k in range(4) for e in (0, 9, 6)} <= got and not any(d >= 1000 for d, _ in got)
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for d, k in got if k < 6}


def test_many_substitutions(spark):
    """Every fifth token of an item replaced: nearly all are found."""
    rng = random.Random(6)
    v = vocabulary(rng, 3000)
    items = [(k, " ".join(rng.choice(v) for _ in range(30))) for k in range(60)]
    rows = []
    for k, text in items:
        w = text.split()
        for j in rng.sample(range(30), 6):
            w[j] = rng.choice(v)
        rows.append((k, " ".join([rng.choice(v) for _ in range(20)] + w + [rng.choice(v) for _ in range(20)]), None, None, None))
    bench, df = spark.createDataFrame(items, ITEMS), spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench).collect()}
    assert got == {(r[0], k) for r in rows for k, t in items if holds(r[1], t)} and len(got) >= 45


def test_repetitive_texts_in_bounded_memory():
    import tracemalloc

    item = pa.array(["the " * 300])
    b = decontam.tokens(item).hashes()
    for text in ("the " * 20000, "the of " * 10000):
        tracemalloc.start()
        a = decontam.tokens(pa.array([text])).hashes()
        got = decontam.longest(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150_000_000 and (got is None if " of" in text else got[:2] == (300, 300))


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six seven eight nine ten eleven"), (3, "long " * 40), (3, "one two")], ITEMS)
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs(spark), bench).collect()}
    assert got == {(5, None), (8, 3), (5, 3)}
    assert decontam.find_overlaps(docs(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert decontam.find_overlaps(spark.createDataFrame([], SCHEMA), bench).count() == 0
    df = docs(spark).selectExpr("*", "1 as item", "'k' as key", "2 as seeds", "3 as item_id")
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and left.count() == 6
