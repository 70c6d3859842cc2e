import random

import numpy as np
import xxhash

from foldmill.llm import simhash
from tests.llm.helpers import SCHEMA, docs, words


def brute(text, shingle=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, most):
    ids = {}
    for i, f in prints:
        ids.setdefault(f, []).append(i)
    left, out = set(ids), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            f = front.pop()
            group.add(f)
            near = {g for g in left if (f ^ g).bit_count() <= most}
            left -= near
            front += near
        known = [i for f in group for i in ids[f] if i is not None]
        out |= {f: min(known) if known else None for f in group}
    return sorted((i is None, i, f, out[f]) for i, f in prints)


def same(spark, df, rows):
    got = [(r.doc_id is None, r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(classes([(r[0], brute(r[1])) for r in rows], 4), key=str)


def test_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    same(spark, df, [(r.doc_id, r.text) for r in df.collect()])


def test_awkward_rows(spark):
    df = docs(spark)
    same(spark, df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_dense_cells():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 9) for _ in range(150)} | {rng.getrandbits(64) for _ in range(300)}
    fps = np.array(sorted(fps), np.uint64)
    cell, fp = simhash.cells_of(fps)
    for cell, fp in ((cell, fp), simhash.subcells_of(cell, fp)):
        a, b = simhash.cell_edges(cell, fp, 4)
        assert (np.bitwise_count(a ^ b) <= 4).all()
        node, root = simhash.local_roots(a, b)
        want = classes([(int(f), int(f)) for f in fps], 4)
        root = dict(zip(node.tolist(), root.tolist(), strict=True))
        assert [(False, int(f), int(f), root.get(int(f), int(f))) for f in fps] == want


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500, dtype=np.uint64))
    assert (np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b)) <= np.bitwise_count(a ^ b)).all()
