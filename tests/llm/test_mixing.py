import duckdb
import pytest

from foldmill.llm import mixing, queries, sql
from tests.llm.helpers import SCHEMA, docs, words


def level(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def holds(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = level({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in x)


def test_targets_and_budgets(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op7_source_mixing(spark, small).collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(words(r.text)) for r in df.collect()}
    holds(mixing.mix_sources(df).collect())


def test_same_as_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got = queries.op7_source_mixing(spark, small)
    want = con.sql(sql.OP7)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    df = docs(spark).drop("size", "weight", "target")
    a, b = (mixing.mix_sources(df.repartition(n), labels).collect() for n in (1, 5))
    assert len(a) == 9 and sorted(map(str, a)) == sorted(map(str, b))
    holds(a)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_better_documents_come_first(spark):
    rows = [(i, "w " * 10, None, "s" if i < 4000 else "t", 1) for i in range(5000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), labels).collect()
    extra = [[r.taken - r.epochs * r.size for r in out if r.doc_id % 2 == k and r.source == "s"] for k in (0, 1)]
    assert sum(extra[1]) > 1.2 * sum(extra[0])
