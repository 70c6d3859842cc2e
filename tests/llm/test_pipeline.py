import corpus_pipeline
from foldmill.llm import lines, simhash, toxicity
from foldmill.llm.learning import crc_fold
from tests.llm.helpers import SCHEMA, docs
from tests.llm.test_decontam import holds
from tests.llm.test_near_sets import survivors


def test_stages_take_effect(spark, small):
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    columns, got = docs_.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, small)
        got[name] = out.collect()
        if name != "mixing":
            assert out.columns == columns and out.schema == docs_.schema
        docs_ = spark.createDataFrame(got[name], out.schema)
    first = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where(crc_fold("doc_id", 3) != 1)
    scored = {r.doc_id: r.score for r in toxicity.score(first, toxicity.fit(first, labels)).collect()}
    assert {r.doc_id for r in got["toxicity"]} == {d for d, s in scored.items() if s < toxicity.THRESHOLD}
    kept = spark.createDataFrame(got["toxicity"], first.schema)
    want = {r.doc_id: (r.kept, len(r.kept) if r.n_removed else None) for r in lines.remove_lines(kept).collect() if r.n_removed < r.n_lines or not r.n_removed}
    chars = {r.doc_id: r.n_chars for r in got["toxicity"]}
    assert {r.doc_id: (r.text, r.n_chars) for r in got["line_dedup"]} == {d: (t, chars[d] if n is None else n) for d, (t, n) in want.items()}
    assert {r.doc_id for r in got["near_dedup"]} == survivors([(r.doc_id, r.text) for r in got["line_dedup"]])
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in got["decontamination"]} == {r.doc_id for r in got["near_dedup"] if not any(holds(r.text, i) for i in items)}
    assert len(got["mixing"]) == len(got["decontamination"])


def test_run_matches_the_stages(spark, small):
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = spark.createDataFrame((out := stage(spark, docs_, small)).collect(), out.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, docs_.collect()))


def test_awkward_rows(spark):
    df = docs(spark)
    once = simhash.one_of_each(df)
    assert once.dtypes == df.dtypes
    assert sorted(map(str, (r.doc_id for r in once.collect()))) == sorted(map(str, [1, 4, 5, None, 7, 8]))
    cut = lines.without_lines(df)
    assert cut.columns == df.columns and [r.text for r in cut.where("doc_id = 1").collect()] == [None]
    assert cut.count() == 9
    for f in (simhash.one_of_each, lines.without_lines):
        assert f(spark.createDataFrame([], SCHEMA)).count() == 0
