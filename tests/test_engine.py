import random

import pytest
from pyspark.sql import functions as F

from foldmill.operators import apps, sinks
from foldmill.operators.crossing import cross_queries
from foldmill.plans import catalog
from foldmill.plans.config import configured, parse
from foldmill.plans.job import Job
from foldmill.plans.spec import AggSpec, lookup, register, registered
from foldmill.sources import readers
from foldmill.streaming.counts import aggregate_stream, latest, to_table


def texts(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "source string, text string")


def counts(df):
    return {r.key: r.n for r in df.collect()}


def test_doubling(spark):
    text = "hello  "
    for _ in range(3):
        text += text
    assert counts(Job("word_count", texts(spark, text)).run(spark)) == {"hello": 8}


def test_counts(spark):
    df = texts(spark, "a b a b", "a", "", None, "a b c d")
    assert counts(Job("word_count", df).run(spark)) == {"a": 4, "b": 3, "c": 1, "d": 1}
    assert counts(Job("bigram_count", df).run(spark)) == {"a-b": 3, "b-a": 1, "b-c": 1, "c-d": 1}
    assert counts(Job("trigram_count", df).run(spark)) == {"a-b-a": 1, "b-a-b": 1, "a-b-c": 1, "b-c-d": 1}
    assert counts(Job("field_count", texts(spark, "k1 x\nk2 y\n\nk1 z")).run(spark)) == {"k1": 2, "k2": 1}
    assert counts(Job("line_count", texts(spark, "x y\nz\r\nx y")).run(spark)) == {"x y": 2, "z": 1}


@pytest.mark.parametrize("name", ["word_count", "bigram_count", "inverted_index", "similarity_buckets"])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_merge_laws(spark, name, parts):
    rng = random.Random(parts)
    rows = [(f"s{i % 5}", " ".join(rng.choice("abcde") for _ in range(i % 9)), f"{i * 7919 % 997:08x}", f"n{i}") for i in range(60)]
    mixed = rng.sample(rows, len(rows))
    make = lambda r: spark.createDataFrame(r, "source string, text string, digest string, name string")
    run = lambda df: sorted(map(str, Job(name, df).run(spark).collect()))
    assert run(make(rows)) == run(make(mixed).repartition(parts))


def test_index(spark):
    df = spark.createDataFrame([("f2", "w"), ("f1", "w w"), ("f2", "w v")], "source string, text string")
    assert {r.key: r.books for r in Job("inverted_index", df).run(spark).collect()} == {"w": ["f1", "f2"], "v": ["f2"]}


def test_rank_step(spark):
    nodes = spark.createDataFrame([("A", 1.0, ["B", "C"]), ("B", 1.0, ["C"]), ("C", 1.0, [])], "key string, rank double, links array<string>")
    assert {r.key: r["rank"] for r in Job("rank", nodes, rounds=1).run(spark).collect()} == {"B": 0.5, "C": 1.5}
    links = nodes.select("key", "links")
    assert {r.key: r["rank"] for r in apps.ranks(links, 2).collect()} == {"C": 0.5}
    assert {r.key: round(r["rank"], 6) for r in apps.ranks(links, 2, 0.5, cut_every=1).collect()} == {"A": 0.5, "B": 0.625, "C": 1.0}


def test_nearest(spark):
    df = spark.createDataFrame([("q", k, d) for k, d in (("a", 3), ("b", 1), ("c", 1), ("d", 2))], "query string, key string, distance int")
    assert [(r.key, r.place) for r in apps.nearest(df, 2).orderBy("place").collect()] == [("b", 1), ("c", 2)]


def test_crossing(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "a int")
    queries = spark.createDataFrame([(i,) for i in range(5)], "b int")
    assert cross_queries(rows, queries).count() == 35
    assert sorted(map(tuple, cross_queries(rows, queries, 2).collect())) == [(a, b) for a in range(7) for b in range(5)]
    with pytest.raises(ValueError):
        cross_queries(rows, rows)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("a b\n\nc\r\n")
    (tmp_path / "in" / "y.txt").write_text("a, b\n")
    path = str(tmp_path / "in")
    assert sorted(r.value for r in readers.read(spark, "chunk", path).collect()) == ["", "a b", "a, b", "c"]
    assert sorted(r.fields for r in readers.read(spark, "local", path).collect()) == [["a", "b"], ["a,", "b"], ["c"]]
    assert sorted(bytes(r.content) for r in readers.read(spark, "file", path).collect()) == [b"a b\n\nc\r\n", b"a, b\n"]
    named = readers.read(spark, "filechunk", path, delimiters=" ,\n").collect()
    assert sorted((r.token, r.file[-5:]) for r in named) == [("a", "x.txt"), ("a", "y.txt"), ("b", "x.txt"), ("b", "y.txt"), ("c", "x.txt")]
    assert sorted(r.fields[:-1] for r in readers.read(spark, "records", path).collect()) == [["a", "b"], ["a,", "b"], ["c"]]
    (tmp_path / "q.txt").write_text("one\n\n two \n")
    assert sorted(r["query"] for r in readers.queries(spark, str(tmp_path / "q.txt")).collect()) == ["one", "two"]
    (tmp_path / "qf.txt").write_text(f"{path}/x.txt\n")
    assert [bytes(r.content) for r in readers.queries(spark, str(tmp_path / "qf.txt"), "file").collect()] == [b"a b\n\nc\r\n"]
    with pytest.raises(ValueError):
        readers.read(spark, "tape", path)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("abc", 1), ("é", 2), ("zz", 3)], "key string, n long")
    sinks.partitioned(df, str(tmp_path / "p"), 4)
    assert sorted((r.key, r.pid) for r in readers.aggregates(spark, str(tmp_path / "p")).collect()) == [("abc", 2), ("zz", 0), ("é", 0)]
    sinks.write_result(df, str(tmp_path / "t"), "tab")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["abc\t1", "zz\t3", "é\t2"]
    body = bytes(sinks.length_prefixed(df).first().value)
    assert int.from_bytes(body[:4], "big") == len(body) - 4 and body[4:] == b'{"key":"abc","n":1}'
    job = Job("word_count", path=str(tmp_path / "t"), mode="chunk", source=spark.read.text(str(tmp_path / "t")).toDF("text"))
    assert job.save(spark, str(tmp_path / "r"))["rows"] == 6
    with pytest.raises(ValueError):
        sinks.write_result(df, str(tmp_path / "z"), "punched cards")


def test_specs(spark):
    assert {"word_count", "rank"} <= set(registered())
    own = AggSpec(create=lambda: F.array(F.struct(F.length("text").alias("key"), F.lit(1).alias("n"))), merge={"n": lambda: F.sum("n")}, finish={"twice": lambda: F.col("n") * 2})
    register("test_lengths", own)
    assert {r.key: r.twice for r in Job("test_lengths", texts(spark, "a", "bb", "cc", None)).run(spark).collect()} == {1: 2, 2: 4}
    assert lookup("foldmill.plans.catalog:EVENT_TOTALS") is catalog.EVENT_TOTALS
    for bad in (lambda: register("word_count", own), lambda: Job("word_count").run(spark), lambda: Job("word_count", texts(spark, "a"), strategy="guess").run(spark)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        lookup("nothing")


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("a b\na\n")
    stream = lambda: aggregate_stream(spark.readStream.text(str(source)).toDF("text"), apps.count_spec())
    for more, want in ((None, {"a": 2, "b": 1}), ("b c\n", {"a": 2, "b": 2, "c": 1})):
        if more:
            (source / "b.txt").write_text(more)
        to_table(stream(), str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination(60)
        assert counts(latest(spark, str(tmp_path / "out"))) == want


def test_configuration(spark, tmp_path):
    (tmp_path / "in.txt").write_text("k1 x\nk2 y\nk1 x\n")
    path = tmp_path / "in.txt"
    assert counts(configured({"input": {"path": str(path)}}).job.run(spark)) == {"k1 x": 2, "k2 y": 1}
    text = f'# counts\ninput.path = {path}\ninput.delimiter = " \\n"\naggregate.grams = 2\naggregate.strategy = hashsort\noutput.kind = tab\n'
    made = configured(text)
    assert (made.kind, made.output) == ("tab", None) and counts(made.job.run(spark)) == {"k1-x": 2, "k2-y": 1}
    assert counts(configured({"input": {"path": str(path), "delimiter_second": " "}}).job.run(spark)) == {"k1": 2, "k2": 1}
    (tmp_path / "c.cfg").write_text(text)
    assert configured(tmp_path / "c.cfg").job.rounds == 0
    crossed = configured({"input": {"path": str(path), "query": ["q", "r"]}, "aggregate": {"combine": False}, "reduce": {"tasks": 2}, "map": {"tasks": 3}}, spark)
    assert counts(crossed.job.run(spark)) == {"k1 x": 4, "k2 y": 2} and not crossed.job.combine
    (tmp_path / "names.txt").write_text(f"{path}\nfile:{path}\n")
    listed = configured({"input": {"path": str(path), "query_file": str(tmp_path / "names.txt"), "query_kind": "file"}}, spark)
    assert {bytes(r.content) for r in listed.job.queries.collect()} == {path.read_bytes()}
    assert counts(listed.job.run(spark)) == {"k1 x": 4, "k2 y": 2}
    for bad in (lambda: configured({"input": {"speed": 3}}), lambda: parse("nothing"), lambda: configured({"input": {"path": str(path), "query": "x"}}), lambda: configured({"aggregate": {"combine": "maybe"}})):
        with pytest.raises(ValueError):
            bad()
