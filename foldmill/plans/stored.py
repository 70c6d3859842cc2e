"""Queries that go through files: tables are written by the sinks, read back by the sources, and aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions import tokens
from foldmill.operators import apps, sinks
from foldmill.operators.crossing import cross_queries
from foldmill.plans.catalog import PARTITIONS, SQL_BYTE_SUM, SQL_COUNTS, SQL_WORDS, query, sql_tokens, table, word_counts
from foldmill.plans.config import configured
from foldmill.plans.job import Job
from foldmill.plans.lineage import fresh_path
from foldmill.sources import readers

#: The query words of the stored list.
LISTED = ("ironic", "the", "der", "la")


def text_files(df: DataFrame, value: Column, folder: str | None = None) -> str:
    """The path of text files with one row each; with ``folder``, one file in a folder for each of that column's values."""
    path, spark = fresh_path(df.sparkSession), df.sparkSession
    rows = df.select(value.alias("value"), *([folder] if folder else []))
    if folder:
        spread = rows.repartition(spark.sparkContext.defaultParallelism, folder)
        spread.write.partitionBy(folder).text(path)
    else:
        rows.write.text(path)
    return path


ORDER_LINE = "concat_ws(' ', o_orderpriority, o_orderstatus, o_orderkey)"


def order_lines(spark: SparkSession, sf_dir: str) -> str:
    return text_files(table(spark, sf_dir, "orders"), F.expr(ORDER_LINE))


def customers(spark: SparkSession, sf_dir: str) -> str:
    """A file of lines for each nation: names and market segments of its customers."""
    return text_files(table(spark, sf_dir, "customer"), F.concat_ws(" ", "c_name", "c_mktsegment"), "c_nationkey")


def nation_of(file: Column) -> Column:
    return F.regexp_extract(file, r"c_nationkey=(\d+)", 1).cast("int")


@query(f"select key, count(*)::bigint as n from (select unnest({sql_tokens(ORDER_LINE)}) as key from orders) group by key")
def source_chunk(spark, sf_dir):
    return Job(apps.count_spec(text="value"), path=order_lines(spark, sf_dir), mode="chunk").run(spark)


@query(f"select f[1] as key, count(*)::bigint as n, sum(len(f))::bigint as fields from (select {sql_tokens(ORDER_LINE, tokens.BLANKS)} as f from orders) group by 1")
def source_local(spark, sf_dir):
    fields = readers.read(spark, "local", order_lines(spark, sf_dir)).select(F.get("fields", F.lit(0)).alias("key"), F.size("fields").alias("k"))
    return fields.groupBy("key").agg(F.count("*").alias("n"), F.sum("k").alias("fields"))


@query("select c_nationkey as nation, sum(strlen(concat_ws(' ', c_name, c_mktsegment)) + 1)::bigint as bytes, count(*)::bigint as lines from customer group by c_nationkey")
def source_file(spark, sf_dir):
    found = readers.read(spark, "file", customers(spark, sf_dir))
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return found.groupBy(nation_of(F.col("name")).alias("nation")).agg(F.sum(F.length("content")).alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query(f"""select key, array_to_string(list_transform(list_sort(list(distinct c_nationkey)), lambda x: x::varchar), ' ') as books from (
    select c_nationkey, unnest({sql_tokens("concat_ws(' ', c_name, c_mktsegment)")}) as key from customer) group by key""")
def source_filechunk(spark, sf_dir):
    named = readers.read(spark, "filechunk", customers(spark, sf_dir), delimiters=tokens.WORDS)
    books = F.array_sort(F.collect_set(nation_of(F.col("file"))))
    return named.groupBy(F.col("token").alias("key")).agg(F.array_join(books.cast("array<string>"), " ").alias("books"))


@query("select c_nationkey as nation, c_mktsegment as segment, count(*)::bigint as n from customer group by all")
def source_records(spark, sf_dir):
    fields = readers.read(spark, "records", customers(spark, sf_dir)).select(F.get("fields", F.lit(1)).alias("segment"), nation_of(F.element_at("fields", -1)).alias("nation"))
    return fields.groupBy("nation", "segment").agg(F.count("*").alias("n"))


@query(f"""select ((({SQL_BYTE_SUM}) % {PARTITIONS} + {PARTITIONS}) % {PARTITIONS})::int as pid, key, sum(n)::bigint as n
    from ({SQL_COUNTS} union all select key, count(*)::bigint as n from (select unnest({sql_tokens('text')}) as key from benchmark) group by key) group by 1, 2""")
def stored_aggregates(spark, sf_dir):
    """Partial aggregates of two tables, saved in partitions, read back in series and merged."""
    first, second = fresh_path(spark), fresh_path(spark)
    sinks.partitioned(word_counts(spark, sf_dir), first, PARTITIONS)
    sinks.partitioned(Job("word_count", table(spark, sf_dir, "benchmark")).run(spark), second, PARTITIONS)
    both = readers.aggregates(spark, first).unionByName(readers.aggregates(spark, second))
    return both.groupBy(F.col("pid").cast("int").alias("pid"), "key").agg(F.sum("n").alias("n"))


@query(f"""select query, source, count(*)::bigint as records, sum((key = query)::int)::bigint as hits from
    (select source, unnest({sql_tokens("text")}) as key from documents) cross join (select unnest({list(LISTED)}) as query) group by query, source""")
def stored_word_queries(spark, sf_dir):
    """Words from a list in a file, with blank lines, crossed with records."""
    lines = spark.createDataFrame([(x,) for w in LISTED for x in (w, "", f"  ")], "value string")
    asked = readers.queries(spark, text_files(lines, F.col("value")))
    words = table(spark, sf_dir, "documents").select("source", F.explode(tokens.tokens(F.col("text"))).alias("key"))
    crossed = cross_queries(words.groupBy("source", "key").agg(F.count("*").alias("n")), asked)
    hits = F.sum(F.when(F.col("key") == F.col("query"), F.col("n")).otherwise(0))
    return crossed.groupBy("query", "source").agg(F.sum("n").alias("records"), hits.alias("hits"))


@query("""select n_name as name, c_nationkey as nation, contains(lines, chr(10) || 'Customer#00000' || lpad((n_nationkey + 1)::varchar, 4, '0') || ' ') as found
    from nation cross join (select c_nationkey, chr(10) || string_agg(concat_ws(' ', c_name, c_mktsegment), chr(10)) as lines from customer group by c_nationkey)""")
def stored_file_queries(spark, sf_dir):
    """Files that a list names, with their contents, crossed with records."""
    names = readers.files(spark, customers(spark, sf_dir)).select("name")
    asked = readers.queries(spark, text_files(names, F.col("name")), "file")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.format_string("\nCustomer#00000%04d ", F.col("n_nationkey") + 1).alias("wanted"))
    text = F.concat(F.lit("\n"), F.decode("content", "UTF-8"))
    crossed = cross_queries(rows, asked.withColumnRenamed("query", "file"))
    return crossed.groupBy("name", nation_of(F.col("file")).alias("nation")).agg(F.bool_or(F.contains(text, F.col("wanted"))).alias("found"))


def stored_result(kind: str, spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark)
    sinks.write_result(word_counts(spark, sf_dir).select("key", "n"), path, kind)
    return path


@query(SQL_COUNTS)
def result_parquet(spark, sf_dir):
    return spark.read.parquet(stored_result("parquet", spark, sf_dir))


@query(SQL_COUNTS)
def result_csv(spark, sf_dir):
    return spark.read.option("header", True).schema("key string, n long").csv(stored_result("csv", spark, sf_dir))


@query(f"select key || chr(9) || n as value from ({SQL_COUNTS})")
def result_tab(spark, sf_dir):
    return spark.read.text(stored_result("tab", spark, sf_dir))


@query(f"select key || ' ' || n as value from ({SQL_COUNTS})")
def result_text(spark, sf_dir):
    return spark.read.text(stored_result("text", spark, sf_dir))


@query(f"select key, (3 * count(*))::bigint as n from (select unnest({sql_tokens(ORDER_LINE, tokens.BLANKS)}) as key from orders) group by key")
def configured_job(spark, sf_dir):
    """From a configuration: records crossed with three queries, no combining before the shuffle, numbers of tasks."""
    options = f"""
    input.path = {order_lines(spark, sf_dir)}
    input.delimiter = " \\n\\r\\t"
    input.query = one two three
    map.tasks = 5
    reduce.tasks = 3
    aggregate.combine = false
    """
    return configured(options, spark).job.run(spark)


@query(SQL_COUNTS)
def uncombined_count(spark, sf_dir):
    return Job("word_count", table(spark, sf_dir, "documents"), combine=False, reducers=PARTITIONS).run(spark)
