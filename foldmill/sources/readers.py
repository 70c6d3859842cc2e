"""Sources: lines, white-space records, whole files, files with their tokens, saved aggregates, query lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions.tokens import BLANKS, LINES, records, tokens


def lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """(value): records of text files, cut at line ends however the files are split."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path)


def fields(spark: SparkSession, path: str | list[str], delimiters: str = BLANKS) -> DataFrame:
    """(fields): each line's tokens; lines without one are left out."""
    return lines(spark, path).select(tokens(F.col("value"), delimiters).alias("fields")).where(F.size("fields") > 0)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, content): whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def file_tokens(spark: SparkSession, path: str | list[str], delimiters: str = LINES) -> DataFrame:
    """(token, file): the tokens of text files with the name of their file."""
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.select(F.explode(tokens(F.col("value"), delimiters)).alias("token"), "file")


def file_records(spark: SparkSession, path: str | list[str], first: str = LINES, second: str = BLANKS) -> DataFrame:
    """(fields, file): two-level records of text files, the file's name as the last field too."""
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    cut = rows.select(F.explode(records(F.col("value"), first, second)).alias("fields"), "file")
    return cut.select(F.concat("fields", F.array("file")).alias("fields"), "file")


def aggregates(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Partial aggregates that ``sinks.partitioned`` wrote."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def queries(spark: SparkSession, path: str, kind: str = "word") -> DataFrame:
    """A query list: ``word``: (query), one for each line that isn't empty; ``file``: (query, content) of the files that the lines name."""
    listed = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("query"))
    if kind == "word":
        return listed
    if kind != "file":
        raise ValueError(f"no query list of kind {kind!r}")
    # the driver lists the files, as Spark does for any source; names meet contents by their path without the scheme
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    plain = lambda c: F.regexp_replace(c, scheme, "")
    names = sorted({re.sub(scheme, "", r.query): r.query for r in listed.distinct().collect()}.values())
    out = spark.createDataFrame([], "name string, content binary")
    for k in range(0, len(names), FILES_AT_A_TIME):
        out = out.unionByName(files(spark, names[k : k + FILES_AT_A_TIME]))
    return listed.withColumn("at", plain(F.col("query"))).join(out.select(plain(F.col("name")).alias("at"), "content"), "at").select("query", "content")


#: Query files that one scan reads.
FILES_AT_A_TIME = 10_000
MODES = {"chunk": lines, "local": fields, "file": files, "filechunk": file_tokens, "records": file_records}


def read(spark: SparkSession, mode: str, path: str | list[str], **options) -> DataFrame:
    """The source of a mode."""
    if mode not in MODES:
        raise ValueError(f"no input mode {mode!r}; there are {', '.join(MODES)}")
    return MODES[mode](spark, path, **options)
