"""Sinks: partitioned partial aggregates, results, and text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmill.functions.scalars import partition_of
from foldmill.plans.lineage import cut


def with_partition(df: DataFrame, n: int, key: str = "key", kind: int = 0) -> DataFrame:
    """df with ``pid``, the partition of its key."""
    return df.withColumn("pid", partition_of(F.col(key), n, kind))


def partitioned(df: DataFrame, path: str, n: int, key: str = "key", kind: int = 0, mode: str = "errorifexists") -> None:
    """One folder of files for each partition of the key; a hot partition's rows may be in several files."""
    with_partition(df, n, key, kind).write.mode(mode).partitionBy("pid").parquet(path)


def placed(df: DataFrame, partition: str, key: str) -> DataFrame:
    """df with ``place``, each row's number from 1 within its partition in order of the key.

    Rows are sorted by ranges, as many as Spark makes, however few partitions there are;
    a range's rows are numbered behind the counts of the ranges before it.
    """
    ranged = cut(df.repartitionByRange(partition, key).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(partition).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(partition, "range").agg(F.count("*").alias("many"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    own = F.row_number().over(Window.partitionBy(partition, "range").orderBy(key))
    return ranged.withColumn("own", own).join(counts, [partition, "range"]).withColumn("place", (F.col("ahead") + F.col("own")).cast("long")).drop("own", "ahead", "range")


def text_rows(df: DataFrame, separator: str = " ") -> DataFrame:
    """(value): each row's columns as one text row."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def length_prefixed(df: DataFrame) -> DataFrame:
    """(value): each row as JSON bytes behind their number in 4 bytes, the highest first."""
    body = F.encode(F.to_json(F.struct(*df.columns)), "UTF-8")
    return df.select(F.concat(F.unhex(F.lpad(F.hex(F.length(body)), 8, "0")), body).alias("value"))


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """``parquet``, ``csv``, ``tab`` (key, tab, count) or ``text`` (key, space, value)."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind in ("tab", "text"):
        text_rows(df, "\t" if kind == "tab" else " ").write.mode(mode).text(path)
    else:
        raise ValueError(f"no sink of kind {kind!r}")
