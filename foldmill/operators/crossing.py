"""Crossing records with a list of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries up to this number are sent to all tasks; a longer list is crossed in slices of so many.
MOST_QUERIES = 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt evenly by a key where their files give fewer tasks than there are cores; the work on a row of a crossing far outweighs moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(3 * cores, key)


def cross_queries(rows: DataFrame, queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """Each record with each query, the query's columns behind the record's.

    A query list is a parameter of a job. Its size is checked: up to ``most`` rows
    it is broadcast, else it is dealt into slices that are broadcast one by one.
    """
    clash = set(rows.columns) & set(queries.columns)
    if clash:
        raise ValueError(f"records and queries share the columns {', '.join(sorted(clash))}")
    n = queries.count()
    if n <= most:
        return rows.crossJoin(F.broadcast(queries))
    slices, names = -(-n // most), queries.columns
    dealt = queries.withColumn("__slice", F.pmod(F.xxhash64(*names), F.lit(slices)))
    out = None
    for k in range(slices):
        one = rows.crossJoin(F.broadcast(dealt.where(F.col("__slice") == k).select(*names)))
        out = one if out is None else out.unionByName(one)
    return out
