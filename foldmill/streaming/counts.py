"""Counts of a stream: the same specifications, merged as records come."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from foldmill.plans.spec import AggSpec


def aggregate_stream(stream: DataFrame, spec: AggSpec) -> DataFrame:
    """The running aggregate; write it in ``update`` or ``complete`` mode."""
    return spec.finished(spec.merged(spec.created(stream)))


def to_table(aggregated: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataStreamWriter:
    """A writer that adds the table after each batch as a folder of ``path``, for as long as there is input.

    A repeated batch replaces its own folder; the one before stays for those who read it, older ones go.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        files, found = _batches(spark, path)
        for old in sorted(n for n in found if n < number)[:-1]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{old}"), True)

    return aggregated.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True)


def _batches(spark: SparkSession, path: str):
    """The file system of ``path``, and the numbers of its complete batches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath()) for f in files.listStatus(at)] if files.exists(at) else []
    done = [n for n in names if re.search(r"/batch-\d+$", n) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
    return files, [int(n.rpartition("-")[2]) for n in done]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table of the last complete batch."""
    _, found = _batches(spark, path)
    if not found:
        raise ValueError(f"no complete batch in {path}")
    return spark.read.parquet(f"{path}/batch-{max(found)}")
