"""Runs, deltas, and hashes of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def run_lengths(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in each group: group, run (from 0), value, length."""
    by = Window.partitionBy(*group).orderBy(*order)
    before = F.lag(value).over(by)
    starts = ((F.row_number().over(by) == 1) | ~F.col(value).eqNullSafe(before)).cast("int")
    marked = df.withColumn("__starts", starts).withColumn("run", F.sum("__starts").over(by) - 1)
    return marked.groupBy(*group, "run", value).agg(F.count("*").alias("length"))


def expand_runs(runs: DataFrame, group: list[str], value: str) -> DataFrame:
    """The inverse of run_lengths: group, place (from 0), value."""
    by = Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    begun = runs.withColumn("__begin", F.coalesce(F.sum("length").over(by), F.lit(0)))
    places = F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)
    return begun.select(*group, value, "__begin", F.explode(places).alias("__k")).select(*group, (F.col("__begin") + F.col("__k")).alias("place"), value)


def deltas(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """df with ``delta``: the difference to the value before; the first value itself."""
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*group).orderBy(*order)), F.lit(0)))


def undeltas(df: DataFrame, group: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """df with ``value``, the running sum of its deltas."""
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("value", F.sum(delta).over(by))


def bit_width(value: Column) -> Column:
    """Bits that a non-negative number takes, one at least."""
    return F.greatest(F.length(F.bin(value)), F.lit(1))


def median(values: Column) -> Column:
    """The middle of the sorted values, the mean of the two middle ones for an even number."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def threshold_bits(values: Column) -> Column:
    """A string of 0 and 1: whether each value is above the median."""
    above = lambda m: F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > m, "1").otherwise("0")), "")
    return F.get(F.transform(F.array(median(values)), above), F.lit(0))


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix."""
    m = np.sqrt(2.0 / n) * np.cos(np.pi / n * np.arange(n)[:, None] * (np.arange(n)[None, :] + 0.5))
    m[0] = 1.0 / np.sqrt(n)
    return m


def perceptual_hash(image: Column, side: int = 32) -> Column:
    """64 bits of a grey image of side x side values: which of the lowest 8 x 8 frequencies (without the very lowest) exceed their median."""

    @pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = dct_matrix(side)
        for part in parts:
            out = pd.Series([None] * len(part), dtype="Int64")
            known = part.map(lambda v: v is not None and len(v) == side * side).to_numpy(bool)
            if known.any():
                x = np.stack(part[known].to_numpy()).astype(float).reshape(-1, side, side)
                low = (m @ x @ m.T)[:, 1:9, 1:9].reshape(len(x), 64)
                bits = low > np.median(low, axis=1, keepdims=True)
                out[known] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield out

    return run(image)
