"""Compressed bytes and packed numbers, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _each(f, kind: str):
    @pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda v: None if v is None else f(v))

    return run


def compressed(data: Column, level: int = 6) -> Column:
    """The bytes as a zlib stream."""
    return _each(lambda v: zlib.compress(bytes(v), level), "binary")(data)


def uncompressed(data: Column) -> Column:
    return _each(lambda v: zlib.decompress(bytes(v)), "binary")(data)


def pack_sorted(values: list[int]) -> bytes:
    """Ascending numbers as the bits per part, their number, and their differences: each in parts of so many bits, the lowest
    first, behind each a bit that says whether more follow."""
    v = np.asarray(values, np.int64)
    d = np.diff(v, prepend=0)
    if len(d) and d.min() < 0:
        raise ValueError("packed numbers must ascend from 0")
    width = max(1, int(np.median(np.frexp(d.astype(float))[1]))) if len(d) else 1
    parts = np.maximum(1, -(-np.frexp(d.astype(float))[1] // width)).astype(np.int64)
    number = np.repeat(np.arange(len(d)), parts)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    part = (d[number] >> (place * width)) & ((1 << width) - 1)
    bits = np.concatenate([(part[:, None] >> np.arange(width)) & 1, (place < parts[number] - 1)[:, None].astype(np.int64)], axis=1)
    return bytes([width]) + len(d).to_bytes(4, "big") + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_sorted(data: bytes) -> list[int]:
    width, n = data[0], int.from_bytes(data[1:5], "big")
    if not n:
        return []
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=5))
    bits = bits[: len(bits) // (width + 1) * (width + 1)].reshape(-1, width + 1)
    ends = np.flatnonzero(bits[:, -1] == 0)[:n]
    bits = bits[: ends[-1] + 1]
    part = (bits[:, :-1].astype(np.int64) << np.arange(width)).sum(axis=1)
    first = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(bits)) - np.repeat(first, ends - first + 1)
    return np.cumsum(np.add.reduceat(part << (place * width), first)).tolist()


def packed(values: Column) -> Column:
    """An ascending array of numbers as packed differences."""
    return _each(lambda v: pack_sorted(list(v)), "binary")(values)


def unpacked(data: Column) -> Column:
    return _each(lambda v: unpack_sorted(bytes(v)), "array<long>")(data)
