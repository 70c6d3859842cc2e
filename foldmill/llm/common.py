"""What the operators share: byte-level tokenising of Arrow batches, hashes of spans, tables in the shared folder.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r; UTF-8 never
has these inside a longer character. Texts are handled as the bytes of an Arrow
column, many documents at a time, so that no step loops over words in Python.
"""

from __future__ import annotations

import ctypes
import pickle
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: An odd multiplier for the prefix hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are tokenised at a time (a longer document is handled alone), and that one prefix sum covers.
CHUNK_BYTES, HASH_BYTES = 1 << 20, 1 << 18
#: Rows and bytes of an Arrow batch, rows that the Parquet reader and bytes that its writer hold: long documents then still fit in memory.
BATCH_ROWS, BATCH_BYTES, READ_ROWS, WRITE_BYTES = 500, 1 << 22, 512, 1 << 24
#: Spark then deletes a query's shuffle files as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Cache(list):
    """A list that is empty wherever it is sent: what the driver has made stays out of the functions pickled for tasks."""

    def __reduce__(self):
        return Cache, ()


_powers: list[np.ndarray] = Cache()
_libc: list[Callable] = Cache()
_calls = [0]
TIDY = 2
_scratch: list[list] = []


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators, and the batches that they are made from."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and its rows outlive the executors.

    The shuffle files behind it are of no more use and go at once. The table goes at
    the end of the innermost ``scratch``, or with ``keep`` of the one around that; else with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldmill/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", WRITE_BYTES).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    files, at = _file(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end, unless they are kept for what is around it; values sent inside go too."""
    _scratch.append([])
    try:
        yield
    finally:
        for used in _scratch.pop():
            if isinstance(used, str):
                files, at = _file(spark, used)
                files.delete(at, True)
            else:
                used.destroy()


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them where columns are called so already (in whatever case)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def tidy() -> None:
    """Hand memory that this worker has freed back to the machine, every now and then."""
    _calls[0] += 1
    if _calls[0] % TIDY:
        return
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):
            _libc.append(lambda _: 0)
    _libc[0](0)


class Sent:
    """A value sent to all tasks, by value with its classes, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        self.held = spark.sparkContext.broadcast(zstandard.ZstdCompressor(1).compress(cloudpickle.dumps(value)))
        self.made: list[object] = Cache()
        # by the module's name, so that the list isn't pickled with this class
        frames = sys.modules["foldmill.llm.common"]._scratch
        if frames:
            frames[-1].append(self.held)

    @property
    def value(self):
        if not self.made:
            self.made.append(pickle.loads(zstandard.ZstdDecompressor().decompress(self.held.value)))
        return self.made[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 4 * HASH_BYTES + 1)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, b, U64))]) for b in (BASE, BASE_INV)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one prefix sum over the bytes.

    Spans in order of their starts over long data are hashed part by part, in little memory.
    """
    if len(data) > 2 * HASH_BYTES and len(start) > 1:
        cut = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), HASH_BYTES)), len(start)))
        out = np.empty(len(start), U64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            lo, hi = start[a], end[a:b].max()
            if hi - lo <= 4 * HASH_BYTES:
                out[a:b] = one_prefix(data[lo:hi], start[a:b] - lo, end[a:b] - lo)
            else:
                out[a:b] = [one_prefix(data[x:y], np.zeros(1, np.int64), np.array([y - x]))[0] for x, y in zip(start[a:b], end[a:b], strict=True)]
        return out
    return one_prefix(data, start, end)


def one_prefix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(BASE))


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each position where n are left."""
    if len(word) < n:
        return np.empty(0, U64)
    out = np.zeros(len(word) - n + 1, U64)
    for k in range(n):
        out = out * U64(BASE) + word[k : len(word) - n + 1 + k]
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty texts, and the n+1 offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    off = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: start and end bytes, row, and per row the first word's number."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        self.data, self.off = data, off
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(off) - 1), self.count)
        self.hashed: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        if self.hashed is None:
            self.hashed = span_hashes(self.data, self.start, self.end)
        return self.hashed

    def starts_of(self, n: int) -> np.ndarray:
        """Whether n words of the same row begin at each word."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.start))
        return left >= n

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts with one space after each word, and the words' starts and ends in them."""
        word = ~SPACE[self.data]
        length = self.end - self.start
        end = np.cumsum(length + 1) - 1
        out = np.full(int(length.sum()) + len(length), 32, np.uint8)
        fill = np.ones(len(out), bool)
        fill[end] = False
        out[fill] = self.data[word]
        return out.tobytes(), end - length, end


def of_rows(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Words:
    return Words(*text_bytes(batch.column(batch.schema.get_field_index(column))), lower=lower)


def table(batch_like: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_like[f.name], f.type) for f in schema], schema=schema)
