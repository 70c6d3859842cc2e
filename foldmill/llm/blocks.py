"""Documents packed into compressed blocks, and messages between blocks and shards.

Operators that compare all texts with each other work in rounds: every block
sends what it knows about its keys to the shards of these keys, and every shard
answers the blocks. A block is one row with some megabytes of text, compressed; a
message is one row with packed arrays. Blocks are written once to the shared
folder, so that each round sees the same ones, and shuffling them is cheap.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import U64, Words, batches, shuffle_partitions, text_bytes, tidy, written

#: Bytes of text of a block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 21
#: A null id is written as the largest long, with a flag behind all ids.
NO_ID = np.iinfo(np.int64).max
MESSAGE = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
MESSAGE_DDL = "key long, block long, body binary"
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("rest", pa.binary()), ("index", pa.binary()), ("sketch", pa.binary())])


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one body; their types are for the reader to know. Bytes of one rank stand together, which compresses."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return squeeze(np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(planes))


def unpack_arrays(body: bytes, *kinds: type) -> list[np.ndarray]:
    raw = unsqueeze(body)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n, at).reshape(width, n // width)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n
    return out


def ids_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids, and which of them are null."""
    n = len(body) // 9
    return np.frombuffer(body, np.int64, n), np.frombuffer(body, np.bool_, n, 8 * n)


def blocks_of(docs: DataFrame, index: Callable[[Words], bytes] | None = None, rest: list[str] | None = None, counter: Callable[[], object] | None = None) -> DataFrame:
    """The table of blocks of (doc_id, text), written to the shared folder; nulls are empty texts.

    ``index`` makes a body of a block's words, in lower-case ASCII letters, to be
    kept beside it. What ``counter`` makes gets the words' hashes of a task's blocks
    (``add``), and its body (``body``) follows as a row without a block. Columns named
    in ``rest`` are kept for ``told`` to hand on.
    """
    spark = docs.sparkSession
    batches(spark)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        room, counts = 0, counter() if counter else None

        def flush() -> pa.RecordBatch:
            data = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            made = None
            if index:
                w = Words(data, np.concatenate([[0], np.cumsum(sizes)]), lower=True)
                made = index(w)
                if counts is not None:
                    counts.add(w.hashes())
            ids = np.concatenate([h[0] for h in held]).tobytes() + np.concatenate([h[4] for h in held]).tobytes()
            row = secrets.randbits(62), ids, sizes.tobytes(), squeeze(data.tobytes()), table_bytes([h[3] for h in held]) if rest else None, made, None
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

        for batch in parts:
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, off = text_bytes(batch.column(1))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK_BYTES - room, "right")) - 1)
                if held and off[to] - off[at] + room > BLOCK_BYTES:
                    yield flush()
                    held, room = [], 0
                    continue
                held.append((ids[at:to], data[off[at] : off[to]], np.diff(off[at : to + 1]), batch.slice(at, to - at).select(rest) if rest else None, none[at:to]))
                room += int(off[to] - off[at])
                at = to
        if held:
            yield flush()
        if counts is not None:
            row = *[None] * (len(BLOCK) - 1), counts.body()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

    return written(docs.select(F.col("doc_id").cast("long"), "text", *(c for c in rest or [] if c not in ("doc_id", "text"))).mapInArrow(run, "block long, ids binary, sizes binary, data binary, rest binary, index binary, sketch binary"), keep=True)


def table_bytes(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for part in parts:
            writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def opened(ids: bytes, sizes: bytes, data: bytes, lower: bool = False) -> tuple[np.ndarray, Words]:
    """A block's ids and words; ``w.no_id`` tells which ids are null."""
    off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
    w = Words(np.frombuffer(unsqueeze(data), np.uint8), off, lower=lower)
    own, w.no_id = ids_of(ids)
    return own, w


def shards_for(blocks: DataFrame) -> int:
    """A few shards for each shuffle partition, so that partitions get about as many each; more data have more of both."""
    return 4 * max(shuffle_partitions(blocks.sparkSession), blocks.rdd.getNumPartitions())


def ask(blocks: DataFrame, tell: Callable[..., Iterator[tuple[int, bytes]]], lower: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """One message for each (shard, body) that ``tell`` makes of a block's ids and words, and of the columns named in ``beside``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = list(tell(*opened(row["ids"], row["sizes"], row["data"], lower), *(row[c] for c in beside)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([row["block"]] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], schema=MESSAGE)
                tidy()

    return blocks.select("block", "ids", "sizes", "data", *beside).mapInArrow(run, MESSAGE_DDL)


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its items, in their order."""
    if len(shard):
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut):
            yield int(shard[part[0]]), part


def answer(messages: DataFrame, run: Callable[[list[int], list[bytes]], object], partitions: int, ddl: str = "") -> DataFrame:
    """What ``run`` makes of all messages of a shard: (blocks, bodies) to (block, body); with ``ddl``, to a table of that schema."""

    def group(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("block").to_numpy(), kind="stable").tolist()
        block, body = rows.column("block").to_pylist(), rows.column("body").to_pylist()
        out = run([block[i] for i in order], [body[i] for i in order])
        tidy()
        if ddl:
            return out
        return pa.Table.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "body"])

    return messages.repartition(partitions, "key").groupBy("key").applyInArrow(group, ddl or "block long, body binary")


def told(blocks: DataFrame, answers: DataFrame, run: Callable[..., pa.Table], ddl: str, columns: tuple[str, ...] = (), lower: bool = False) -> DataFrame:
    """What ``run`` makes of each block and the answers to it.

    It gets (block, ids, words, answers); with ``columns``, their values instead of ids and words.
    """

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        bodies = right.column("body").to_pylist()
        tidy()
        if columns:
            return run(row["block"], *(row[c] for c in columns), bodies)
        return run(row["block"], *opened(row["ids"], row["sizes"], row["data"], lower), bodies)

    left = blocks.select("block", *(columns or ("ids", "sizes", "data")))
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(group, ddl)


def bodies_for_blocks(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of longs with a block, as one body for each block; a block's rows are bounded by its text."""

    def pack(table: pa.Table) -> pa.Table:
        body = pack_arrays(*(table.column(n).to_numpy().astype(np.int64) for n in names))
        return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.array([body], pa.binary())], names=["block", "body"])

    return rows.select("block", *names).groupBy("block").applyInArrow(pack, "block long, body binary")


def joined_bodies(bodies: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The arrays of all bodies, one behind the other."""
    got = [unpack_arrays(b, *kinds) for b in bodies]
    return [np.concatenate([g[k] for g in got] + [np.empty(0, kind)]) for k, kind in enumerate(kinds)]


def spread(key: np.ndarray, shards: int) -> np.ndarray:
    return (key % U64(shards)).astype(np.int64)
