"""Benchmark decontamination by spaced seeds.

Texts become tokens: lower-case runs of letters, digits and bytes beyond ASCII.
A seed looks at five of eight consecutive tokens, so that substitutions on the
other three don't matter; there are four masks. Items under eight tokens are one
seed of all their tokens.

The seeds of the test items are a table of hashes. Training texts whose seeds pass
a bitmap of it, which has a fixed size, stay as candidates; their distinct seeds
are hash-joined with the table by a shuffle, which gives pairs of a text and an
item. In each pair, item and text are compared token by token along the diagonals
of all common seeds: the best stretch, where a match counts 1 and a substitution
-2, is an overlap if it has ten tokens, nine of them equal, or is the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from foldmill.llm.common import BASE, U64, Sent, Words, batches, fresh, mix, pieces, scratch, table, text_bytes, tidy, written

#: Token positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 5, 7), (0, 3, 4, 6, 7), (0, 2, 3, 6, 7))
SPAN = 8
#: Tokens of an overlap, and how many of them are equal; an item with fewer has to be there as a whole.
OVERLAP, EQUAL = 10, 9
SUBSTITUTION = 2
#: Tokens of an overlap for which ``decontaminate`` removes a text: shorter items are no evidence.
EVIDENCE = 5
#: Bits of the bitmaps of the items' seeds (two for each seed) and tokens.
SEED_BITS, TOKEN_BITS = 26, 23
#: Hits, and cells of diagonals, that are looked at at a time.
HITS = 1 << 20
JOINER = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int64()) for c in ("doc_token", "item_token", "n_tokens", "n_equal")]])
OUT_DDL = "doc_id long, item_id long, doc_token long, item_token long, n_tokens long, n_equal long"


def tokens(column: pa.Array) -> Words:
    data, off = text_bytes(pc.utf8_lower(column))
    return Words(np.where(JOINER[data], np.uint8(32), data), off)


def left_in(w: Words) -> np.ndarray:
    """Tokens from each position to its text's end."""
    return np.repeat(w.first[1:], w.count) - np.arange(len(w.start))


def seed_keys(h: np.ndarray, left: np.ndarray, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and keys of the seeds, of tokens that are ``known``: of eight tokens for each mask, and of 1 to 7 tokens."""
    for kind, (span, mask) in enumerate([*((SPAN, m) for m in MASKS), *((n, range(n)) for n in range(1, SPAN))]):
        at = np.flatnonzero(left >= span if known is None else known & (left >= span))
        if known is not None:
            for offset in mask[1:]:
                at = at[known[at + offset]]
        key = np.full(len(at), kind + 1, U64)
        for offset in mask:
            key = key * U64(BASE) + h[at + offset]
        yield span, at, mix(key)


def item_seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each seed of the items: those with under eight tokens have one."""
    h, left, count = w.hashes(), left_in(w), w.count[w.row]
    rows, keys = [], []
    for span, at, key in seed_keys(h, left):
        own = count[at] >= SPAN if span == SPAN else count[at] == span
        rows.append(w.row[at[own]])
        keys.append(key[own])
    return np.concatenate(rows), np.concatenate(keys)


def probes(key: np.ndarray, bits: int, times: int) -> list[np.ndarray]:
    return [((key * U64(2 * k + 1) + U64(k)) >> U64(64 - bits)).astype(np.int64) for k in (0, 7)[:times]]


def bitmap(keys: DataFrame, bits: int, times: int) -> np.ndarray:
    """The bits that the longs of a one-column table set, two to the power of ``bits`` in all, whatever the table's size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            at = np.unique(np.concatenate(probes(batch.column(0).to_numpy().view(U64), bits, times)))
            word = at >> 6
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
            value = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), edge) if len(at) else np.empty(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array(value.view(np.int64))], names=["word", "value"])

    got = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(U64)
    return out


def flagged(bits: np.ndarray, key: np.ndarray, times: int) -> np.ndarray:
    """Whether each key may be in the bitmap."""
    size = int(len(bits) * 64).bit_length() - 1
    out = np.ones(len(key), bool)
    for at in probes(key, size, times):
        out &= (bits[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
    return out


class Filter:
    """Which tokens and seeds the test items may have."""

    def __init__(self, items: DataFrame, seeds: DataFrame):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for part in pieces(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(tokens(part.column(0)).hashes()).view(np.int64))], names=["token"])

        self.tokens = bitmap(items.select("text").mapInArrow(run, "token long"), TOKEN_BITS, 1)
        self.seeds = bitmap(seeds.select("key"), SEED_BITS, 2)

    def of(self, column: pa.Array) -> pa.Array:
        """For each text its distinct seeds that pass; null if there are none."""
        w = tokens(column)
        h, n = w.hashes(), len(column)
        row, key = [np.empty(0, np.int64)], [np.empty(0, U64)]
        for _, at, own in seed_keys(h, left_in(w), flagged(self.tokens, h, 1)):
            may = flagged(self.seeds, own, 2)
            row.append(w.row[at[may]])
            key.append(own[may])
        row, key = np.concatenate(row), np.concatenate(key)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)]
        row, key = row[new], key[new]
        edge = np.searchsorted(row, np.arange(n + 1))
        return pa.LargeListArray.from_arrays(edge, pa.array(key.view(np.int64)), mask=pa.array(np.diff(edge) == 0)).cast(pa.list_(pa.int64()))


def diagonals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in text a less those in item b of all their common seeds; hits are looked at some at a time."""
    mark = np.zeros(len(a) + len(b) + 1, bool)
    mine, own = (list(seed_keys(h, np.arange(len(h), 0, -1))) for h in (a, b))
    for (span, at, key), (_, place, other) in zip(mine, own, strict=True):
        if span != min(SPAN, len(b)):
            continue
        order = np.argsort(other, kind="stable")
        place, other = place[order], other[order]
        lo, hi = np.searchsorted(other, key, "left"), np.searchsorted(other, key, "right")
        hit = np.flatnonzero(hi > lo)
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        total = np.concatenate([[0], np.cumsum(n)])
        x = 0
        while x < len(n):
            y = max(x + 1, int(np.searchsorted(total, total[x] + HITS, "right")) - 1)
            k = np.arange(total[y] - total[x]) - np.repeat(total[x:y] - total[x], n[x:y]) + np.repeat(lo[x:y], n[x:y])
            mark[np.repeat(at[x:y], n[x:y]) - place[k] + len(b)] = True
            x = y
    return np.flatnonzero(mark) - len(b)


def longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int] | None:
    """(tokens, equal tokens, place in text a, place in item b) of the longest overlap of their token hashes."""
    found = None
    shifts = diagonals(a, b)
    step = max(1, HITS // max(1, len(b)))
    for k in range(0, len(shifts), step):
        shift = shifts[k : k + step]
        at = shift[:, None] + np.arange(len(b))
        equal = (at >= 0) & (at < len(a)) & (a[np.clip(at, 0, len(a) - 1)] == b)
        total = np.zeros((len(shift), len(b) + 1), np.int64)
        np.cumsum(np.where(equal, 1, -SUBSTITUTION), axis=1, out=total[:, 1:])
        end = (total - np.minimum.accumulate(total, axis=1)).argmax(1)
        begin = np.where(np.arange(len(b) + 1) <= end[:, None], total, len(b) + 1).argmin(1)
        rows, n = np.arange(len(shift)), end - begin
        same = (total[rows, end] - total[rows, begin] + SUBSTITUTION * n) // (1 + SUBSTITUTION)
        good = np.flatnonzero((n >= min(OVERLAP, len(b))) & (same >= min(EQUAL, len(b))))
        if len(good):
            best = good[np.lexsort((-shift[good], same[good], n[good]))[-1]]
            found = max(found or (0,), (int(n[best]), int(same[best]), int(begin[best] + shift[best]), int(begin[best])))
    return found


def verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of each pair (row, doc_id, text, item_id, item_text) that has one."""
    for batch in parts:
        row = batch.column(0).to_numpy()
        first, at = np.unique(row, return_index=True, return_inverse=True)[1:]
        x, y = tokens(batch.column(2).take(pa.array(first))), tokens(batch.column(4))
        h, g = x.hashes(), y.hashes()
        got = [longest(h[x.first[i] : x.first[i + 1]], g[y.first[k] : y.first[k + 1]]) for k, i in enumerate(at.tolist())]
        keep = [k for k, found in enumerate(got) if found]
        if keep:
            n, same, a, b = (np.array(v) for v in zip(*(got[k] for k in keep), strict=True))
            which = pa.array(keep, pa.int64())
            out = table({"doc_id": batch.column(1).take(which), "item_id": batch.column(3).take(which), "doc_token": a, "item_token": b, "n_tokens": n, "n_equal": same}, OUT)
            yield out.append_column("row", batch.column(0).take(which))
        tidy()


class Search:
    """Overlaps of texts with the items of a benchmark; inside a ``scratch``."""

    def __init__(self, benchmark: DataFrame):
        spark = benchmark.sparkSession
        batches(spark)
        self.items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("item", F.monotonically_increasing_id()))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for part in pieces(batch):
                    row, key = item_seeds(tokens(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key.view(np.int64))], names=["item", "key"])

        self.seeds = written(self.items.select("item", "text").mapInArrow(run, "item long, key long").distinct())
        self.filter = Sent(spark, Filter(self.items, self.seeds))

    def marked(self, docs: DataFrame, seeds: str) -> DataFrame:
        """docs with the distinct seeds of each text that pass the filter, in a column of that name; null if there are none."""
        at, held = docs.columns.index("text"), self.filter

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for part in pieces(batch, batch.schema.names[at]):
                    yield part.append_column(seeds, held.value.of(part.column(at)))

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(seeds, ArrayType(LongType()))]))

    def overlaps(self, marked: DataFrame) -> DataFrame:
        """(row and the columns of OUT) for each pair of a text (row, doc_id, text, seeds) and an item that overlap."""
        asked = marked.select("row", F.explode("seeds").alias("key"))
        pairs = written(asked.join(self.seeds.hint("shuffle_hash"), "key").select("row", "item").distinct())
        both = pairs.join(marked.select("row", "doc_id", "text"), "row").join(self.items.select("item", "item_id", F.col("text").alias("item_text")), "item")
        return both.select("row", "doc_id", "text", "item_id", "item_text").mapInArrow(verified, OUT_DDL + ", row long")


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_token, item_token, n_tokens, n_equal): the longest overlap of each text and test item.

    Null and empty texts and items overlap with nothing; items under ten tokens are
    found as a whole, without substitutions. A very long or repetitive text is handled
    alone and its hits some at a time. Repeated rows of docs have repeated overlaps; of
    items with the same id each row stands on its own; null ids stay. Other columns
    are not read, whatever their names. Empty tables give an empty result.
    """
    with scratch(docs.sparkSession):
        search = Search(benchmark)
        marked = search.marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "seeds").where("seeds is not null")
        marked = written(marked.withColumn("row", F.monotonically_increasing_id()))
        return written(search.overlaps(marked).drop("row"), keep=True)


def decontaminate(docs: DataFrame, benchmark: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """docs, with all their columns, of whatever names, without the rows that overlap a test item in ``evidence`` tokens or more."""
    seeds, row = fresh(docs.columns, "seeds", "row")
    with scratch(docs.sparkSession):
        search = Search(benchmark)
        marked = written(search.marked(docs, seeds).withColumn(row, F.monotonically_increasing_id()), keep=True)
        asked = marked.where(F.col(seeds).isNotNull())
        found = search.overlaps(asked.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(seeds).alias("seeds")))
        gone = written(found.where(F.col("n_tokens") >= evidence).select(F.col("row").alias(row)).distinct(), keep=True)
    kept = marked.where(F.col(seeds).isNull()).unionByName(asked.join(gone, row, "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
