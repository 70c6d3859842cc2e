"""Near-duplicates by the similarity of word-shingle sets, exactly: a prefix join, verified on the sets.

Two documents are linked if their sets of word shingles have a Jaccard similarity
of 0.8. Shingles are ordered by rarity (a table of hashed counts of fixed size,
then the hash); sets of that similarity share a shingle within their first
n - ceil(0.8 n) + 1. Equal sets are one from the start. What shares a prefix
shingle is linked in two rounds, so that the pairs of a large group are not all
written out: first each set with the least one of its shingle, then all pairs
that are not connected yet. Sizes, 256 parities of the shingles, and then as many
parities as a set has shingles are compared before the sets are. Texts are never
shuffled: the few that a step needs are picked where they lie, by a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.llm.blocks import squeeze, unsqueeze
from foldmill.llm.common import U64, Sent, gram_hashes, mix, of_rows, pieces, scratch, table, tidy, written
from foldmill.llm.components import components
from foldmill.llm.decontam import bitmap, flagged
from foldmill.llm.lines import TENTHS, prefix

PARITIES = [f"p{k}" for k in range(4)]
ENTRIES = pa.schema([("key", pa.int64()), ("sig", pa.int64())])
LONGS = pa.list_(pa.int64())
MARKS = pa.schema([("row", pa.int64()), ("sig", pa.int64()), ("size", pa.int64()), *[(p, pa.int64()) for p in PARITIES], ("sketch", LONGS)])
SETS = pa.schema([("row", pa.int64()), ("shingles", LONGS)])
#: Bits of a bitmap, two for each long.
PICK_BITS = 26


class Shingles:
    """The distinct shingles of each text, by row: hashes, rows, and per row size and hash of the set."""

    def __init__(self, batch: pa.RecordBatch, shingle: int, column: str = "text"):
        """A text of fewer words is a single shingle; one without words has none, and zero as hash."""
        w = of_rows(batch, column, lower=True)
        h = w.hashes()
        value, row = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for n in range(1, shingle + 1):
            at = np.flatnonzero(w.starts_of(n)) if n == shingle else w.first[:-1][w.count == n]
            if len(at):
                value.append(mix(gram_hashes(h, n)[at] + U64(n)))
                row.append(w.row[at])
        value, row = np.concatenate(value), np.concatenate(row)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])[: len(row)]
        self.value, self.row = value[new], row[new]
        self.size = np.bincount(self.row, minlength=batch.num_rows)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(self.value + U64(1)), dtype=U64)])
        total = total[self.first[1:]] - total[self.first[:-1]]
        self.sig = np.where(self.size > 0, mix(total + self.size.astype(U64)), U64(0)).view(np.int64)

    def buckets(self) -> np.ndarray:
        return (self.value >> U64(44)).astype(np.int64)

    def entries(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle and set of each entry: the rarest of each set."""
        order = np.lexsort((self.value, level[self.buckets()], self.row))
        place = np.arange(len(order)) - self.first[self.row]
        keep = place < prefix(self.size)[self.row]
        return self.value[order][keep].view(np.int64), self.sig[self.row[keep]]

    def parities(self) -> list[np.ndarray]:
        bits = mix(self.value ^ U64(0x5555555555555555))
        flag, part = U64(1) << (bits & U64(63)), (bits >> U64(6)) & U64(3)
        out = []
        for k in range(len(PARITIES)):
            own = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(np.where(part == U64(k), flag, U64(0)))])
            out.append((own[self.first[1:]] ^ own[self.first[:-1]]).view(np.int64))
        return out

    def sketches(self) -> pa.Array:
        """Parities as many as a set has shingles, or up to twice as many: a power of two of longs, of which each half of the bits folds onto the other."""
        words = 1 << np.ceil(np.log2(np.maximum(1, (self.size + 63) // 64))).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(words)])
        bits = mix(self.value ^ U64(0x5555555555555555))
        out = np.zeros(off[-1], U64)
        np.bitwise_xor.at(out, off[self.row] + ((bits >> U64(6)).astype(np.int64) & (words - 1)[self.row]), U64(1) << (bits & U64(63)))
        return pa.LargeListArray.from_arrays(off, out.view(np.int64)).cast(LONGS)


def differing(a: Column, b: Column) -> Column:
    """Differing bits of two sketches, of which one may be twice as long as the other: no more than shingles of one set only."""

    def folded(x: Column, y: Column) -> Column:
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, v: n + v)


class Picked:
    """The longs of a one-column table, and with the size of the bitmap fixed, some more of a very large table."""

    def __init__(self, longs: DataFrame):
        def mixed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(U64)).view(np.int64))], names=["long"])

        self.bits = Sent(longs.sparkSession, bitmap(longs.mapInArrow(mixed, "long long"), PICK_BITS, 2))

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch whose first column may be in the table."""
        return batch.filter(pa.array(flagged(self.bits.value, mix(batch.column(0).to_numpy().view(U64)), 2)))


#: Counts of the table of hashed shingles (its size is fixed), and the parts that it is cut into to be summed.
COUNTS, SLICES = 1 << 20, 16


def summed(tables: DataFrame) -> np.ndarray:
    """The tasks' tables of counts as one. Their slices are summed in groups of about the root of their number, then these sums."""
    many = max(1, int(tables.rdd.getNumPartitions() ** 0.5))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for raw in batch.column(0).to_pylist():
                bodies = [squeeze(x.tobytes()) for x in np.split(np.frombuffer(unsqueeze(raw), np.int64), SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int64()), pa.array(bodies, pa.binary())], names=["slice", "body"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(COUNTS // SLICES, np.int64)
        for body in rows.column("body").to_pylist():
            total += np.frombuffer(unsqueeze(body), np.int64)
        return pa.Table.from_arrays([rows.column("slice").slice(0, 1), pa.array([squeeze(total.tobytes())], pa.binary())], names=["slice", "body"])

    kind = "slice long, body binary"
    rows = tables.mapInArrow(cut, kind).groupBy("slice", F.pmod(F.xxhash64("body"), F.lit(many))).applyInArrow(add, kind)
    rows = rows.groupBy("slice").applyInArrow(add, kind).orderBy("slice").collect()
    return np.concatenate([np.frombuffer(unsqueeze(bytes(r.body)), np.int64) for r in rows]) if rows else np.zeros(COUNTS, np.int64)


def levels(rows: DataFrame, shingle: int) -> np.ndarray:
    """The rarity of each hashed shingle: eighths of the count's logarithm."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(COUNTS, np.int64), False
        for batch in parts:
            for part in pieces(batch):
                some = True
                counts += np.bincount(Shingles(part, shingle).buckets(), minlength=COUNTS)
                tidy()
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([squeeze(counts.tobytes())], pa.binary())], names=["sketch"])

    return np.minimum(255, np.log2(summed(rows.select("text").mapInArrow(count, "sketch binary")) + 1.0) * 8).astype(np.uint8)


def set_classes(rows: DataFrame, shingle: int, known: DataFrame) -> DataFrame:
    """(sig, root) for each set of rows (row, sig, text) that is linked to another one, by its similarity or by ``known`` links (a, b)."""
    with scratch(rows.sparkSession):
        return written(set_links(rows, shingle, known), keep=True)


def set_links(rows: DataFrame, shingle: int, known: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    level = Sent(spark, levels(rows, shingle))

    def enter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in pieces(batch):
                key, sig = Shingles(part, shingle).entries(level.value)
                yield table({"key": key, "sig": sig}, ENTRIES)
                tidy()

    def mark(part: pa.RecordBatch) -> pa.RecordBatch:
        x = Shingles(part, shingle)
        return table({"row": part.column(0), "sig": x.sig, "size": x.size, **dict(zip(PARITIES, x.parities(), strict=True)), "sketch": x.sketches()}, MARKS)

    def hold(part: pa.RecordBatch) -> pa.RecordBatch:
        x = Shingles(part, shingle)
        return table({"row": part.column(0), "shingles": pa.LargeListArray.from_arrays(x.first, x.value.view(np.int64)).cast(LONGS)}, SETS)

    first = rows.groupBy("sig").agg(F.min("row").alias("row"))
    first = written(first)

    def one_each(sigs: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], kind: str) -> DataFrame:
        """What is made of one text of each of the sets, by row, without a shuffle; where the bitmap is full, of some other rows too."""
        picked = Picked(first.join(sigs, "sig", "left_semi").select("row"))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                for part in pieces(picked.of(batch)):
                    yield make(part)
                tidy()

        return rows.select("row", "text").mapInArrow(run, kind)

    with scratch(spark):
        entries = written(rows.select("text").mapInArrow(enter, "key long, sig long"))
        ends = entries.groupBy("key").agg(F.min("sig").alias("least"), F.max("sig").alias("greatest")).where("least <> greatest")
        ends = written(ends.select("key", "least"))
        picked = Picked(ends.select("key"))

        def may_share(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                yield picked.of(batch)

        shared = written(entries.mapInArrow(may_share, "key long, sig long").join(ends, "key").distinct(), keep=True)
    marks = one_each(shared.select("sig").distinct(), mark, "row long, sig long, size long, " + ", ".join(f"{p} long" for p in PARITIES) + ", sketch array<long>")
    marks = written(marks.join(first.select("row"), "row", "left_semi").drop("row"))

    def marked(suffix: str) -> DataFrame:
        return marks.select(*[F.col(c).alias(c + suffix) for c in ("sig", "size", *PARITIES)])

    least = F.ceil(TENTHS * (F.col("size_a") + F.col("size_b")) / F.lit(10 + TENTHS))
    differ = sum((F.bit_count(F.col(p + "_a").bitwiseXOR(F.col(p + "_b"))) for p in PARITIES[1:]), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    most = F.col("size_a") + F.col("size_b") - 2 * least
    may = (10 * F.least("size_a", "size_b") >= TENTHS * F.greatest("size_a", "size_b")) & (differ <= most)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (sig_a, sig_b), of sizes of the similarity, that have it."""
        for s in ("_a", "_b"):
            own = marks.select(*[F.col(c).alias(c + s) for c in ("sig", "size", "sketch")])
            pairs = pairs.join(own.join(first.select(F.col("sig").alias("sig" + s), F.col("row").alias("row" + s)), "sig" + s), "sig" + s)
        pairs = written(pairs.where(differing(F.col("sketch_a"), F.col("sketch_b")) <= most).select("sig_a", "row_a", "sig_b", "row_b"))
        sigs = pairs.select(F.col("sig_a").alias("sig")).unionByName(pairs.select(F.col("sig_b").alias("sig"))).distinct()
        sets = written(one_each(sigs, hold, "row long, shingles array<long>"))
        both = pairs.join(sets.select(F.col("row").alias("row_a"), F.col("shingles").alias("a")), "row_a").join(sets.select(F.col("row").alias("row_b"), F.col("shingles").alias("b")), "row_b")
        common = F.size(F.array_intersect("a", "b"))
        return written(both.where(10 * common >= TENTHS * (F.size("a") + F.size("b") - common)).select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")))

    stars = shared.where("sig <> least").select(F.col("least").alias("sig_a"), F.col("sig").alias("sig_b")).distinct()
    stars = written(stars.join(marked("_a"), "sig_a").join(marked("_b"), "sig_b").where(may).select("sig_a", "sig_b"))
    links = verified(stars).unionByName(known)
    roots = components(links)
    open_ = shared.select("key", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    open_ = written(open_)
    keys = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = written(open_.join(keys, "key").join(marks.drop("sketch"), "sig"))
    a, b = (open_.select("key", *[F.col(c).alias(c + s) for c in open_.columns if c != "key"]) for s in ("_a", "_b"))
    rest = written(a.join(b, "key").where((F.col("sig_a") < F.col("sig_b")) & (F.col("root_a") != F.col("root_b")) & may).select("sig_a", "sig_b").distinct())
    return components(links.unionByName(verified(rest))).select(F.col("node").alias("sig"), "root")
