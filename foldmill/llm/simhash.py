"""SimHash near-duplicates: fingerprints embedded as segment bit counts, joined on a grid, verified exactly.

The 64 bits fall into 32 segments of two bits; a fingerprint's embedding is the
number of set bits of each segment. One differing bit moves one count by one at
most, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. The 32 coordinates fall into 7 groups: points
within Manhattan distance 4 agree fully on 3 groups at least. Each distinct
fingerprint is entered in the grid's 35 projections onto three groups (a cell is
a point of such a projection); within a cell, points are joined on the Manhattan
distance over all coordinates and then verified on the Hamming distance.

Four bits are reached by near-equal texts only. Where all documents whose shingle
sets are alike in eight of ten shingles have to be found, ``one_of_each`` takes
these links too (see near_sets): the sets that fingerprints have linked are one
before the sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foldmill.llm import near_sets
from foldmill.llm.common import U64, batches, fresh, mix, of_rows, pieces, scratch, shuffle_partitions, table, tidy, written
from foldmill.llm.components import components, local_roots

#: Two-bit segments of each of the seven groups of coordinates.
GROUPS = (5, 5, 5, 5, 4, 4, 4)
EVEN = U64(0x5555555555555555)
#: Cells up to this size are compared by shifted arrays, larger ones by a search that leaves out what is linked already.
SMALL_CELL = 48
#: Cells with more points are dealt anew by blocks of their raw bits.
HOT_CELL = 20_000
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
CELLS = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(batch: pa.RecordBatch, shingle: int = 4, column: str = "text") -> np.ndarray:
    """The SimHash of each text: XXH64 (seed 42) of its word shingles; a bit is 1 if set in over half of them."""
    w = of_rows(batch, column, lower=True)
    n = batch.num_rows
    text, start, end = w.joined()
    size = np.minimum(shingle, w.count)
    at = np.flatnonzero(w.starts_of(shingle))
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    left = np.concatenate([at, w.first[:-1][short]])
    right = left + np.concatenate([np.full(len(at), shingle), size[short]]).astype(np.int64) - 1
    row = np.concatenate([w.row[at], short])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(start[left].tolist(), end[right].tolist(), strict=True)), U64, len(left))
    return majority(h, row, n)


def majority(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row the bits that are set in over half of its hashes."""
    out = np.zeros(n, U64)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        mine = (row >= lo) & (row < hi)
        base, part = (row[mine] - lo) * 2048, h[mine]
        sums = np.zeros((hi - lo) * 2048)
        for k in range(8):
            byte = ((part >> U64(8 * k)) & U64(255)).astype(np.int64)
            sums += np.bincount(base + k * 256 + byte, minlength=len(sums))
        ones = (sums.reshape(-1, 256) @ BITS).reshape(hi - lo, 64)
        total = np.bincount(row[mine] - lo, minlength=hi - lo)
        out[lo:hi] = ((2 * ones > total[:, None]).astype(U64) << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
    return out


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long; zero where there is no word."""
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in pieces(batch):
                yield table({"doc_id": part.column(0), "fp": fingerprints(part, shingle).view(np.int64)}, PRINTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each written in unary: Manhattan distances are then counts of differing bits."""
    low, high = fp & EVEN, (fp >> U64(1)) & EVEN
    return (low | high) | ((low & high) << U64(1))


def projections() -> list[np.ndarray]:
    at, masks = 0, []
    for size in GROUPS:
        masks.append(((1 << (2 * size)) - 1) << (2 * at))
        at += size
    return [U64(a | b | c) for a, b, c in combinations(masks, 3)]


def cells_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = embedding(fp)
    masks = projections()
    cell = np.stack([mix((e & m) + mix(np.full(len(e), k + 1, U64))) for k, m in enumerate(masks)], 1)
    return cell.ravel(), np.repeat(fp, len(masks))


def subcells_of(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell's points by the 70 choices of four of the eight bytes: fingerprints within 4 bits agree on four bytes."""
    masks = [U64(sum(255 << (8 * k) for k in c)) for c in combinations(range(8), 4)]
    out = np.stack([mix((fp & m) + mix(cell + U64(k + 1))) for k, m in enumerate(masks)], 1)
    return out.ravel(), np.repeat(fp, len(masks))


def cell_edges(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, cell by cell, all points linked within it: pairs of small cells, spanning trees of large ones."""
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    e = embedding(fp)
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(edge, len(cell)))
    left, right = [], []
    number = np.repeat(np.arange(len(edge)), size)
    keep = np.flatnonzero((size[number] > 1) & (size[number] <= SMALL_CELL))
    for k in range(1, SMALL_CELL):
        i = keep[keep + k < len(cell)]
        i = i[number[i] == number[i + k]]
        if not len(i):
            break
        keep = i
        i = i[np.bitwise_count(e[i] ^ e[i + k]) <= most]
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= most]
        left.append(fp[i])
        right.append(fp[i + k])
    for c in np.flatnonzero(size > SMALL_CELL):
        lo, hi = edge[c], edge[c] + size[c]
        rest_f, rest_e = fp[lo:hi], e[lo:hi]
        while len(rest_f):
            front_f, front_e, rest_f, rest_e = rest_f[:1], rest_e[:1], rest_f[1:], rest_e[1:]
            while len(front_f) and len(rest_f):
                f, g, front_f, front_e = front_f[0], front_e[0], front_f[1:], front_e[1:]
                near = np.bitwise_count(rest_e ^ g) <= most
                near[near] = np.bitwise_count(rest_f[near] ^ f) <= most
                if near.any():
                    left.append(np.full(int(near.sum()), f))
                    right.append(rest_f[near])
                    front_f, front_e = np.concatenate([front_f, rest_f[near]]), np.concatenate([front_e, rest_e[near]])
                    rest_f, rest_e = rest_f[~near], rest_e[~near]
    none = np.empty(0, U64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def fingerprint_classes(prints: DataFrame, most: int = 4) -> DataFrame:
    """(fp, root) for each fingerprint of prints linked to another; links are Hamming distances up to most (4 at most)."""
    if not 0 <= most <= 4:
        raise ValueError("the grid's projections hold for distances up to 4")
    spark = prints.sparkSession

    def enter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            cell, fp = cells_of(batch.column(0).to_numpy(zero_copy_only=False).view(U64))
            yield table({"cell": cell.view(np.int64), "fp": fp.view(np.int64)}, CELLS)

    def refine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            cell, fp = subcells_of(*(batch.column(k).to_numpy(zero_copy_only=False).view(U64) for k in (0, 1)))
            yield table({"cell": cell.view(np.int64), "fp": fp.view(np.int64)}, CELLS)

    def link(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy(zero_copy_only=False).view(U64) for k in (0, 1)] for b in parts]
        if got:
            a, b = cell_edges(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), most)
            if len(a):
                node, root = local_roots(a.view(np.int64), b.view(np.int64))
                yield table({"a": node[node != root], "b": root[node != root]}, EDGES)

    with scratch(spark):
        points = written(prints.select("fp").distinct().mapInArrow(enter, "cell long, fp long"))
        sizes = points.groupBy("cell").count().where(F.col("count") > HOT_CELL)
        hot = written(sizes.select("cell"))
        if not hot.isEmpty():
            kept = points.join(hot, "cell", "left_anti")
            points = kept.unionByName(points.join(hot, "cell", "left_semi").select("cell", "fp").mapInArrow(refine, "cell long, fp long"))
        parts = max(shuffle_partitions(spark), points.rdd.getNumPartitions())
        edges = points.repartition(parts, "cell").mapInArrow(link, "a long, b long")
        return written(components(edges).select(F.col("node").alias("fp"), "root"), keep=True)


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints differ in up to ``most`` bits are linked.

    component_id is the least doc_id that is reached, the document's own included.
    Null and empty texts have fingerprint zero and link like any other. A null
    doc_id stays in the result and counts as no component's least id unless all
    of them are null. Repeated rows stay repeated. A very long
    text is hashed whole, alone in its batch; other columns are not read. An empty table gives an empty one.
    """
    with scratch(docs.sparkSession):
        prints = written(with_fingerprints(docs, shingle), keep=True)
        least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        linked = written(least.join(fingerprint_classes(prints, most), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        found = written(linked.join(ids, "root").select("fp", "component_id"), keep=True)
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, most: int = 4, similar: bool = False) -> DataFrame:
    """docs, with all their columns, with one row of each component: the least doc_id, null last; of equal ids any one.

    Links are fingerprints that differ in up to ``most`` bits; with ``similar``,
    fingerprints of the sets of shingles are compared, and sets with a Jaccard
    similarity of 0.8 are links as well. A component of a single row keeps it,
    whatever its id; repeated rows, and texts without words, are one component. A
    very long text is hashed whole, alone in its batch. Columns of any names are
    passed through; an empty table gives an empty one.
    """
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")
    batches(spark)
    sig, fp, row = fresh(docs.columns, "sig", "fp", "row")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in pieces(batch, batch.schema.names[at]):
                if similar:
                    x = near_sets.Shingles(part, shingle, part.schema.names[at])
                    own, prints = x.sig, majority(x.value, x.row, part.num_rows)
                else:
                    own = prints = fingerprints(part, shingle, part.schema.names[at])
                yield part.append_column(sig, pa.array(own.view(np.int64))).append_column(fp, pa.array(prints.view(np.int64)))
                tidy()

    with scratch(spark):
        rows = docs.mapInArrow(run, StructType([*schema.fields, StructField(sig, LongType()), StructField(fp, LongType())]))
        rows = written(rows.withColumn(row, F.monotonically_increasing_id()), keep=True)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("least")
        least = written(rows.groupBy(F.col(sig).alias("sig")).agg(first, F.min(fp).alias("fp")))
        classes = fingerprint_classes(least, most)
        if similar:
            print_root = least.join(classes, "fp", "left").select("sig", F.coalesce("root", "fp").alias("root"))
            ends = print_root.groupBy("root").agg(F.min("sig").alias("b"))
            known = written(print_root.join(ends, "root").where("sig <> b").select(F.col("sig").alias("a"), "b"))
            texts = rows.select(F.col(row).alias("row"), F.col(sig).alias("sig"), F.col(schema.names[at]).alias("text"))
            classes = near_sets.set_classes(texts, shingle, known)
        else:
            classes = classes.withColumnRenamed("fp", "sig")
        linked = written(least.join(classes, "sig", "left").withColumn("root", F.coalesce("root", "sig")))
        stays = linked.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.row").alias("first"))
        stays = linked.join(stays, "root").select(F.col("sig").alias(sig), "first")
        gone = rows.select(row, sig).join(stays, sig).where(F.col(row) != F.col("first")).select(row)
        gone = written(gone, keep=True)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in schema.names])
