"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary and one of toxic text.

Both are trained by zstandard: the ordinary one on windows of ordinary rows, the
toxic one on what tells toxic rows. The trainer fills a dictionary with what is
frequent, which in whole toxic rows is ordinary language again; so it gets the
beginnings of words that are frequent in toxic rows against ordinary ones, chosen
by a greedy cover of the toxic rows, each equally often. A window is compressed
with the ordinary dictionary, and with the toxic one in front of it, so that both
hold the same ordinary language; the bytes saved are its distance. Thresholds for
windows are quantiles of ordinary windows' savings. A text's score is a logistic
function of what its windows save, fitted on rows that the dictionaries behind
their savings haven't seen.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import Words, batches, pieces, scratch, table, text_bytes
from foldmill.llm.learning import class_weights, labelled, logistic, sigmoid

#: Bytes from which a window ends with the word that reaches them.
WINDOW = 64
#: Labelled rows of either class that the model is fitted on, at most twice as many.
TRAIN_ROWS = 1000
#: Most bytes of the ordinary and of the toxic dictionary; bytes that the trainer gets of ordinary windows (of more, every so manieth window).
ORDINARY_BYTES, TOXIC_BYTES, SAMPLE_BYTES = 16384, 8192, 4_000_000
#: Length of the segments and of their parts that the trainer counts, for either dictionary; samples of each word beginning.
ORDINARY_PARTS, TOXIC_PARTS, SAMPLES = (64, 6), (20, 6), 8
#: Bytes of a word's beginning; standard deviations above ordinary rows; what a toxic row counts after each cover; the least share of rows that a new one covers.
STEM = range(4, 14)
CONTRAST, DECAY, LEAST = 3.5, 0.7, 0.01
LEVEL = 12
FOLDS = 3
THRESHOLD = 0.7
#: Quantiles of ordinary windows' savings that are the windows' thresholds, and the least bytes of each.
QUANTILES, LEAST_SAVED = (0.95, 0.99, 0.999), (2, 3, 5)
MARKS = b".,;:!?\"'()"
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("windows", pa.int64()), ("toxic_windows", pa.int64())])


def windows(w: Words) -> tuple[list[bytes], np.ndarray]:
    """The texts cut before words into windows of about WINDOW bytes, in lower-case ASCII letters, and their rows."""
    if not len(w.start):
        return [], np.empty(0, np.int64)
    block = (w.start - w.off[w.row]) // WINDOW
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (w.row[1:] != w.row[:-1])]))
    last = np.append(first[1:], len(w.start)) - 1
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)], w.row[first]


@dataclass
class Dictionaries:
    ordinary: bytes
    both: bytes

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in (self.ordinary, self.both):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append(zstandard.ZstdCompressor(LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


def trained(samples: list[bytes], size: int, parts: tuple[int, int]) -> bytes:
    """A zstandard dictionary; the samples themselves where they are too few to train one."""
    try:
        made = zstandard.train_dictionary(size, samples, k=parts[0], d=parts[1], level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        made = b"\n".join(samples)[-size:]
    return made or b"\n"


def savings(w: Words, made: list[zstandard.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
    cut, row = windows(w)
    a, b = (x.compress for x in made)
    return np.fromiter((len(a(x)) - len(b(x)) for x in cut), np.int64, len(cut)), row


def stems(found: list[bytes]) -> set[bytes]:
    """Beginnings of the words of some windows."""
    return {y[:n] for y in {y.strip(MARKS) for x in found for y in x.split()} for n in STEM if n <= len(y)}


def telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Word beginnings that cover the toxic rows, the best ones first.

    A beginning gains the toxic rows that have it, each counting less the more often
    it is covered already, less those expected from ordinary rows.
    """
    held = [stems(x) for x in toxic]
    plain = Counter(y for x in ordinary for y in stems(x))
    expected = {}
    for y, n in Counter(y for x in held for y in x).items():
        e = (plain[y] + 0.5) / max(1, len(ordinary)) * len(toxic)
        if n >= 2 and (n - e) / np.sqrt(e + 0.25) > CONTRAST:
            expected[y] = e
    rows: dict[bytes, list[int]] = {}
    for k, x in enumerate(held):
        for y in x & expected.keys():
            rows.setdefault(y, []).append(k)
    at = {y: np.array(r) for y, r in rows.items()}
    worth, out = np.ones(len(toxic)), []
    heap = [(-float("inf"), -len(y), y) for y in at]
    heapq.heapify(heap)
    while heap:
        _, _, y = heapq.heappop(heap)
        gain = worth[at[y]].sum() - 1.5 * expected[y] * worth.mean()
        if heap and gain < -heap[0][0]:
            heapq.heappush(heap, (-gain, -len(y), y))
        elif gain < max(1.5, LEAST * len(toxic)):
            break
        else:
            out.append(y)
            worth[at[y]] *= DECAY
    return out


def toxic_samples(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Samples for the trainer, which leaves out those under eight bytes: each telling beginning twice in a row, or until it is long enough."""
    return SAMPLES * [(b" " + y) * max(2, -(-11 // (len(y) + 1))) + b" " for y in telling(toxic, ordinary)]


def dictionaries(rows: list[tuple[int, list[bytes]]]) -> Dictionaries:
    """Of (label, windows) rows."""
    ordinary, toxic = [x for label, x in rows if not label], [x for label, x in rows if label]
    windows_ = [x for row in ordinary for x in row]
    first = trained(windows_[:: max(1, -(-sum(map(len, windows_)) // SAMPLE_BYTES))], ORDINARY_BYTES, ORDINARY_PARTS)
    return Dictionaries(first, trained(toxic_samples(toxic, ordinary), TOXIC_BYTES, TOXIC_PARTS) + first)


def summaries(saved: np.ndarray, row: np.ndarray, n: int, levels: tuple[float, ...]) -> np.ndarray:
    """Per text: most saved by a window, the mean of the four that save most, the mean, shares and counts above the thresholds."""
    order = np.lexsort((-saved, row))
    saved, row = saved[order].astype(float), row[order]
    count = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    most = np.zeros(n)
    most[row[place == 0]] = saved[place == 0]
    per = np.maximum(1, count)
    above = [np.bincount(row[saved >= x], minlength=n) for x in levels]
    four = np.bincount(row[place < 4], saved[place < 4], n) / np.minimum(4, per)
    return np.column_stack([most, four, np.bincount(row, saved, n) / per, above[0] / per, above[1] / per, np.log1p(above[1]), np.log1p(above[2]), above[1], count])


@dataclass
class Model:
    dictionaries: Dictionaries
    levels: tuple[float, ...]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, w: Words, made: list) -> tuple[np.ndarray, np.ndarray]:
        found = summaries(*savings(w, made), len(w.off) - 1, self.levels)
        x = (found[:, :-2] - self.mean) / self.scale
        return sigmoid(x @ self.weights[:-1] + self.weights[-1]), found


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model of a bounded labelled sample (rows and bytes, see learning); None if it lacks one of the classes.

    A hash of the id deals the rows into folds; each fold's savings come from
    dictionaries of the other folds, those of the model from all rows.
    """
    batches(docs.sparkSession)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                found, _ = windows(Words(*text_bytes(one.column(1)), lower=True))
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(2), one.column(3), pa.array([b"\n".join(x.replace(b"\n", b" ") for x in found)], pa.binary())], names=["doc_id", "label", "fold", "found"])

    with scratch(docs.sparkSession):
        sample, counts = labelled(docs, labels, "toxic", train_rows, "max")
        sample = sample.select(F.col("doc_id").cast("long"), "text", (F.col("label") >= 1).cast("int").alias("label"), fold.cast("int").alias("fold"))
        got = sorted(sample.mapInArrow(cut, "doc_id long, label int, fold int, found binary").collect(), key=lambda r: (r.doc_id, r.found))
    if len({r.label for r in got}) < 2:
        return None
    rows = [(r.fold, r.label, [x for x in bytes(r.found).split(b"\n") if x]) for r in got]
    final = dictionaries([r[1:] for r in rows])
    y = np.array([float(r[1]) for r in rows])
    saved: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
    for k in range(FOLDS):
        others = [r[1:] for r in rows if r[0] != k]
        a, b = (x.compress for x in (dictionaries(others) if len({r[0] for r in others}) == 2 else final).compressors())
        for i, r in enumerate(rows):
            if r[0] == k:
                saved[i] = np.array([len(a(x)) - len(b(x)) for x in r[2]], np.int64)
    plain = np.concatenate([s for s, label in zip(saved, y, strict=True) if not label] + [np.zeros(1, np.int64)])
    levels = tuple(max(float(least), float(np.quantile(plain, q))) for q, least in zip(QUANTILES, LEAST_SAVED, strict=True))
    x = summaries(np.concatenate(saved), np.repeat(np.arange(len(saved)), [len(s) for s in saved]), len(saved), levels)[:, :-2]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Model(final, levels, logistic((x - mean) / scale, y, class_weights(y, {float(k >= 1): n for k, n in counts.items()})), mean, scale)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, windows, toxic_windows) for each row of docs; the higher the score, the likelier is toxic text.

    A null or empty text has no windows and the score of such a text; without a
    model (no labels of one class) every score is 0. Null ids and repeated rows
    stay; a very long text is scored whole, alone in its batch; other columns are
    not read, whatever their names. An empty table gives an empty one.
    """
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.dictionaries.compressors() if model else []
        for batch in parts:
            for part in pieces(batch):
                w = Words(*text_bytes(part.column(1)), lower=True)
                if model:
                    p, found = model.scores(w, made)
                else:
                    p, found = np.zeros(part.num_rows), np.zeros((part.num_rows, 9))
                yield table({"doc_id": part.column(0), "score": p, "windows": found[:, 8].astype(np.int64), "toxic_windows": found[:, 7].astype(np.int64)}, SCORES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, windows long, toxic_windows long")


def remove_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, without the rows whose score reaches the threshold; all of them where there is no model."""
    if model is None:
        return docs
    batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.dictionaries.compressors()
        for batch in parts:
            for part in pieces(batch):
                p, _ = model.scores(Words(*text_bytes(part.column(at)), lower=True), made)
                yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
