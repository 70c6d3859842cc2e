"""Quality rules: exact counts of a text, and a logistic regression over hashed word and character n-grams.

Features are the shares of hashed word unigrams and bigrams, character trigrams
and 4-grams (of UTF-8 bytes) in their kind. The regression is fitted on a bounded
sample of labelled rows, its outputs are calibrated on rows that it hasn't seen,
and texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import BASE, SPACE, U64, Words, batches, gram_hashes, mix, pieces, scratch, span_hashes, table, text_bytes
from foldmill.llm.learning import class_weights, labelled, logistic, sigmoid, sparse_logistic

#: Hashed dimensions: two bits for the kind of n-gram and the rest for its hash.
DIM_BITS = 18
#: Labelled rows of either class that the model is fitted on, at most twice as many.
TRAIN_ROWS = 1000
#: A text is kept with a probability of good quality from here on.
KEEP = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])


def row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each (row, hash) is there."""
    _, at, n = np.unique(mix(h + row.astype(U64) * U64(BASE)), return_inverse=True, return_counts=True)
    return n[at]


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the \\n-split lines."""
    cut = np.flatnonzero(w.data == 10)
    start = np.concatenate([w.off[:-1], cut + 1])
    row = np.concatenate([np.arange(len(w.off) - 1), np.searchsorted(w.off, cut, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, len(w.data))
    last = np.append(row[1:] != row[:-1], True)
    end[last] = w.off[1:][row[last]]
    return start, end, row


def base_counts(w: Words) -> dict[str, np.ndarray]:
    n = len(w.off) - 1
    chars = row_sums(~SPACE[w.data] & ((w.data & 0xC0) != 0x80), w.off)
    start, end, row = lines(w)
    seen = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[seen], end[seen], row[seen]
    distinct = np.unique(mix(span_hashes(w.data, start, end) + row.astype(U64) * U64(BASE)), return_index=True)[1]
    covered = np.zeros(len(w.start) + 2, bool)
    at = np.flatnonzero(w.starts_of(3))
    if len(at):
        at = at[repeats(w.row[at], gram_hashes(w.hashes(), 3)[at]) > 1]
        for k in range(3):
            covered[at + k] = True
    return {
        "n_words": w.count,
        "word_chars": chars,
        "n_symbols": row_sums(SYMBOLS[w.data], w.off),
        "n_dup_lines": np.bincount(row, minlength=n) - np.bincount(row[distinct], minlength=n),
        "n_repeat_words": np.bincount(w.row[covered[: len(w.row)]], minlength=n),
    }


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its dimensions and their rows, in order of rows."""
    shift, kind = U64(64 - DIM_BITS + 2), 1 << (DIM_BITS - 2)
    h = w.hashes()
    yield (h >> shift).astype(np.int32), w.row
    two = np.flatnonzero(w.starts_of(2))
    yield ((gram_hashes(h, 2)[two] >> shift) + U64(kind)).astype(np.int32) if len(two) else np.empty(0, np.int32), w.row[two]
    byte_row = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    for k, n in ((2, 3), (3, 4)):
        if len(w.data) < n:
            yield np.empty(0, np.int32), np.empty(0, np.int64)
            continue
        code = np.zeros(len(w.data) - n + 1, U64)
        for j in range(n):
            code = (code << U64(8)) | w.data[j : len(w.data) - n + 1 + j]
        whole = byte_row[: len(code)] == byte_row[n - 1 :]
        dim = (code * U64(BASE) >> shift) + U64(k * kind)
        yield dim[whole].astype(np.int32), byte_row[: len(code)][whole]


@dataclass
class Model:
    """Weights of the hashed n-grams with the intercept, and slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, w: Words) -> np.ndarray:
        n = len(w.off) - 1
        z = np.full(n, self.bias)
        for dim, row in features(w):
            z += np.bincount(row, self.weights[dim], n) / np.maximum(1, np.bincount(row, minlength=n)) * 100
        return sigmoid(self.slope * z + self.shift)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model of a bounded labelled sample (rows and bytes, see learning); None if it lacks one of the classes."""
    batches(docs.sparkSession)

    def vectors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                w = Words(*text_bytes(one.column(1)))
                at, value = [np.empty(0, np.int32)], [np.empty(0)]
                for dim, _ in features(w):
                    d, n = np.unique(dim, return_counts=True)
                    at.append(d)
                    value.append(100 * n / max(1, len(dim)))
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(2), pa.array([np.concatenate(at).astype(np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(value).astype(np.float32).tobytes()], pa.binary())], names=["doc_id", "label", "dims", "shares"])

    with scratch(docs.sparkSession):
        sample, counts = labelled(docs, labels, "quality", train_rows, "min")
        rows = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(vectors, "doc_id long, label int, dims binary, shares binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.dims)))
    y = np.array([float(r.label >= 1) for r in rows])
    if len(set(y)) < 2:
        return None
    x = [(np.frombuffer(r.dims, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows]
    tune = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    learn = ~tune if len(rows) >= 50 and len(set(y[~tune])) == 2 == len(set(y[tune])) else np.ones(len(rows), bool)
    weights, bias = sparse_logistic([x[i] for i in np.flatnonzero(learn)], y[learn], 1 << DIM_BITS)
    z = np.array([(weights[a] * v).sum() + bias for a, v in x])
    slope, shift = logistic(z[tune, None], y[tune], class_weights(y[tune], {float(k >= 1): n for k, n in counts.items()}), ridge=0.1)
    return Model(weights.astype(np.float32), bias, float(slope), float(shift))


def apply_rules(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Counts, base_failed, score and kept for each row of docs.

    A null or empty text has no words and fails; so does one with under 50 words,
    or with over half of its words in repeated 3-word windows. Without a model
    (no labels of one class) the score is null and the base rules decide. A null
    doc_id and repeated rows stay as they are; a very long text is scored whole, alone
    in its batch; other columns are not read, whatever their names. An empty table gives an empty one.
    """
    batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in pieces(batch):
                w = Words(*text_bytes(part.column(1)))
                got = base_counts(w)
                failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
                score = model.scores(w) if model else np.ones(part.num_rows)
                got |= {"doc_id": part.column(0), "base_failed": failed, "kept": ~failed & (score >= keep)}
                got["score"] = pa.array(score) if model else pa.nulls(part.num_rows, pa.float64())
                yield table(got, OUT)

    kinds = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'double' if f.type == pa.float64() else 'long'}" for f in OUT)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)
