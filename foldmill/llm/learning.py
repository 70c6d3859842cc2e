"""Bounded labelled samples, and logistic models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import written

#: Bytes of text of a labelled sample.
TRAIN_BYTES = 16 << 20


def crc_fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column) % folds


def sampled(rows: DataFrame, by: str, limit: int) -> tuple[DataFrame, dict]:
    """About limit rows for each value of column ``by``, picked by a hash of doc_id, and how many rows each value has.

    rows has doc_id and a few distinct values of ``by`` (classes or languages); rows with nulls in them are left out.
    The result never has more than 2 * limit rows for each value, whatever the input.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, limit / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(drawn < share).limit(2 * limit * max(1, len(counts))), counts


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, worst: str, most_bytes: int = TRAIN_BYTES) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of a bounded sample with as many rows of either class, one row for each id; inside a ``scratch``.

    Of several labels for one document the ``worst`` (min or max) counts, of several texts
    the least. The sample of ids is broadcast: it has 4 * limit rows at most. Rows are taken
    in order of a hash of their id until their texts have ``most_bytes`` (the first one always). Documents with a null text are left out.
    """
    one = labels.groupBy("doc_id").agg(getattr(F, worst)(label).cast("int").alias("label"))
    ids, counts = sampled(one, "label", limit)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).withColumn("turn", F.xxhash64("doc_id", F.lit("turn"))))
    sizes = sorted((r[0], r[1]) for r in rows.select("turn", F.octet_length("text")).collect())
    total = np.cumsum([n for _, n in sizes])
    last = sizes[max(0, int(np.searchsorted(total, most_bytes, "right")) - 1)][0] if sizes else 0
    return rows.where(F.col("turn") <= last).drop("turn"), counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method on dense features."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def class_weights(y: np.ndarray, counts: dict) -> np.ndarray:
    """Weights that give a balanced sample the classes' shares of all labelled rows."""
    total, out = sum(counts.values()), np.ones(len(y))
    for value, n in counts.items():
        mine = y == value
        if mine.any():
            out[mine] = n / total * len(y) / mine.sum()
    return out


def sparse_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, ridge: float = 1e-5, rounds: int = 60, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam over all rows at once; a row is (indices, values)."""
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (sigmoid(np.bincount(row, value * w[at], len(rows)) + bias) - y) / len(rows)
        g, gb = np.bincount(at, value * error[row], len(used)) + ridge * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    out = np.zeros(dims)
    out[used] = w
    return out, float(bias)
