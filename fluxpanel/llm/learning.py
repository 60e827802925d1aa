"""Small models fitted on the driver, and the labelled rows they are fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from .runtime import discard, materialise, small_side


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, bound: int) -> DataFrame:
    """(text, label) of at most `bound` labelled documents for which `allowed`
    holds: those whose doc_id has the smallest hash, so any bound is a fair and
    repeatable sample.  The bound is a parameter of the model, not of the data
    that it scores.  Several labels of a document count as the largest; labels whose
    id cannot be one of `docs` count for nothing.  Ids may be of any type."""
    key = docs.schema["doc_id"].dataType
    if isinstance(key, IntegralType):
        key = LongType()
    known = labels.filter(F.col(column).isNotNull() & allowed).select(F.col("doc_id").try_cast(key).alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    out = materialise(docs.select(F.col("doc_id").cast(key).alias("doc_id"), "text").join(small_side(known, bound), "doc_id").select("doc_id", "text", "label"))
    discard(known)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Newton's method for logistic regression; the last weight is the intercept.

    The loss is averaged, so `ridge` means the same at every number of rows.
    Without rows all weights are 0."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) / len(x) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class SparseRows:
    """Rows of few features: row r has value[first[r]:first[r+1]] at index[...]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> SparseRows:
        first = np.cumsum([0] + [len(i) for i, _ in rows])
        index, value = np.empty(first[-1], np.uint16), np.empty(first[-1], np.float32)
        for (i, v), at in zip(rows, first[:-1], strict=True):
            index[at : at + len(i)], value[at : at + len(i)] = i, v
        return cls(index, value, first)

    def blocks(self, size: int = 256):
        """(rows, first, index, value) of a few rows at a time."""
        for lo in range(0, len(self.first) - 1, size):
            own = slice(lo, min(lo + size, len(self.first) - 1))
            a, b = self.first[own.start], self.first[own.stop]
            yield own, self.first[own.start : own.stop + 1] - a, self.index[a:b], self.value[a:b]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.first) - 1, w.shape[1]))
        for own, first, index, value in self.blocks():
            for c in range(w.shape[1]):
                total = np.concatenate(([0.0], np.cumsum(value * w[index, c], dtype=np.float64)))
                out[own, c] = total[first[1:]] - total[first[:-1]]
        return out

    def gather(self, p: np.ndarray, size: int) -> np.ndarray:
        """The product of the transposed rows with p."""
        out = np.zeros((size, p.shape[1]))
        for own, first, index, value in self.blocks():
            for c in range(p.shape[1]):
                out[:, c] += np.bincount(index, value * np.repeat(p[own, c], np.diff(first)), minlength=size)
        return out


def sparse_softmax(x: SparseRows, y: np.ndarray, size: int, classes: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and intercepts of a multinomial logistic
    regression.  Adam on the full gradient; deterministic, and memory beyond
    the rows themselves is that of a block."""
    rows = len(y)
    target = np.eye(classes)[y]
    share = np.maximum(target.mean(0), 1e-3) if rows else np.full(classes, 1 / classes)
    w, b = np.zeros((size, classes)), np.log(share / share.sum())
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)]
    for t in range(1, rounds + 1 if rows else 1):
        z = x.dot(w) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target) / rows
        for v, g, s, rate in ((w, x.gather(p, size) + ridge * w, state[0], 0.5), (b, p.sum(0), state[1], 0.05)):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            v -= rate * (1 - t / (rounds + 1)) * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)
    return w, b


def isotonic(scores: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing chances closest to
    positives/totals at ascending `scores`; empty bins take their neighbours'."""
    level: list[list[float]] = []
    for p, n in zip(positives.tolist(), totals.tolist(), strict=True):
        level.append([p, n, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            last = level.pop()
            for k in range(3):
                level[-1][k] += last[k]
    return np.concatenate([np.full(int(k), p / n if n else np.nan) for p, n, k in level])


def roc_area(scores: np.ndarray, y: np.ndarray) -> float:
    """The chance that a positive scores above a negative (ties half)."""
    _, place, times = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    n = int(y.sum())
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / max(n * (len(y) - n), 1))
