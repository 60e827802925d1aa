"""Hashed n-gram features of whole texts, and linear models over them.

A document's features are the shares of its byte n-grams and of its words and
word pairs, each hashed into buckets.  A linear score is then a mean of
weights, which a batch takes in one gather over its bytes and words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import SparseRows, logistic, sigmoid, sparse_softmax
from .runtime import blobs, discard, map_batches, materialise
from .textkit import words_of

#: Buckets of each of the two kinds, and bytes of a character n-gram.
BUCKETS, CHARS = 1 << 15, 4
SCALE = 8.0

#: Bytes of features that a model is fitted on, at most, so that long documents
#: do not fill the driver.
TRAINING_BYTES = 128 << 20


@dataclass
class Grams:
    """Buckets of every occurrence in a batch, and where each document's begin."""

    index: np.ndarray
    first: np.ndarray


def char_grams(texts: list[bytes | None]) -> Grams:
    parts, first = [], [0]
    for text in texts:
        raw = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
        n = max(0, len(raw) - CHARS + 1)
        code = sum((raw[k : k + n] << np.uint32(8 * k) for k in range(CHARS)), np.zeros(n, np.uint32))
        parts.append((code * np.uint32(2654435761)) >> np.uint32(17))
        first.append(first[-1] + n)
    return Grams(np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(first))


def word_grams(texts: list[bytes | None]) -> list[Grams]:
    """Single words, then pairs."""
    words, out = words_of(texts), []
    for width in (1, 2):
        hashes, at = words.grams(width, seed=20 + width)
        out.append(Grams((hashes >> np.uint64(49)).astype(np.uint32), np.searchsorted(at, words.first)))
    return out


def _means(grams: Grams, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[grams.index], dtype=np.float64)))
    n = np.diff(grams.first)
    return (total[grams.first[1:]] - total[grams.first[:-1]]) / np.maximum(n, 1)


def sparse_rows(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their values, as training wants them."""
    chars, (singles, pairs) = char_grams(texts), word_grams(texts)
    out = []
    for k in range(len(texts)):
        index, value = [], []
        for offset, grams in ((0, chars), (BUCKETS, singles), (BUCKETS, pairs)):
            own = grams.index[grams.first[k] : grams.first[k + 1]]
            found, times = np.unique(own, return_counts=True)
            index.append(found + np.uint32(offset))
            value.append((SCALE * times / max(len(own), 1)).astype(np.float32))
        out.append((np.concatenate(index), np.concatenate(value)))
    return out


@dataclass
class LinearModel:
    """Class scores from hashed n-grams; `scale` and `shift` calibrate a binary one."""

    weights: np.ndarray
    intercepts: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        chars, (singles, pairs) = char_grams(texts), word_grams(texts)
        out = np.empty((len(texts), len(self.intercepts)))
        for c in range(out.shape[1]):
            w = self.weights[:, c]
            out[:, c] = SCALE * (_means(chars, w[:BUCKETS]) + _means(singles, w[BUCKETS:]) + _means(pairs, w[BUCKETS:]))
        return out + self.intercepts

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.logits(texts)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def margin(self, texts: list[bytes | None]) -> np.ndarray:
        z = self.logits(texts)
        return z[:, 1] - z[:, 0]

    def chance(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated probability of class 1."""
        return sigmoid(self.scale * self.margin(texts) + self.shift)


def _featured(batches):
    for batch in batches:
        rows = sparse_rows(blobs(batch, "text"))
        cols = [pa.array([v[k].tobytes() for v in rows], pa.binary()) for k in range(2)]
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "label")]
        yield pa.RecordBatch.from_arrays([*keep, *cols], ["doc_id", "label", "index", "value"])


def _bounded(rows: DataFrame) -> list:
    """The featured rows, at most TRAINING_BYTES of them: those with the smallest
    hash of doc_id up to the first that goes beyond, in the order of doc_id."""
    featured = materialise(rows)
    sizes = featured.select("doc_id", F.xxhash64("doc_id").alias("h"), (2 * F.octet_length("index")).cast("long").alias("size")).collect()
    total, last = 0, None
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        total += r["size"]
        if total > TRAINING_BYTES and last is not None:
            break
        last = r["h"]
    found = featured.filter(F.xxhash64("doc_id") <= F.lit(last)).orderBy("doc_id").collect() if sizes else []
    discard(featured)
    return found


def fit(rows: DataFrame, classes: int, ridge: float = 1e-6, rounds: int = 80, calibrate: bool = False) -> LinearModel:
    """Fits (doc_id, text, label) rows, of which there is a bounded number and,
    as features, at most TRAINING_BYTES.

    With `calibrate`, every fifth row is kept from the fit of the weights and
    serves the logistic calibration of a binary model."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = _bounded(map_batches(rows, _featured, f"doc_id {kind}, label int, index binary, value binary"))
    rows_of = [(np.frombuffer(r["index"], np.uint32), np.frombuffer(r["value"], np.float32)) for r in found]
    y = np.array([r["label"] for r in found], np.int64)
    held = np.arange(len(y)) % 5 == 0 if calibrate else np.zeros(len(y), bool)
    train, test = (SparseRows.of([r for r, h in zip(rows_of, held, strict=True) if h == kind]) for kind in (False, True))
    del found, rows_of
    weights, intercepts = sparse_softmax(train, y[~held], 2 * BUCKETS, classes, ridge, rounds)
    model = LinearModel(weights.astype(np.float32), intercepts)
    if held.any():
        z = test.dot(weights) + intercepts
        model.scale, model.shift = logistic(z[:, 1:] - z[:, :1], y[held], 1e-3).tolist()
    return model
