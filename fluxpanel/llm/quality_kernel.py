"""Quality classifier (operator 9): random Fourier features and ridge scores.

Statistics of every document are taken once and written.  Cosines of random
projections of the standardised statistics approximate a Gaussian kernel; their
normal equations are summed within partitions, then over groups of partitions,
and solved on the driver.  Isotonic calibration, on a histogram of the training
scores, turns the ridge score into a probability.  All labelled rows of the
allowed folds take part; what reaches the driver has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docstats import doc_stats, statistics
from .learning import fold, isotonic
from .runtime import blobs, discard, map_batches, materialise

#: Cosines, kernel width in standard deviations, ridge penalty (a share of the
#: rows), bins of the calibration, and how many partial sums reach the driver.
FEATURES, WIDTH, RIDGE, BINS, SUMS = 256, 4.0, 1e-4, 512, 16

#: Positives and negatives each count for this many rows in a bin's prior.
PRIOR = 0.5


@dataclass
class Kernel:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    cuts: np.ndarray | None = None
    chances: np.ndarray | None = None

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 5) -> Kernel:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(len(mean), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES))

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ self.project + self.phase), np.ones(len(x))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -0.5, 1.5)

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """The calibrated score, linear between the middles of the bins."""
        return np.clip(np.interp(self.raw(rows), self.cuts, self.chances), 0, 1)


def _described(batches):
    for batch in batches:
        rows = statistics(doc_stats(blobs(batch, "text")))
        width = rows.shape[1]
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "statistics"])


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(rows: DataFrame, one) -> np.ndarray | None:
    """The sum over all rows of `one(statistics, labels)`, an array of fixed
    shape: within partitions, over SUMS groups of partitions, on the driver."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                got = one(x, y.astype(np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])

    def add(batches):
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                got = np.frombuffer(blob, np.float64)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sum"])

    sums = map_batches(rows.select("statistics", "label"), partial, "part int, sum binary")
    # With many files there is a level more, so no task adds up too many.
    many = int(len(rows.inputFiles()) ** 0.5)
    for groups in [many] * (many > 2 * SUMS) + [SUMS]:
        sums = map_batches(sums.repartition(groups, "part"), add, "part int, sum binary")
    sums = sums.collect()
    return sum(np.frombuffer(r["sum"], np.float64) for r in sums) if sums else None


def train(described: DataFrame, labels: DataFrame, allowed: Column) -> Kernel:
    """From (doc_id, statistics) rows and labels of the allowed folds."""
    known = labels.filter(F.col("quality").isNotNull() & allowed).select(F.col("doc_id").try_cast(described.schema["doc_id"].dataType).alias("doc_id"), "quality")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = materialise(described.join(known, "doc_id").select("statistics", "label"))
    width = statistics(doc_stats([b"a b"])).shape[1]

    moments = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if moments is None:
        blank = Kernel.of(np.zeros(width), np.ones(width))
        blank.weights, blank.cuts, blank.chances = np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])
        return blank
    n, mean = moments[0], moments[1 : width + 1] / moments[0]
    kernel = Kernel.of(mean, np.sqrt(np.maximum(moments[width + 1 :] / n - mean**2, 1e-6)))

    def normal(x, y):
        z = kernel.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows, normal)
    size = FEATURES + 1
    gram = sums[: size * size].reshape(size, size)
    kernel.weights = np.linalg.solve(gram + RIDGE * n * np.eye(size), sums[size * size :])

    def histogram(x, y):
        at = np.clip(((kernel.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]).astype(np.float64)

    sums = _summed(rows, histogram)
    filled = np.flatnonzero(sums[BINS:] > 0)
    share = sums[:BINS].sum() / n
    kernel.cuts = (filled + 0.5) / BINS * 2 - 0.5
    steps = isotonic(kernel.cuts, sums[:BINS][filled] + PRIOR * share, sums[BINS:][filled] + PRIOR)
    discard(rows)
    # A small slope within a step keeps the order of the ridge scores.
    kernel.chances = 0.999 * steps + 0.001 * np.clip((kernel.cuts + 0.5) / 2, 0, 1)
    return kernel


def score_quality(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """doc_id and score (a probability of quality) of every row of `docs`.

    Null and empty texts are scored as texts without characters.  Without
    labelled rows every score is 0.5.  Other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = materialise(map_batches(docs.select("doc_id", "text"), _described, f"doc_id {kind}, statistics array<double>"))
    kernel = train(described, labels, allowed)
    shipped = docs.sparkSession.sparkContext.broadcast(kernel)

    def scored(batches):
        for batch in batches:
            chance = shipped.value.chance(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance)], ["doc_id", "score"])

    return map_batches(described, scored, f"doc_id {kind}, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, labels, fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
