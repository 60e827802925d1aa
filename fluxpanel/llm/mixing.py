"""Mixing to target weights (operator 3): soft membership, projected gradients.

A classifier fitted on the labels table gives every document posteriors over
domains.  Documents get nonnegative rates whose expected token totals per
domain match the targets: least squares with a pull towards rate 1, solved by
projected gradients with spectral steps until no rate can still improve.  A
step needs the totals per domain only, and a document's rate follows from its
posteriors and the steps so far, so the state that travels is a short list of
numbers and a lost executor costs one re-read.

Posteriors are kept in steps of 1 / GRID.  Documents with the same posteriors have the
same rate, so one aggregate sums up their tokens, and the passes of the gradients run
over its rows: GRID + 2 over 2 of them at most for three domains, however many
documents there are.

Tokens are words here (runs of characters other than ASCII white space).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import labelled
from .ngrams import LinearModel, fit
from .runtime import blobs, discard, fields, map_batches, materialise, named, plain
from .textkit import words_of

#: Domains, from the labels table, and their target shares of all tokens.
DOMAINS = ("clean", "low", "toxic")
TARGETS = (0.94, 0.06, 0.0)

#: Labelled rows that the classifier is fitted on, at most; pull towards rate 1; parts
#: of a posterior.
TRAINING_ROWS, PULL, GRID = 3000, 1e-3, 1024

#: Steps at most; the weighted length of the projected gradient that ends them; earlier
#: steps that a step may be no worse than.
STEPS, SETTLED, LOOK_BACK = 400, 1e-9, 10

#: A long step is taken where the short one is at least this part of it (at first; a
#: tenth more after each long step, a tenth less after others); else the shortest of so
#: many short ones.
ALIKE, SHORT_ONES = 0.5, 5


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> LinearModel:
    """A document is toxic if labelled so, else low or clean by its quality."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return fit(labelled(docs, labels.select("doc_id", domain.alias("domain")), "domain", F.lit(True), bound), len(DOMAINS))


def with_posteriors(docs: DataFrame, model: LinearModel, columns: list[str]) -> DataFrame:
    """The columns of every row, n_tokens and posteriors (array)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def described(batches):
        for batch in batches:
            texts = blobs(batch, "text")
            rows = on_grid(shipped.value.posteriors(texts)) if texts else np.zeros((0, len(DOMAINS)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(words_of(texts).counts, pa.int64()), values], [*columns, "n_tokens", "posteriors"])

    own = docs.select(*dict.fromkeys([*columns, "text"]))
    return map_batches(own, described, fields(own, columns, "n_tokens long, posteriors array<double>"))


def on_grid(p: np.ndarray) -> np.ndarray:
    """Posteriors as multiples of 1 / GRID that add up to 1, those with the largest
    remainders rounded up."""
    whole = np.floor(p * GRID)
    rest = np.argsort(np.argsort(whole - p * GRID, axis=1, kind="stable"), axis=1)
    return (whole + (rest < GRID - whole.sum(1, keepdims=True))) / GRID


@dataclass(frozen=True)
class Step:
    """The size of a step and the residuals of the domains, divided by their shares, that it goes against."""

    size: float
    slope: tuple[float, ...]


def gradient(p: np.ndarray, r: np.ndarray, slope, pull: float) -> np.ndarray:
    return p @ np.asarray(slope) + pull * (r - 1)


def rates(p: np.ndarray, steps: list[Step], pull: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors `p` after the steps, and before the last."""
    r = was = np.ones(len(p))
    for s in steps:
        was, r = r, np.maximum(0, r - s.size * gradient(p, r, s.slope, pull))
    return r, was


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(groups: DataFrame, width: int, f) -> list[np.ndarray]:
    """Sums over the groups of the arrays that f(posteriors, tokens) gives."""
    shapes = [np.shape(v) for v in f(np.zeros((1, width)), np.zeros(1))]
    cuts = np.cumsum([int(np.prod(s, dtype=int)) for s in shapes])
    names = [f"v{k}" for k in range(cuts[-1])]

    def partial(batches):
        total = np.zeros(cuts[-1])
        for batch in batches:
            found = f(_matrix(batch.column(1), width), batch.column(0).to_numpy(zero_copy_only=False).astype(float))
            total += np.concatenate([np.ravel(v) for v in found])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.tolist()], names)

    parts = groups.select("n_tokens", "posteriors").mapInArrow(partial, ", ".join(f"{v} double" for v in names))
    row = np.array([v or 0.0 for v in parts.agg(*[F.sum(v) for v in names]).first()])
    return [v.reshape(s) for v, s in zip(np.split(row, cuts[:-1]), shapes, strict=True)]


def fit_rates(described: DataFrame, targets: tuple[float, ...] = TARGETS, pull: float = PULL, steps: int = STEPS) -> list[Step]:
    """The steps that lead to the rates, at which the projected gradient vanishes.

    Sizes are those of Barzilai and Borwein, of whose two rules the long one is taken
    where both nearly agree.  Only documents that can move count in the curvature: those
    that stay at rate 0 would make the short steps far too short.  A step that comes out
    worse than the last LOOK_BACK ones is taken back and halved.  Rates that have not
    settled after `steps` passes are an error."""
    width = len(targets)
    # Written, as every pass reads it; of bounded size, so a few tasks are enough.
    groups = materialise(described.groupBy("posteriors").agg(F.sum("n_tokens").alias("n_tokens")).filter("n_tokens > 0").coalesce(8))
    (start,) = _sums(groups, width, lambda p, n: (np.append(n @ p, n.sum()),))
    total = start[width]
    if not total:
        return []
    wanted, shares = np.array(targets) / sum(targets), np.maximum(start[:width] / total, 1e-6)
    slope_at = lambda totals: np.round((totals / total - wanted) / shares, 12)
    slope = slope_at(start[:width])
    done, values, short = [Step(1 / (1 + pull), tuple(slope))], [shares @ slope**2 / 2], []
    alike = ALIKE
    for _ in range(steps):
        now = list(done)

        def moved(p, n, now=now):
            r, was = rates(p, now, pull)
            # How far the rates before the step could still move, and the step itself.
            free = was - np.maximum(0, was - gradient(p, was, now[-1].slope, pull))
            step, able = r - was, n * ((r > 0) | (was > 0))
            return (n * r) @ p, n @ (free * free), n @ (step * step), (n * step) @ p, n @ ((r - 1) ** 2), (p * able[:, None]).T @ p

        totals, free, ss, sp, off, square = (v / total for v in _sums(groups, width, moved))
        if np.sqrt(free) < SETTLED:
            discard(groups)
            return done[:-1]
        fresh = slope_at(totals * total)
        value = shares @ fresh**2 / 2 + pull * off / 2
        if value > max(values[-LOOK_BACK:]) + 1e-15:
            done[-1] = Step(done[-1].size / 2, done[-1].slope)
            continue
        turn = fresh - slope
        sy, yy = turn @ sp + pull * ss, turn @ square @ turn + 2 * pull * turn @ sp + pull**2 * ss
        if sy <= 0 or yy <= 0:
            size = 1 / (1 + pull)
        else:
            short.append(sy / yy)
            long = short[-1] >= alike * ss / sy
            size, alike = (ss / sy, alike * 1.1) if long else (min(short[-SHORT_ONES:]), alike * 0.9)
        slope = fresh
        values.append(value)
        done.append(Step(float(np.round(min(max(size, 0.1), 1 / pull), 12)), tuple(slope)))
    raise RuntimeError(f"rates did not settle: a projected gradient of {np.sqrt(free):.3g} is left after {steps} steps")


def _rate(steps: list[Step], pull: float) -> Column:
    """The rates that the steps lead to, of the column of posteriors."""

    @F.pandas_udf("double")
    def rate(*p: pd.Series) -> pd.Series:
        return pd.Series(rates(np.column_stack([c.to_numpy(float) for c in p]), steps, pull)[0])

    return rate(*[F.col("posteriors")[k] for k in range(len(DOMAINS))])


def _copies(key: str) -> Column:
    """The whole part of the rate, and one more with the chance of the rest."""
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies")


def mix(docs: DataFrame, model: LinearModel, targets: tuple[float, ...] = TARGETS, pull: float = PULL) -> DataFrame:
    """doc_id, n_tokens, a posterior per domain, rate and copies of every row.

    copies is the whole part of the rate, and one more with the chance of the
    rest, by the hash of doc_id.  Documents without words have rates by their
    posteriors too, and change no total.  An empty table stays empty."""
    described = materialise(with_posteriors(docs, model, ["doc_id"]))
    steps = fit_rates(described, targets, pull)
    named = [F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return described.select("doc_id", "n_tokens", *named, _rate(steps, pull).alias("rate")).select("*", _copies("doc_id"))


def mix_rows(docs: DataFrame, model: LinearModel, targets: tuple[float, ...] = TARGETS, pull: float = PULL) -> DataFrame:
    """`docs` with rate and copies beside each row.  Rows are written once with
    their posteriors, on which the rates are fitted, so no text is scored twice
    and no join moves texts.  Columns of these names, and of n_tokens and
    posteriors, are replaced."""
    docs, own = plain(docs, ("rate", "copies", "n_tokens", "posteriors"), ("doc_id", "text"))
    described = materialise(with_posteriors(docs, model, docs.columns))
    steps = fit_rates(described.select("n_tokens", "posteriors"), targets, pull)
    return named(described.select(*docs.columns, _rate(steps, pull).alias("rate")).withColumn("copies", _copies("doc_id")), own)


def mixing_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, train(docs, labels))
