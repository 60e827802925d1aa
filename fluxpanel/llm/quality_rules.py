"""Quality rules (operator 1): hashed n-gram logistic regression.

Base rules on counts of the whole text come first; the verdict on the rest is
the calibrated probability of a logistic regression over hashed character and
word n-grams, trained on labelled rows, against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import doc_stats
from .learning import labelled
from .ngrams import LinearModel, fit
from .runtime import blobs, fields, map_batches, named, plain

#: Labelled rows that the model is fitted on, at most.
TRAINING_ROWS = 2000

#: Base rules: words at least, percentage of repeated words at most; then the
#: probability of quality at least (low, since a wrongly dropped text costs more
#: than a kept one).
MIN_WORDS, MAX_REPEATED, KEEP = 10, 20, 0.2


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> LinearModel:
    return fit(labelled(docs, labels, "quality", F.lit(True), bound), 2, calibrate=True)


def _scored(batches, shipped):
    model = shipped.value
    for batch in batches:
        texts = blobs(batch, "text")
        stats = doc_stats(texts)
        failed = (stats.n_words < MIN_WORDS) | (100 * stats.n_repeat_words > MAX_REPEATED * stats.n_words)
        chance = model.chance(texts)
        new = {
            "n_words": stats.n_words, "word_chars": stats.word_chars, "n_symbols": stats.counts["symbol"], "n_dup_lines": stats.n_dup_lines,
            "n_repeat_words": stats.n_repeat_words, "base_failed": failed, "kept": ~failed & (chance >= KEEP), "quality": chance,
        }
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.asarray(v), t) for v, t in zip(new.values(), kinds, strict=True)]], [*batch.schema.names, *new])


def apply_rules(docs: DataFrame, model: LinearModel) -> DataFrame:
    """`docs` with the five counts, base_failed, kept and quality (a probability).

    Null and empty texts have no words and fail.  Columns of these names are
    replaced."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    docs, own = plain(docs, added)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = fields(docs, docs.columns, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")
    return named(map_batches(docs, lambda b: _scored(b, shipped), schema), own)


def rules_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply_rules(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
