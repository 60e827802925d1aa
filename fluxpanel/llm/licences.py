"""Licence scans (operator 10): a generalised suffix automaton of licence words.

The automaton accepts every run of words of any template.  A text streams
through it once and yields, word by word, the length of the longest run that
ends there (matching statistics).  Runs of MIN_RUN words or more that cannot
grow are chained in order, template by template; a chain that covers enough of
its template is a licence span.  The base scan for whole phrases is beside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import PHRASES, TEMPLATES
from .runtime import blobs, fields, map_batches, named, plain
from .textkit import ALNUM_LOWER

#: Words that a run must have, the share of a template that its chain must
#: cover, and the most words between two runs of a chain.
MIN_RUN, MIN_COVER, MAX_GAP = 4, 0.6, 20


@dataclass
class SuffixAutomaton:
    """Of several sequences of words.  `ends[s]` lists (sequence, last position)
    of every place where the runs of state s end."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    @classmethod
    def of(cls, sequences: list[list[bytes]]) -> SuffixAutomaton:
        out = cls()
        for k, words in enumerate(sequences):
            at = 0
            for place, word in enumerate(words):
                at = out._append(at, word)
                out.ends[at].append((k, place))
        for state in sorted(range(1, len(out.link)), key=lambda s: -out.length[s]):
            if out.link[state] > 0:
                out.ends[out.link[state]] += out.ends[state]
        out.ends = [sorted(set(e)) for e in out.ends]
        return out

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state of parent's longest run plus `word`, on its own if need be."""
        target = self.step[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        twin = self._state(self.length[parent] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = twin
        while parent >= 0 and self.step[parent].get(word) == target:
            self.step[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _append(self, at: int, word: bytes) -> int:
        if word in self.step[at]:
            return self._split(at, word)
        new = self._state(self.length[at] + 1, {}, 0)
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def runs(self, words: list[bytes], shortest: int) -> list[tuple[int, int, int]]:
        """(last word, number of words, state) of each run that cannot grow to the right."""
        found, at, size = [], 0, 0
        for place, word in enumerate(words):
            was = (place - 1, size, at)
            while at and word not in self.step[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.step[at]:
                at, size = self.step[at][word], size + 1
            if was[1] >= shortest and size <= was[1]:
                found.append(was)
        if size >= shortest:
            found.append((len(words) - 1, size, at))
        return found


@dataclass
class Scanner:
    labels: list[str]
    sizes: list[int]
    automaton: SuffixAutomaton
    vocabulary: dict[bytes, int]
    phrases: list[tuple[bytes, str]]

    @classmethod
    def of(cls, templates: list[tuple[str, str]], phrases: dict[str, str]) -> Scanner:
        split = [t.encode().translate(ALNUM_LOWER).split() for _, t in templates]
        known = {w: 1 for words in split for w in words}
        return cls([n for n, _ in templates], [len(w) for w in split], SuffixAutomaton.of(split), known, [(p.encode(), n) for p, n in phrases.items()])

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template covered)."""
        # A word of no template ends every run, so only stretches of known
        # words, of MIN_RUN at least, can hold one.
        known = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int8, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known, [0]))))
        per: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= MIN_RUN:
                for last, size, state in self.automaton.runs(words[a:b], MIN_RUN):
                    for k, end in self.automaton.ends[state]:
                        per.setdefault(k, []).append((a + last - size + 1, size, end - size + 1))
        out = []
        for k, found in per.items():
            out += [(self.labels[k], *span) for span in _chains(found, self.sizes[k])]
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Start words of all places of the phrases, and their labels."""
        starts, labels = [], set()
        joined = b" " + b" ".join(words) + b" "
        spaces = None
        for phrase, label in self.phrases:
            found, wanted = [], b" " + phrase + b" "
            at = joined.find(wanted)
            while at >= 0:
                found.append(at)
                at = joined.find(wanted, at + 1)
            if found:
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                starts += np.searchsorted(spaces, found).tolist()
                labels.add(label)
        return starts, labels


def _chains(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
    """Greedy chains of (text start, words, template start), in order in text and
    template and at most MAX_GAP words apart; those that cover enough."""
    out, open_chains = [], []
    for start, words, at in sorted(found):
        best = None
        for chain in open_chains:
            text_end, template_end = chain["end"], chain["at"]
            if 0 < start + words - 1 - text_end and 0 < at + words - 1 - template_end and start - text_end <= MAX_GAP and at - template_end <= MAX_GAP:
                gain = min(words, start + words - 1 - text_end, at + words - 1 - template_end)
                if best is None or chain["sum"] + gain > best[0]["sum"] + best[1]:
                    best = (chain, gain)
        if best:
            best[0].update(end=start + words - 1, at=at + words - 1, sum=best[0]["sum"] + best[1])
        else:
            chain = {"start": start, "end": start + words - 1, "at": at + words - 1, "sum": words}
            open_chains.append(chain)
            out.append(chain)
        open_chains = [c for c in open_chains if start - c["end"] <= MAX_GAP]
    return [(c["start"], c["end"], min(1.0, c["sum"] / size)) for c in out if c["sum"] >= MIN_COVER * size]


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))


def _scanned(batches, templates, phrases):
    scanner = Scanner.of(templates, phrases)
    for batch in batches:
        cols = {"n_words": [], "n_base": [], "first_word": [], "last_word": [], "base_labels": [], "spans": []}
        for text in blobs(batch, "text"):
            words = text.translate(ALNUM_LOWER).split() if text else []
            starts, labels = scanner.base(words)
            row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in scanner.spans(words)])
            for name, value in zip(cols, row, strict=True):
                cols[name].append(value)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), _SPAN]
        new = [pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *cols])


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels (array),
    spans (label, first and last word, share of the template covered), labels
    (array: those of the phrases and of the spans) and score.

    A run that several templates hold, such as an opening that two licences
    share, counts for each; of spans that cover enough all are listed, so a tie
    between templates gives both labels.  score is the largest share covered by a
    span, and 0.5 at least where a phrase stands.  Null and empty texts have no words, labels or spans and
    score 0.  Columns of these names are replaced."""
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score")
    docs, own = plain(docs, added)
    schema = fields(docs, docs.columns, "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,first:long,last:long,cover:double>>")
    out = map_batches(docs, lambda b: _scanned(b, templates, phrases), schema)
    both = F.array_sort(F.array_union("base_labels", "spans.label"))
    base = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return named(out.withColumns({"labels": both, "score": F.greatest(base, F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))}), own)


def licence_digest(docs: DataFrame) -> DataFrame:
    found = scan_licences(docs.select("doc_id", "text"))
    listed = [F.concat_ws(",", c).alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *listed, "score")
