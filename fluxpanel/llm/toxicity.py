"""Toxicity (operator 8): Levenshtein automata intersected with a lexicon trie.

The lexicon is a short fixed list and the words and word beginnings that mark
toxic documents among labelled ones.  Its trie is intersected with the
automaton of all strings at one edit at most; the product, made deterministic,
is one transition table, which all words of a batch pass through side by side.
Each hit is weighed by its context: within quotation marks or after a word of
reporting it counts as quotation, else as abuse, and hits close together add
up.  A logistic regression on these sums gives the probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import fold, labelled, logistic, sigmoid
from .runtime import blobs, discard, fields, map_batches, named, plain

#: Labelled rows that the lexicon and the weights are learned from, at most.
TRAINING_ROWS = 20_000

#: Terms of abuse that count before any is learned.
SEEDS = (
    "idiot", "moron", "stupid", "imbecile", "loser", "scum", "trash", "garbage", "clown",
    "pathetic", "disgusting", "worthless", "dumbass", "bastard", "retard", "asshole",
)

#: Words before a hit that report another's speech.
REPORTING = ("said", "says", "called", "wrote", "quoted", "quote", "term", "word", "slur", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

#: Letters of a learned whole word, at least; of a learned beginning, at least and
#: at most; letters of a term that an edit may touch; the odds ratio that a learned
#: term needs; the share of toxic documents it must be in; how many terms make a
#: document explained.
WHOLE, SHORTEST, LONGEST, FUZZY, ODDS, SHARE, EXPLAINED = 3, 4, 12, 5, 20.0, 0.004, 3

#: Words on either side of a hit in which hits add up; characters before a hit in
#: which a word of reporting is looked for.
NEAR, REPORTED = 20, 40

#: What a misspelled hit counts beside an exact one, in sums over hits.
MISSPELLED = 0.5

#: Word beginnings that the lexicon is chosen from, the most frequent, at most; of
#: them, those that mark toxic documents, likewise.  With LONGEST they bound what the
#: driver holds: some 20 MB.
CANDIDATES, MARKS = 200_000, 5_000

#: Opening and closing quotation marks, besides the one that is both.
QUOTES = ("“”", "«»", "„“")


@dataclass
class Term:
    text: str
    whole: bool
    weight: float


class Trie:
    def __init__(self, terms: list[Term]):
        self.next: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.deep = [0]
        for k, term in enumerate(terms):
            at, path = 0, [0]
            for c in term.text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.deep.append(0)
                at = self.next[at][c]
                path.append(at)
            self.term[at] = k
            for node in path:
                self.deep[node] = max(self.deep[node], len(term.text))


class Automaton:
    """The determinised product.  `table[state, letter]` is the next state (0 is
    dead); `within[d][state]` is the term whose beginning has just been read with
    d edits, `at_end[d][state]` the term that the whole word is, or -1."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        trie = Trie(terms)
        letters = sorted({c for t in terms for c in t.text})
        self.letters = {c: k + 1 for k, c in enumerate(letters)}

        # An item is (trie node, edits so far, was the last letter read as is).
        def closed(items: set) -> frozenset:
            out = set(items)
            for node, edits, _ in items:
                if not edits:
                    out |= {(n, 1, False) for n in trie.next[node].values() if trie.deep[n] >= FUZZY}
            exact = {n for n, e, _ in out if not e}
            return frozenset(i for i in out if not (i[1] and i[0] in exact))

        def step(items: frozenset, letter: str | None) -> frozenset:
            out = set()
            for node, edits, _ in items:
                if letter in trie.next[node]:
                    out.add((trie.next[node][letter], edits, True))
                if not edits:
                    if trie.deep[node] >= FUZZY:
                        out.add((node, 1, False))
                    out |= {(n, 1, False) for c, n in trie.next[node].items() if c != letter and trie.deep[n] >= FUZZY}
            return closed(out)

        states = {frozenset(): 0, (start := closed({(0, 0, False)})): 1}
        queue, rows = [start], {0: [0] * (len(letters) + 1)}
        for items in queue:
            row = []
            for letter in [None, *letters]:
                after = step(items, letter)
                if after not in states:
                    states[after] = len(states)
                    queue.append(after)
                row.append(states[after])
            rows[states[items]] = row
        self.table = np.array([rows[k] for k in range(len(states))], np.int32)
        self.within = np.full((2, len(states)), -1, np.int32)
        self.at_end = np.full((2, len(states)), -1, np.int32)
        for items, state in states.items():
            for node, edits, read in items:
                k = trie.term[node]
                if k < 0 or edits and len(terms[k].text) < FUZZY:
                    continue
                if terms[k].whole:
                    self.at_end[edits, state] = k
                elif read:
                    self.within[edits, state] = k

    def match(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, edits, term) of the words that match, with the fewest edits."""
        best = np.full((2, len(starts)), -1, np.int32)
        live = np.arange(len(starts))
        state = np.ones(len(starts), np.int32)
        depth = 0
        while len(live):
            state = self.table[state, letters[starts[live] + depth]]
            depth += 1
            ended = sizes[live] == depth
            for d in range(2):
                for kind, where in ((self.within, slice(None)), (self.at_end, ended)):
                    term = kind[d][state[where]]
                    best[d, live[where][term >= 0]] = term[term >= 0]
            on = (state > 0) & ~ended
            live, state = live[on], state[on]
        found = np.flatnonzero((best >= 0).any(0))
        edits = np.where(best[0, found] >= 0, 0, 1)
        return found, edits, best[edits, found]


@dataclass
class Text:
    """Words of a batch of lower-cased texts, as code points."""

    texts: list[str]
    codes: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray


_IS_WORD: list[np.ndarray] = []


def read(texts: list[bytes | None]) -> Text:
    if not _IS_WORD:
        _IS_WORD.append(np.array([chr(c).isalnum() for c in range(0x110000)], bool))
    lower = [(t or b"").decode().lower() for t in texts]
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), np.uint32)
    base = np.cumsum([0] + [len(t) + 1 for t in lower])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], _IS_WORD[0][codes].view(np.int8), [0]))))
    starts = edges[::2]
    return Text(lower, codes, base, starts, edges[1::2] - starts, np.searchsorted(base, starts, side="right") - 1)


def quoted(t: Text, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether codes[start:end] is quotation: between quotation marks on its
    whole line, or shortly after a word of reporting."""
    at = {c: np.flatnonzero(t.codes == ord(c)) for c in set('\n"' + "".join(QUOTES))}

    def last(c: str, before: np.ndarray) -> np.ndarray:
        """The last place of c before, or -1."""
        k = np.searchsorted(at[c], before)
        return np.concatenate(([-1], at[c]))[k]

    line = last("\n", starts) + 1
    # Every text ends with a line feed.
    stop = at["\n"][np.searchsorted(at["\n"], ends)] if len(ends) else ends
    follows = lambda c: np.searchsorted(at[c], ends) < np.searchsorted(at[c], stop)
    out = ((np.searchsorted(at['"'], starts) - np.searchsorted(at['"'], line)) % 2 == 1) & follows('"')
    for a, b in QUOTES:
        out |= (last(a, starts) >= line) & (last(a, starts) > last(b, starts)) & follows(b)
    for k in np.flatnonzero(~out).tolist():
        near = t.codes[max(line[k], starts[k] - REPORTED) : starts[k]].tobytes().decode("utf-32-le")
        out[k] = any(w.strip(".,:;!?()'\"") in REPORTING for w in near.split()[-4:])
    return out


#: Sums over a document's hits, the inputs of its score.
INPUTS = ("exact", "misspelled", "quoted", "weight", "near", "density", "near_all", "density_all")


def hit_inputs(texts: list[bytes | None], automaton: Automaton) -> tuple[np.ndarray, list[list[dict]]]:
    """A row of INPUTS for each text, and its hits (start, end, term, edits, quoted)."""
    t = read(texts)
    letter_of = np.zeros(max([0x110000 if len(t.codes) and t.codes.max() > 0xFFFF else 0x10000]), np.int32)
    for c, k in automaton.letters.items():
        letter_of[ord(c)] = k
    words, edits, terms = automaton.match(letter_of[t.codes], t.starts, t.sizes)
    rows, hits = np.zeros((len(texts), len(INPUTS))), [[] for _ in texts]
    first = np.searchsorted(t.owner, np.arange(len(texts) + 1))
    in_quotes = quoted(t, t.starts[words], t.starts[words] + t.sizes[words])
    for doc, a, b in _runs(t.owner[words]):
        own = words[a:b]
        abuse, share = [], []
        for w, e, k, said in zip(own.tolist(), edits[a:b].tolist(), terms[a:b].tolist(), in_quotes[a:b].tolist(), strict=True):
            start = int(t.starts[w] - t.base[doc])
            end = start + int(t.sizes[w])
            hits[doc].append({"start": start, "end": end, "term": automaton.terms[k].text, "edits": e, "quoted": said})
            rows[doc, 2 if said else e] += 1
            if not said:
                abuse.append(w)
                share.append(MISSPELLED if e else 1.0)
                rows[doc, 3] = max(rows[doc, 3], share[-1] * automaton.terms[k].weight)
        # Hits in the window around each hit and among all words: exact ones, then all by their shares.
        for column, least in ((4, 1.0), (6, 0.0)):
            taken = np.array(share) >= least
            if taken.any():
                near, total = np.array(abuse)[taken], np.concatenate(([0.0], np.cumsum(np.array(share)[taken])))
                rows[doc, column] = (total[np.searchsorted(near, near + NEAR, side="right")] - total[np.searchsorted(near, near - NEAR)]).max()
                rows[doc, column + 1] = 100 * total[-1] / max(1, first[doc + 1] - first[doc])
    sums = [0, 1, 2, 4, 5, 6, 7]
    rows[:, sums] = np.log1p(rows[:, sums])
    rows[:, 3] /= 5
    return rows, hits


def _runs(values: np.ndarray):
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        if b > a:
            yield int(values[a]), a, b


def _beginnings(text: bytes | None) -> set[str]:
    """Beginnings of the words of a text; of a whole word with "$" too, and of
    a word shorter than any beginning only that."""
    t = read([text])
    out = set()
    for word in {t.texts[0][a : a + n] for a, n in zip(t.starts.tolist(), t.sizes.tolist(), strict=True)}:
        if len(word) >= WHOLE and word[0].isalpha():
            out.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
            if len(word) <= LONGEST:
                out.add(word + "$")
    return out


def _counting(only: frozenset | None):
    def count(batches):
        for batch in batches:
            total = Counter()
            for text in blobs(batch, "text"):
                found = _beginnings(text)
                total.update(found if only is None else found & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["part", "n"])

    return count


def _counts(rows: DataFrame, least: int, only: frozenset | None = None) -> dict[str, int]:
    """In how many of the (bounded) rows each beginning stands; of the most frequent
    CANDIDATES, of which `only` is never more."""
    parts = map_batches(rows.select("text"), _counting(only), "part string, n long")
    total = parts.groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r["part"]: r["n"] for r in total.orderBy(F.desc("n"), "part").limit(CANDIDATES).collect()}


def learn_lexicon(rows: DataFrame) -> list[Term]:
    """Seeds, and beginnings of words that mark label 1 among (text, label) rows."""
    per = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = per.get(1, 0), per.get(0, 0)
    least = max(3, int(SHARE * n_pos))
    pos = _counts(rows.filter("label = 1"), least)
    neg = _counts(rows.filter("label = 0"), 1, frozenset(pos))
    odds = lambda p: (pos.get(p, 0) + 0.5) / (n_pos + 1) / ((neg.get(p, 0) + 0.5) / (n_neg + 1))
    marks = {p for p in pos if (not p.endswith("$") or len(p) <= SHORTEST) and odds(p) >= ODDS}
    # Of beginnings in the same documents only the longest is of use.
    longer = {p[:-1] for p in marks if len(p) > SHORTEST and pos[p] == pos.get(p[:-1])}
    marks -= longer
    wanted = frozenset(sorted(marks, key=lambda p: (-pos[p], p))[:MARKS])

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_beginnings(t) & wanted) for t in blobs(batch, "text")], pa.list_(pa.string()))], ["held"])

    where: dict[str, list[int]] = {}
    for k, r in enumerate(map_batches(rows.filter("label = 1").select("text"), held, "held array<string>").collect()):
        for p in r["held"]:
            where.setdefault(p, []).append(k)
    # From the most frequent on, a term is taken if enough documents are not
    # yet explained by others: words that copies of one text share are not.
    explained, chosen = Counter(), []
    for p in sorted(where, key=lambda p: (-len(where[p]), p)):
        fresh = sum(explained[k] < EXPLAINED for k in where[p])
        if fresh >= least and not any(p.startswith(c) for c in chosen):
            chosen.append(p)
            explained.update(where[p])
    terms = {s: Term(s, True, max(2.0, float(np.log(odds(s)))) if n_pos else 2.0) for s in SEEDS}
    for p in chosen:
        whole = p.endswith("$") or pos.get(p + "$", 0) >= 0.5 * pos[p]
        terms[p] = Term(p.removesuffix("$"), whole, float(np.log(odds(p))))
    return sorted(terms.values(), key=lambda t: t.text)


@dataclass
class Toxicity:
    automaton: Automaton
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(rows @ self.weights[:-1] + self.weights[-1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = TRAINING_ROWS) -> Toxicity:
    rows = labelled(docs, labels, "toxic", allowed, bound)
    automaton = Automaton(learn_lexicon(rows))
    shipped = docs.sparkSession.sparkContext.broadcast(automaton)

    def described(batches):
        for batch in batches:
            values = hit_inputs(blobs(batch, "text"), shipped.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(values), pa.list_(pa.float64()))], ["label", "doc_id", "inputs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = map_batches(rows.select("text", "label", "doc_id"), described, f"label int, doc_id {kind}, inputs array<double>").orderBy("doc_id").collect()
    discard(rows)
    x = np.array([r["inputs"] for r in found]).reshape(-1, len(INPUTS))
    return Toxicity(automaton, logistic(x, np.array([r["label"] for r in found], float), 1e-3))


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_())]))


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """`docs` with score (a probability) and hits (start, end, term, edits, quoted;
    offsets in the lower-cased text).

    Null and empty texts have no hits and get the score of a text without any.
    Columns of these names are replaced."""
    docs, own = plain(docs, ("score", "hits"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            rows, hits = hit_inputs(blobs(batch, "text"), shipped.value.automaton)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.scores(rows)), pa.array(hits, _HITS)], [*batch.schema.names, "score", "hits"])

    schema = fields(docs, docs.columns, "score double, hits array<struct<start:long,end:long,term:string,edits:long,quoted:boolean>>")
    return named(map_batches(docs, scored, schema), own)


def allowed_rows() -> Column:
    """The fold whose labels may be learned from."""
    return fold("doc_id", 5) != 0


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels, allowed_rows()))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))
