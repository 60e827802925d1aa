"""Benchmark decontamination (operator 7): one Aho-Corasick automaton.

The windows of all benchmark items go into one automaton over word numbers,
which every text passes through once.  Its states lie in the order of depth,
parent and word, so a child is found by binary search in one array of keys, and
a state costs 12 to 16 bytes.  The words of a batch are cut into pieces that
overlap by a window and pass through the automaton side by side.  Matches mark
words, and runs of marked words are mapped back to offsets of the original.

An automaton takes about MAX_ITEM_BYTES of benchmark text, some 0.5 GB of a worker;
an item is never cut, so one that is longer takes as much more.  A larger benchmark is scanned slice by slice, one after another: a slice is
collected, scanned and let go before the next, and what it found is written.
"""

from __future__ import annotations

import itertools
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blobs, discard, fields, map_batches, materialise, named, plain, small_side
from .textkit import ALNUM_LOWER, spread

#: Words of a window; a document is contaminated if a twentieth of its words is hit.
WINDOW, HIT_SHARE = 13, 20

#: Benchmark text that one automaton takes.
MAX_ITEM_BYTES = 16 << 20

#: Words of a piece of text, besides the overlap.
PIECE = 64

#: Words in the original text, where A-Z are still there.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """The words, lower case."""
    return text.translate(ALNUM_LOWER).split() if text else []


@dataclass
class Automaton:
    """State 0 is the root.  State s > 0 has keys[s - 1] = parent << 32 | word;
    `fail` is its longest proper suffix that is a state, `ends` the longest window
    that it ends with (its own number or that of a suffix, 0 without any) and
    `depth_from[d]` the first state of depth d.  The items of a window's state w
    are owners[first[w] : first[w] + count[w]], found by search in `windows`."""

    vocabulary: dict[bytes, int]
    keys: np.ndarray
    fail: np.ndarray
    ends: np.ndarray
    depth_from: np.ndarray
    windows: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    names: list[str]
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], width: int) -> Automaton | None:
        """Of (item id, words): all windows of an item; of one with fewer words, the whole."""
        vocabulary: dict[bytes, int] = {}
        names = sorted({name for name, found in items if found})
        place = {name: k for k, name in enumerate(names)}
        sequence, starts, sizes, item = [], [], [], []
        at = 0
        for name, found in items:
            if not found:
                continue
            sequence.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int64, len(found)))
            n = max(1, len(found) - width + 1)
            starts.append(np.arange(at, at + n))
            sizes.append(np.full(n, min(width, len(found))))
            item.append(np.full(n, place[name]))
            at += len(found)
        if not names:
            return None
        word, start, size, item = (np.concatenate(v) for v in (sequence, starts, sizes, item))
        state, keys, depth_from = np.zeros(len(start), np.int64), [], [0, 1]
        for depth in range(int(size.max())):
            live = np.flatnonzero(size > depth)
            found, back = np.unique(state[live] << 32 | word[start[live] + depth], return_inverse=True)
            state[live] = depth_from[-1] + back
            keys.append(found)
            depth_from.append(depth_from[-1] + len(found))
        keys, depth_from = np.concatenate(keys), np.array(depth_from)
        pairs = np.unique(state << 32 | item)
        windows, first = np.unique(pairs >> 32, return_index=True)
        out = cls(vocabulary, keys, np.zeros(len(keys) + 1, np.int32), np.zeros(len(keys) + 1, np.int32), depth_from, windows, np.append(first, len(pairs)), (pairs & 0xFFFFFFFF).astype(np.int32), names, int(size.min()))
        out.ends[windows] = windows
        for depth in range(2, len(depth_from) - 1):
            for lo in range(depth_from[depth], depth_from[depth + 1], 1 << 20):
                own = np.arange(lo, min(lo + (1 << 20), depth_from[depth + 1]))
                out.fail[own] = out.step(out.fail[keys[own - 1] >> 32].astype(np.int64), keys[own - 1] & 0xFFFFFFFF)
        for depth in range(2, len(depth_from) - 1):
            own = slice(depth_from[depth], depth_from[depth + 1])
            out.ends[own] = np.where(out.ends[own] > 0, out.ends[own], out.ends[out.fail[own]])
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after reading a word each: down where there is a child,
        else from the next shorter suffix."""
        out = np.zeros(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            key = state[live] << 32 | word[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[at] == key
            out[live[met]] = at[met] + 1
            live = live[~met & (state[live] > 0)]
            state = state.copy() if len(live) else state
            state[live] = self.fail[state[live]]
        return out

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, state of the window) of every window in a
        sequence of word numbers, of which -1 is no word of any item."""
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        a, b = edges[::2], edges[1::2]
        long = b - a >= self.shortest
        a, b = a[long], b[long]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = len(self.depth_from) - 3
        # Every run of known words is cut into pieces; a piece begins a window earlier.
        n = -(-(b - a) // PIECE)
        own = np.repeat(a, n) + PIECE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        begin, end = np.maximum(own - lead, np.repeat(a, n)), np.minimum(own + PIECE, np.repeat(b, n))
        state, places, states = np.zeros(len(own), np.int64), [], []
        live, at = np.arange(len(own)), begin.copy()
        while len(live):
            state[live] = self.step(state[live], ids[at[live]])
            ended = self.ends[state[live]].astype(np.int64)
            hit = np.flatnonzero((ended > 0) & (at[live] >= own[live]))
            here, now = at[live][hit], ended[hit]
            while len(now):
                places.append(here)
                states.append(now)
                shorter = self.ends[self.fail[now]].astype(np.int64)
                here, now = here[shorter > 0], shorter[shorter > 0]
            at[live] += 1
            live = live[at[live] < end[live]]
        return (np.concatenate(places), np.concatenate(states)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def scan(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Which words are hit, one text after another, where each text begins,
        and the items found in each."""
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        none = itertools.repeat(-1)
        ids = np.full(int(first[-1]), -1, np.int64)
        for t, a in zip(texts, first.tolist(), strict=False):
            ids[a : a + len(t)] = np.fromiter(map(self.vocabulary.get, t, none), np.int64, len(t))
        last, state = self.matches(ids)
        depth = np.searchsorted(self.depth_from, state, side="right") - 1
        hit = np.zeros(len(ids), bool)
        for size in np.unique(depth).tolist():
            hit |= spread(np.sort(last[depth == size] - size + 1), size, len(ids))
        items: list[list[str]] = [[] for _ in texts]
        text = np.searchsorted(first, last, side="right") - 1
        met = np.unique(text << 32 | np.searchsorted(self.windows, state))
        per: dict[int, set[int]] = {}
        for pair in met.tolist():
            w = pair & 0xFFFFFFFF
            per.setdefault(pair >> 32, set()).update(self.owners[self.first[w] : self.first[w + 1]].tolist())
        for k, found in per.items():
            items[k] = [self.names[i] for i in sorted(found)]
        return hit, first, items


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets, in the original text, of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    found = [m.span() for m in _WORD.finditer(text)] if len(edges) else []
    return [{"start": found[a][0], "end": found[b - 1][1]} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BUILT: dict[tuple, Automaton | None] = {}


def _built(shipped, width: int) -> Automaton | None:
    """The automaton of a broadcast slice, made once in a worker; the one before it goes."""
    key = (shipped.value[0], width)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton.of([(name, words(text)) for name, text in shipped.value[1]], width)
    return _BUILT[key]


def _scans(batches, shipped, width: int):
    """(batch, texts, hits of each text, items of each text)."""
    for batch in batches:
        texts = blobs(batch, "text")
        split = [words(t) for t in texts]
        automaton = _built(shipped, width)
        if automaton is None:
            yield batch, texts, [np.zeros(len(s), bool) for s in split], [[] for _ in split]
            continue
        hit, first, items = automaton.scan(split)
        yield batch, texts, [hit[a : a + len(s)] for a, s in zip(first.tolist(), split, strict=False)], items


def _scanned(batches, shipped, width: int):
    for batch, texts, hits, items in _scans(batches, shipped, width):
        spans = [original_spans(t.decode(), h) if h.any() else [] for t, h in zip(texts, hits, strict=True)]
        new = [pa.array([len(h) for h in hits], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n_words", "n_hit", "items", "spans"])


def _found(batches, shipped, width: int):
    """Of rows with anything found: their number, a bit a word, and the items."""
    for batch, _, hits, items in _scans(batches, shipped, width):
        at = [k for k, h in enumerate(hits) if h.any()]
        rows = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([np.packbits(hits[k]).tobytes() for k in at], pa.binary()), pa.array([items[k] for k in at], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(rows, ["__row", "__bits", "__items"])


def _merged(batches):
    """Rows with what the slices found: bits are united, items too."""
    for batch in batches:
        texts, col = blobs(batch, "text"), lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: E731, B023
        rows = []
        for text, bits, items in zip(texts, col("__bits"), col("__items"), strict=True):
            n = len(words(text))
            hit = np.zeros(n, bool)
            for blob in bits or ():
                hit |= np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)
            rows.append((n, int(hit.sum()), sorted({i for own in items or () for i in own}), original_spans(text.decode(), hit) if hit.any() else []))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kept = [(batch.column(k), n) for k, n in enumerate(batch.schema.names) if n not in ("__bits", "__items")]
        new = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS), strict=True)]
        yield pa.RecordBatch.from_arrays([*[c for c, _ in kept], *new], [*[n for _, n in kept], "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = HIT_SHARE, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """`docs` (with text and any other columns) with n_words, n_hit, items (array
    of item ids), spans (character offsets of hit passages) and contaminated.

    Null and empty texts have no words and are clean; an empty benchmark, or an
    item without words, hits nothing; items of one id, and those whose id is null
    under the id "", count as one item.  Columns of these names are replaced."""
    docs, named_own = plain(docs, ("n_words", "n_hit", "items", "spans", "contaminated"))
    own = docs.columns
    more = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    context = docs.sparkSession.sparkContext
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // limit))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")

    def shipped(part: DataFrame):
        items = sorted((r["item"], (r["text"] or "").encode()) for r in part.collect())
        return context.broadcast((uuid.uuid4().hex, items))

    if parts == 1:
        slice_ = shipped(rows)
        out = map_batches(docs.select(*own), lambda b: _scanned(b, slice_, width), fields(docs, own, more))
    else:
        # Items are dealt by their text too, so one id may hold any share of them.
        rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))))
        numbered = materialise(docs.select(*own, F.monotonically_increasing_id().alias("__row")))
        found = []
        for part in range(parts):
            slice_ = shipped(rows.filter(F.col("part") == part))
            found.append(materialise(map_batches(numbered.select("__row", "text"), lambda b, s=slice_: _found(b, s, width), "__row long, __bits binary, __items array<string>")))
            slice_.unpersist()
        discard(rows)
        every = found[0]
        for next_ in found[1:]:
            every = every.unionByName(next_)
        every = materialise(every.groupBy("__row").agg(F.collect_list("__bits").alias("__bits"), F.collect_list("__items").alias("__items")))
        discard(*found)
        joined = numbered.join(small_side(every, every.count(), 10_000), "__row", "left").drop("__row")
        out = map_batches(joined.select(*own, "__bits", "__items"), _merged, fields(docs, own, more))
    verdict = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return named(out.withColumn("contaminated", verdict), named_own)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    listed = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")
