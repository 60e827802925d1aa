"""Token counts (operator 2): rank-synchronous merging of ragged arrays.

Each distinct pre-token of a batch is a run of symbols in one flat array.  In
each round every run merges all occurrences of its own lowest-ranked pair at
once, until no run has a pair left; what survives is counted.  A merged symbol
only takes part in pairs of higher rank, so the rounds give what merging one
pair at a time gives.  In a run of more than LONG bytes a round looks only at the
places of its own rank, kept by rank, and at pairs beside a merge, so that the
work grows with the merges and not with rounds times length.

Pattern, normaliser and special strings are those of the vocabulary file; a file
with others than are built here is an error, not a wrong count.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blobs, fields, map_batches, named, plain

#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 2048

#: Distinct pre-tokens whose counts a worker keeps between batches.
CACHED = 300_000

#: Bytes from which a pre-token is long: it is merged by itself and not cached.
LONG = 1024

#: What a file's normaliser and pre-tokeniser must be.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}

#: Letters that are newer than Python's tables and that the library
#: lower-cases: first, last, distance.
_NEWER_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)


#: Letters and digits newer than the library's tables (Unicode 16), for
#: which they are symbols; those of the regex module may have them.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def _pieces_pattern() -> regex.Pattern:
    """The file's pattern with letters and digits as the library knows them."""
    but = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _NEWER) + "]"
    word, digit = rf"[\p{{L}}--{but}]", rf"[\p{{N}}--{but}]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{word}+|{digit}|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{but}--\p{{White_Space}}]]+")


_PIECES = _pieces_pattern()
_LOWER = {c: c + by for first, last, by in _NEWER_LOWER for c in range(first, last + 1) if unicodedata.category(chr(c)) == "Cn"}
_ANY_NEWER = regex.compile("[" + "".join(map(chr, _LOWER)) + "]") if _LOWER else None
_NONE = np.int32(np.iinfo(np.int32).max)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Merges:
    """The merge list as arrays: `inner` and `last` are the symbols of a byte
    within and at the end of a pre-token; a hash table of pairs gives rank and result."""

    inner: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    slots: np.ndarray
    spilled: np.ndarray
    special: tuple[str, ...] = ()

    BITS = 18

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        known = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        plain = all(not t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not known or not plain or held["normalizer"] != _NORMALIZER or held["pre_tokenizer"] != _PRE_TOKENIZER:
            raise ValueError(f"{path} is not a vocabulary of the kind that is counted here: lower-cased words, byte pairs, end-of-word suffix")
        special = tuple(t["content"] for t in held["added_tokens"])
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_symbols()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        keys, made, ranks = keys[order], made[order], order.astype(np.int32)
        home = cls._home(keys)
        slots = np.full(1 << cls.BITS, -1, np.int32)
        slots[home] = np.arange(len(keys), dtype=np.int32)
        spilled = np.zeros(1 << cls.BITS, bool)
        spilled[home[slots[home] != np.arange(len(keys))]] = True
        return cls(np.array([vocab[c] for c in chars], np.int32), np.array([vocab[c + suffix] for c in chars], np.int32), keys, ranks, made, slots, spilled, special)

    @classmethod
    def _home(cls, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair in the merge list sorted by key, or -1."""
        keys = left.astype(np.int64) << 20 | right
        home = self._home(keys)
        at = self.slots[home]
        at = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        other = np.flatnonzero(self.spilled[home] & (at < 0))
        if len(other):
            place = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            at[other] = np.where(self.keys[place] == keys[other], place, -1)
        return at

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty pre-token."""
        long = [k for k, p in enumerate(pieces) if len(p) > LONG]
        if not long:
            return self._short(pieces)
        out, apart = np.zeros(len(pieces), np.int64), set(long)
        rest = [k for k in range(len(pieces)) if k not in apart]
        if rest:
            out[rest] = self._short([pieces[k] for k in rest])
        out[long] = [self._long(pieces[k]) for k in long]
        return out

    def _long(self, piece: bytes) -> int:
        """Of one long run: the places of each rank are kept by rank, and a merge
        adds those of the two pairs beside it."""
        raw = np.frombuffer(piece, np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            found = self.find(symbols[at], symbols[after[at]])
            at, rank = at[found >= 0], self.ranks[found[found >= 0]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))] if len(rank) else (), strict=False):
                if int(r) not in places:
                    places[int(r)] = []
                    heapq.heappush(queue, int(r))
                places[int(r)].append(part)

        note(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            at = at[after[at] < n]
            found = self.find(symbols[at], symbols[after[at]])
            ok = found >= 0
            ok[ok] = self.ranks[found[ok]] == r
            at, found = at[ok], found[ok]
            if not len(at):
                continue
            # Of pairs that overlap, the first, third and so on.
            touch = np.concatenate(([False], at[1:] == after[at[:-1]]))
            if touch.any():
                turn = np.arange(len(at))
                keep = (turn - np.maximum.accumulate(np.where(touch, 0, turn))) % 2 == 0
                at, found = at[keep], found[keep]
            gone = after[at]
            symbols[at] = self.made[found]
            alive[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left = before[at]
            note(np.unique(np.concatenate((left[left >= 0], at[inside]))))
        return int(alive.sum())

    def _short(self, pieces: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = sizes.copy()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols) > 1:
            at = np.where(owner[1:] == owner[:-1], self.find(symbols[:-1], symbols[1:]), -1)
            rank = np.append(np.where(at >= 0, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            chosen = (rank == np.repeat(least, sizes)) & (rank != _NONE)
            chosen = _every_other(chosen)
            place = np.flatnonzero(chosen)
            if not len(place):
                break
            symbols[place] = self.made[at[place]]
            out -= np.bincount(owner[place], minlength=len(out))
            stay = np.repeat(least != _NONE, sizes)
            stay[place + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out


def _every_other(chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring places, which would overlap, the first, third and so on."""
    if not (chosen[1:] & chosen[:-1]).any():
        return chosen
    at = np.arange(len(chosen))
    began = chosen & ~np.concatenate(([False], chosen[:-1]))
    return chosen & ((at - np.maximum.accumulate(np.where(began, at, 0))) % 2 == 0)


def pieces(text: str, special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")) -> tuple[list[str], int]:
    """Pre-tokens of a text, and how many special tokens it spells out."""
    parts, count = [text], 0
    if any(s in text for s in special):
        # Where several begin at one place the longest is taken.
        parts = regex.split("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), text)
        count = len(parts) - 1
    found: list[str] = []
    for part in parts:
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        if _ANY_NEWER is not None and not part.isascii() and _ANY_NEWER.search(part):
            part = part.translate(_LOWER)
        found += _PIECES.findall(part.lower())
    return found, count


def count_tokens(texts: list[str], merges: Merges, known: dict[str, int]) -> list[int]:
    """Tokens of each text; `known` holds the counts of short pre-tokens seen so far."""
    if len(known) > CACHED:
        known.clear()
    split = [pieces(t, merges.special) for t in texts]
    new = sorted({p for found, _ in split for p in found if p not in known})
    if new:
        known.update(zip(new, merges.counts([p.encode() for p in new]).tolist(), strict=True))
    out = [sum(map(known.__getitem__, found)) + special for found, special in split]
    for p in new:
        if len(p) > LONG // 4:
            del known[p]
    return out


def _counted(batches, shipped):
    merges, known = shipped.value, {}
    for batch in batches:
        texts = [(t or b"").decode() for t in blobs(batch, "text")]
        tokens = count_tokens(texts, merges, known)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], [*batch.schema.names, "n_tokens"])


def with_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with n_tokens, the tokens of the whole text under the vocabulary at
    `path` (a byte-pair JSON file with an end-of-word suffix).

    Null and empty texts have none; an empty table stays empty.  A file of another
    kind is an error.  A column of that name is replaced."""
    docs, own = plain(docs, ("n_tokens",))
    shipped = docs.sparkSession.sparkContext.broadcast(Merges.load(path))
    return named(map_batches(docs, lambda b: _counted(b, shipped), fields(docs, docs.columns, "n_tokens long")), own)


def token_digest(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    counted = with_token_counts(docs.select("doc_id", "text"), path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
