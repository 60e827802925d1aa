"""Words and hashes of whole texts, vectorised over batches of documents.

A batch of documents becomes one byte buffer in which words are separated by
one space.  A word of up to seven bytes is its own number, longer ones are hashed by
XXH3.  A run of words is hashed by doubling: two halves of 2^k words (which overlap
where the width is no power of two) become one number by a product, an exclusive or
and a shift, which no linear relation passes.  So n-grams of any width cost a few
numpy operations a word for each doubling, there are no texts whose hashes collide by
their structure, and two given different runs collide with a chance of about 2^-64.
Memory is bounded by `CHUNK_WORDS` beside the words themselves, however long a document
is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from xxhash import xxh3_128_digest

#: Words hashed at a time, few enough to stay in a core's cache.
CHUNK_WORDS = 1 << 15

#: Bytes of a word that is its own number.
OWN_BYTES = 7

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_digests(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers of each word of a buffer."""
    sizes, out = ends - starts, np.empty((2, len(starts)), np.uint64)
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    # Eight bytes from any place on, of which those behind the word and the last go.
    lanes = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))[starts]
    masks = (np.uint64(1) << (np.uint64(8) * np.arange(OWN_BYTES + 1, dtype=np.uint64))) - np.uint64(1)
    own = lanes & masks[np.minimum(sizes, OWN_BYTES)] | sizes.astype(np.uint64) << np.uint64(56)
    out[0], out[1] = own, own
    long = np.flatnonzero(sizes > OWN_BYTES)
    if len(long):
        raw = buffer.tobytes()
        found = b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        out[:, long] = np.frombuffer(found, np.uint64).reshape(-1, 2).T
    return out


_LEFT, _WHOLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """The hash of two parts, in order, from their hashes."""
    x = left * _LEFT
    x ^= right
    x += np.uint64(salt & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= _WHOLE
    return x


@dataclass
class Words:
    """The words of a batch of documents: `buffer` holds them, each followed by
    one space; word i is buffer[starts[i]:ends[i]]; document d has the words
    first[d] to first[d + 1]."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `width` words within one document, and the
        index of each run's first word."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        owner = self.owner()
        at = np.flatnonzero(owner[:n] == owner[width - 1 :])
        return self.hashes(at, at + width - 1, seed), at

    @cached_property
    def digests(self) -> np.ndarray:
        return word_digests(self.buffer, self.starts, self.ends)

    def hashes(self, a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
        """Hashes of the runs from word a[i] to word b[i]; a ascends.  Odd seeds
        take one half of a word's 128 bits, even ones the other."""
        out = np.empty(len(a), np.uint64)
        for lo in range(0, len(a), CHUNK_WORDS):
            x, size = a[lo : lo + CHUNK_WORDS], b[lo : lo + CHUNK_WORDS] - a[lo : lo + CHUNK_WORDS] + 1
            least, most = int(size.min()), int(size.max())
            left, right, top = int(x[0]), int((x + size).max()), most.bit_length() - 1
            # level[i] is the hash of the 2^k words from i on.
            level = mix(self.digests[seed % 2, left:right] + np.uint64(_GOLDEN * seed & (1 << 64) - 1))
            x, part = x - left, out[lo : lo + CHUNK_WORDS]
            dense = len(x) == int(x[-1]) + 1
            for k in range(top + 1):
                if least == most and k == top:
                    n = len(x)
                    # Two halves, which overlap; of a power of two, the level itself.
                    whole = level if most == 1 << k else joined(level[: len(level) - most + (1 << k)], level[most - (1 << k) :], _GOLDEN * (k + 2))
                    part[:] = mix((whole[:n] if dense else whole[x]) + np.uint64(_GOLDEN * most & (1 << 64) - 1))
                elif least != most and len(own := np.flatnonzero(size >> k == 1)):
                    n = size[own]
                    halves = joined(level[x[own]], level[x[own] + n - (1 << k)], _GOLDEN * (k + 2))
                    part[own] = mix(np.where(n == 1 << k, level[x[own]], halves) + n.astype(np.uint64) * np.uint64(_GOLDEN))
                if k < top:
                    level = joined(level[: -(1 << k)], level[1 << k :], _GOLDEN * (k + 2))
        return out


def words_of(texts: list[bytes | None], table: bytes | None = None, lower: bool = False) -> Words:
    """Splits texts at ASCII white space (null: no words), after `bytes.translate(table)`
    or lower-casing A-Z where asked for."""
    parts, counts = [], np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts):
        if text:
            if table is not None:
                text = text.translate(table)
            elif lower:
                text = text.lower()
            found = text.split()
            if found:
                counts[k + 1] = len(found)
                parts.append(b" ".join(found))
    joined = b" ".join(parts) + b" " if parts else b""
    buffer = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return Words(buffer, starts, ends, np.cumsum(counts))


def spread(mask_starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks the `width` items from each start on, of n items."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, mask_starts, 1)
    np.subtract.at(steps, np.minimum(mask_starts + width, n), 1)
    return np.cumsum(steps[:-1]) > 0
