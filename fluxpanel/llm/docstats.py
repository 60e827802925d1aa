"""Counts over whole texts, vectorised over a batch: what the quality rules
(operator 1) ask for, and the statistics of the quality classifier (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textkit import Words, mix, spread, words_of

#: Classes of bytes whose counts are statistics.
_CLASSES = {
    "space": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "symbol": b"#*$%&|<>",
    "stop": b".,;:?'\"",
    "bang": b"!",
    "other": bytes(c for c in range(128) if chr(c) in "()[]{}-_/\\+=@^`~" or c < 9 or 13 < c < 32 or c == 127),
    "lead": bytes(range(0xC0, 0x100)),
    "tail": bytes(range(0x80, 0xC0)),
}
_NAMES = list(_CLASSES)
_CLASS_OF = np.array([next(k for k, n in enumerate(_NAMES) if c in _CLASSES[n]) for c in range(256)], np.int64)

REPEAT_WINDOW = 5


@dataclass
class Stats:
    """Per document of a batch."""

    words: Words
    counts: dict[str, np.ndarray]
    n_words: np.ndarray
    word_chars: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _lines(text: bytes | None) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    found = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")] if text else []
    return len(found), len(found) - len(set(found))


def doc_stats(texts: list[bytes | None]) -> Stats:
    """Null counts as a text without characters."""
    words = words_of(texts)
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    raw = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)) * len(_NAMES), sizes)
    table = np.bincount(owner + _CLASS_OF[raw], minlength=len(texts) * len(_NAMES)).reshape(len(texts), len(_NAMES))
    counts = {n: table[:, k] for k, n in enumerate(_NAMES)}
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return Stats(
        words, counts, words.counts, sizes - counts["space"] - counts["newline"] - counts["tail"],
        lines[:, 0], lines[:, 1], repeated_words(words, REPEAT_WINDOW),
    )


def repeated_words(words: Words, width: int) -> np.ndarray:
    """Words that stand in a window of `width` words found twice or more in their document."""
    hashes, at = words.grams(width)
    keys = mix(hashes ^ mix(words.owner()[at].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(words.counts), np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    covered = spread(at[twice[place] == keys], width, len(words.starts))
    total = np.concatenate(([0], np.cumsum(covered)))
    return total[words.first[1:]] - total[words.first[:-1]]


def _per_doc(words: Words, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[words.first[1:]] - total[words.first[:-1]]


def statistics(stats: Stats) -> np.ndarray:
    """A row of statistics for each document: logarithms of sizes, and shares."""
    words, n = stats.words, np.maximum(stats.n_words, 1)
    chars = np.maximum(sum(v for k, v in stats.counts.items() if k != "tail"), 1)
    lengths = words.ends - words.starts
    mean = _per_doc(words, lengths) / n
    spread_ = np.sqrt(np.maximum(_per_doc(words, lengths.astype(float) ** 2) / n - mean**2, 0))
    last = words.buffer[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    first = words.buffer[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    upper = (first >= 65) & (first <= 90)
    capitals = upper & (last != 0) & (words.buffer[np.minimum(words.starts + 1, max(len(words.buffer) - 1, 0))] < 91 if len(words.starts) else False)
    hashes = words.hashes(np.arange(len(words.starts)), np.arange(len(words.starts))) if len(words.starts) else np.zeros(0, np.uint64)
    keys = hashes ^ mix(words.owner().astype(np.uint64) + np.uint64(1))
    distinct = np.zeros(len(stats.n_words))
    if len(keys):
        _, lead = np.unique(keys, return_index=True)
        distinct = np.bincount(words.owner()[lead], minlength=len(stats.n_words)).astype(float)
    columns = [
        np.log1p(stats.n_words), np.log1p(chars), np.log1p(stats.n_lines), mean, spread_,
        distinct / n, stats.n_dup_lines / np.maximum(stats.n_lines, 1), stats.n_repeat_words / n,
        _per_doc(words, np.isin(last, [46, 33, 63])) / n, _per_doc(words, last == 44) / n,
        _per_doc(words, upper) / n, _per_doc(words, capitals) / n, _per_doc(words, lengths == 1) / n,
        np.log1p(stats.n_words / np.maximum(stats.n_lines, 1)),
        *[stats.counts[k] / chars for k in ("space", "newline", "lower", "upper", "digit", "symbol", "stop", "bang", "other", "lead")],
        _per_doc(words, np.isin(last, [35, 36, 37, 38, 42, 124])) / n,
    ]
    return np.stack(columns, 1).astype(np.float64)
