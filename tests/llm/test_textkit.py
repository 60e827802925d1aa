import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxpanel.llm import textkit
from fluxpanel.llm.docstats import doc_stats, statistics

WORD = re.compile("[^\x20\x09-\x0d]+")


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1c é🙂", max_size=40)), max_size=8))
def test_words_and_grams(texts):
    words = textkit.words_of([None if t is None else t.encode() for t in texts])
    split = [WORD.findall(t) if t else [] for t in texts]
    assert words.counts.tolist() == [len(w) for w in split]
    for width in (1, 3):
        hashes, at = words.grams(width)
        grams = [tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1)]
        assert len(grams) == len(hashes)
        assert len(set(grams)) == len(set(hashes.tolist()))
        seen = {}
        assert all(seen.setdefault(g, h) == h for g, h in zip(grams, hashes.tolist(), strict=True))


def test_chunks_agree(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(2000)).encode()
    whole = textkit.words_of([text, text]).grams(5)[0]
    monkeypatch.setattr(textkit, "CHUNK_WORDS", 77)
    parts = textkit.words_of([text, text]).grams(5)[0]
    assert (whole == parts).all() and (whole[:1996] == whole[1996:]).all()


def test_statistics_of_odd_texts():
    rows = statistics(doc_stats([None, b"", b" ", "é".encode(), b"a a a a a a\na\na"]))
    assert np.isfinite(rows).all()
    assert statistics(doc_stats([])).shape[0] == 0


def thue_morse(n: int, flip: bool = False) -> bytes:
    """Strings on which polynomials modulo 2^64 collide, whatever their base."""
    return bytes(97 + (bin(k).count("1") % 2 ^ flip) for k in range(n))


def test_no_structure_collides():
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n), thue_morse(n, True)
        for seed in (1, 11, 12, 13):
            first, second = (textkit.words_of([w + b" one two"]).grams(3, seed)[0] for w in (a, b))
            assert first[0] != second[0]
        # Words instead of letters, in runs of such lengths.
        texts = [b" ".join(w[k : k + 1] for k in range(n)) for w in (a, b)]
        x, y = (textkit.words_of([t]).grams(n)[0] for t in texts)
        assert x[0] != y[0]


def test_repeated_words_of_long_words():
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n).decode(), thue_morse(n, True).decode()
        stats = doc_stats([f"{a} q r s t z {b} q r s t".encode(), f"{a} q r s t z {a} q r s t".encode()])
        assert stats.n_repeat_words.tolist() == [0, 10]


def test_runs_of_any_width():
    words = textkit.words_of([b"a b c d e f g a b c d e f g"])
    for width in range(1, 8):
        hashes = words.hashes(np.arange(14 - width + 1), np.arange(14 - width + 1) + width - 1)
        assert len(set(hashes.tolist())) == 7
    a, b = np.array([0, 0, 1, 7, 7]), np.array([2, 6, 3, 9, 13])
    mixed = words.hashes(a, b)
    assert mixed[0] == mixed[3] and mixed[1] == mixed[4] and len(set(mixed.tolist())) == 3
    assert mixed[0] == words.hashes(a[:1], b[:1])[0]
