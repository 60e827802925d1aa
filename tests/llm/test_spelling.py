import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxpanel.llm import spelling

from .test_scans import lowered

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    forms, out = {}, {}
    for a, n in words.items():
        others = sorted((-words[b], b) for b in words if near(a, b))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        forms[a] = form
        out[a] = [form, None, n, len(others), words[form] if form else None]
    for a in words:
        root = a
        while forms[root]:
            root = forms[root]
        out[a][1] = root
    return {a: tuple(v) for a, v in out.items()}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=7), max_size=40))
def test_self_join_of_a_trie(words):
    words = sorted(words)
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    i, j = spelling.self_join(spelling.levels(np.zeros(len(words), np.int64), codes, np.cumsum(sizes) - sizes, sizes))
    found = [tuple(sorted((words[a], words[b]))) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)}


def vocabulary(seed=3, n=300):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11)))
        out[w] = rng.choice([5, 30, 160, 900, 5000])
        for _ in range(rng.randint(0, 4)):
            k, c = rng.randrange(len(w)), rng.choice("abcdeé")
            w = rng.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :]])
            if len(w) >= 6:
                out[w] = rng.choice([5, 30, 160, 900, 5000])
    # One beginning, and one end, that a third of all words have.
    out |= {"abcabc" + "".join(t): rng.randint(5, 40) for t in itertools.product("abc", repeat=4)}
    out |= {"".join(t) + "cbacba": rng.randint(5, 40) for t in itertools.product("abc", repeat=4)}
    out |= {"aaaaaa" + "a" * k: 5**k for k in range(1, 6)}
    return out


@pytest.mark.parametrize("cell", [4096, 8])
def test_vocabulary_against_brute_force(spark, cell):
    words = vocabulary()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    expected = brute(words)
    assert rows_of(spelling.spelling_variants(df, cell=cell)) == expected
    assert any(v[0] and v[1] != v[0] for v in expected.values()) and len({v[0] for v in expected.values()}) > 20


def test_pairs_once(spark):
    words = vocabulary(5, 100)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for cell in (4096, 8):
        got = [(r["word"], r["other"]) for r in spelling.near_words(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_texts_against_brute_force(spark):
    rng = random.Random(11)
    base = ["Straße", "naïveté", "running", "runing", "runnings", "colours", "colors", "colour", "ÀÉÎÕÜß", "different", "diffrent", "×÷×÷×÷×", "short", "x" * 300]
    rows = [(k, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "-", "́"]) for _ in range(rng.randint(0, 400)))) for k in range(150)]
    rows += [(None, "running " * 500), (None, None), (7, ""), (7, "different " * 90), (7, "different " * 90)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, word string").repartition(4)
    words = counts(rows)
    assert {r["word"]: r["n"] for r in spelling.counted_words(df).collect()} == words
    assert rows_of(spelling.spelling_digest(df)) == brute(words) and len(words) > 12


def test_nothing(spark, nothing):
    assert spelling.spelling_digest(nothing).collect() == []
    assert spelling.spelling_digest(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = counts((r["doc_id"], r["text"]) for r in docs.collect())
    assert rows_of(spelling.spelling_digest(docs)) == brute(words) and words
