import hashlib
import random
import re

import pytest

from fluxpanel.llm import decontaminate, licences
from fluxpanel.llm.licence_texts import PHRASES, TEMPLATES
from fluxpanel.llm.textkit import ALNUM_LOWER

from .conftest import invented

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    rng = random.Random(8)
    items = [(f"i{k}", invented(rng, 30)) for k in range(8)]
    items += [("a", "a b c"), ("b", "A, B; C!"), ("none", None), ("blank", "!?"), ("long", next(t for t in texts if t and len(t.split()) > 60))]
    return items


def brute(texts, items, width=13):
    wins = {}
    for name, t in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + width]), set()).add(name)
    out = {}
    for i, t in enumerate(texts):
        w, hit, names = WORD.findall(lowered(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def digest(docs, bench):
    return {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination_digest(docs, bench).collect()}


def test_decontamination(spark, docs, texts, benchmark):
    bench = spark.createDataFrame(benchmark, "item_id string, text string")
    expected = brute(texts, benchmark)
    assert digest(docs, bench) == expected and any(v[4] for v in expected.values())


def test_slices_and_spans(spark, docs, texts, benchmark):
    bench = spark.createDataFrame(benchmark, "item_id string, text string")
    whole = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    parts = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, limit=300).collect()}
    assert whole == parts
    for k, r in whole.items():
        hit = sum(len(WORD.findall(lowered(texts[k][s["start"] : s["end"]]))) for s in r["spans"])
        assert hit == r["n_hit"]


def test_automaton_matches_windows():
    """Against a set of windows, with items of every length and pieces of texts that cut through them."""
    rng = random.Random(12)
    vocabulary = [f"w{k}".encode() for k in range(6)]
    items = [(f"i{k}", [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 3, 5, 9, 14)))]) for k in range(12)]
    items = [(n, w) for n, w in items if len(w) != 1] + [("twice", items[-1][1])]
    wins = {}
    for name, w in items:
        for k in range(max(1, len(w) - 3)) if w else ():
            wins.setdefault(tuple(w[k : k + 4]), set()).add(name)
    built = decontaminate.Automaton.of(items, 4)
    texts = [[rng.choice([*vocabulary, b"other"]) for _ in range(rng.choice((0, 1, 7, 64, 65, 300)))] for _ in range(40)]
    hit, first, found = built.scan(texts)
    for k, t in enumerate(texts):
        marks, names = [False] * len(t), set()
        for n in {len(w) for w in wins}:
            for a in range(len(t) - n + 1):
                if tuple(t[a : a + n]) in wins:
                    marks[a : a + n] = [True] * n
                    names |= wins[tuple(t[a : a + n])]
        assert hit[first[k] : first[k] + len(t)].tolist() == marks and found[k] == sorted(names)
    assert decontaminate.Automaton.of([("none", [])], 4) is None


def test_memory_of_the_automaton():
    """Distinct words only: the most states that a text can make."""
    items = [(str(k), [b"%d" % (300 * k + j) for j in range(300)]) for k in range(400)]
    built = decontaminate.Automaton.of(items, 13)
    size = sum(v.nbytes for v in (built.keys, built.fail, built.ends, built.windows, built.first, built.owners))
    assert size < 40 * sum(len(w) + 1 for _, found in items for w in found)


def test_null_item_ids_and_long_texts(spark):
    item = " ".join(f"q{k}" for k in range(20))
    bench = spark.createDataFrame([(None, item), (None, "other words"), ("x", None)], "item_id string, text string")
    long = "plain " * 900_000 + item + " plain" * 5
    rows = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame([(1, long), (2, "OTHER, words!")], "doc_id long, text string"), bench).collect()}
    assert rows[1]["n_hit"] == 20 and not rows[1]["contaminated"] and rows[1]["items"] == [""]
    assert [long[s["start"] : s["end"]] for s in rows[1]["spans"]] == [item]
    assert rows[2]["contaminated"] and rows[2]["n_words"] == 2


def test_decontamination_of_nothing(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert not any(r[4] for r in digest(docs, bench).values())
    assert decontaminate.contamination(nothing, bench).count() == 0
    odd = docs.withColumnRenamed("lang", "spans").withColumnRenamed("source", "n_hit")
    assert decontaminate.contamination(odd, bench).count() == docs.count()


def test_licence_base(spark, docs, texts):
    got = {r["doc_id"]: r for r in licences.licence_digest(docs).collect()}
    for k, t in enumerate(texts):
        w = WORD.findall(lowered(t))
        found = [(a, label) for phrase, label in PHRASES.items() for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
        starts = [a for a, _ in found]
        row = (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert tuple(got[k])[1:6] == row
        assert set(row[4].split(",")) - {""} <= set(got[k]["labels"].split(","))
        assert 0 <= got[k]["score"] <= 1


def test_a_hot_phrase(spark):
    import time

    scanner = licences.Scanner.of(TEMPLATES, PHRASES)
    words = b" ".join([b"mit license"] * 800_000).split()
    began = time.perf_counter()
    starts, labels = scanner.base(words)
    assert (len(starts), starts[-1], labels) == (800_000, 1_599_998, {"mit"}) and scanner.spans(words) == []
    assert time.perf_counter() - began < 10
    row = licences.licence_digest(spark.createDataFrame([(1, "MIT License, " * 400_000)], "doc_id long, text string")).first()
    assert (row["n_base"], row["last_word"], row["score"]) == (400_000, 799_998, 0.5)


def test_templates_are_found(spark, nothing):
    rng = random.Random(2)
    rows = []
    for k, (_, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 30:  # a reworded copy
            words[11], words[23] = "changed", "words"
        rows.append((k, invented(rng, 50) + " " + " ".join(words) + " " + invented(rng, 50)))
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(TEMPLATES):
        assert label in got[k]["labels"] and got[k]["score"] >= 0.6
        assert all(45 <= s["first"] <= s["last"] for s in got[k]["spans"])
    clean = spark.createDataFrame([(1, "the software and the conditions of this notice, in all copies"), (2, invented(rng, 400))], "doc_id long, text string")
    assert all(not r["labels"] for r in licences.scan_licences(clean).collect())
    assert licences.scan_licences(nothing).count() == 0


def test_matching_statistics():
    sequences = [t.encode().translate(ALNUM_LOWER).split() for _, t in TEMPLATES]
    automaton = licences.SuffixAutomaton.of(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, min(len(s), i + 14) + 1)}
    rng = random.Random(4)
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 5)):
            s = rng.choice(sequences)
            a = rng.randrange(len(s))
            text += s[a : a + rng.randint(1, 6)] + [b"zz"] * (rng.random() < 0.3)
        best = [max((n for n in range(min(13, i + 1) + 1) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]
        if max(best) < 13:
            expected = [(i, b) for i, b in enumerate(best) if b >= 3 and (i + 1 == len(text) or best[i + 1] <= b)]
            found = automaton.runs(text, 3)
            assert [(i, n) for i, n, _ in found] == expected
            for i, n, state in found:
                assert automaton.ends[state] and all(sequences[k][e - n + 1 : e + 1] == text[i - n + 1 : i + 1] for k, e in automaton.ends[state])


def chained(found, size, gap, cover):
    """The same chains, one match at a time with every chain looked at: a match joins the
    chain that its words bring furthest (the oldest of equals), else begins one."""
    chains = []
    for start, words, at in sorted(found):
        fits = []
        for k, c in enumerate(chains):
            in_text, in_template = start + words - 1 - c[1], at + words - 1 - c[2]
            if in_text > 0 and in_template > 0 and start - c[1] <= gap and at - c[2] <= gap:
                gain = min(words, in_text, in_template)
                fits.append((-(c[3] + gain), k, gain))
        if fits:
            _, k, gain = min(fits)
            chains[k] = [chains[k][0], start + words - 1, at + words - 1, chains[k][3] + gain]
        else:
            chains.append([start, start + words - 1, at + words - 1, words])
    return [(a, b, min(1.0, total / size)) for a, b, _, total in chains if total >= cover * size]


def test_chains_against_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        size = rng.randint(5, 60)
        found = [(rng.randint(0, 90), rng.randint(1, 12), rng.randint(0, size - 1)) for _ in range(rng.randint(0, 14))]
        assert licences._chains(list(found), size) == chained(found, size, licences.MAX_GAP, licences.MIN_COVER)


def test_notices_are_told_apart(spark):
    texts = dict(enumerate(t for _, t in TEMPLATES))
    df = spark.createDataFrame([(k, "before it " + t + " after it") for k, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licences.scan_licences(df).select("doc_id", "labels").collect()}
    assert all(TEMPLATES[k][0] in labels for k, labels in got.items())
    by = {n: [labels for k, labels in got.items() if TEMPLATES[k][0] == n] for n in ("zlib", "boost", "cc0", "epl", "bsd-3-clause", "agpl")}
    assert by["zlib"] == [["zlib"]] and by["boost"] == [["boost"]] and by["cc0"] == [["cc0"]] and by["epl"] == [["epl"]] and by["bsd-3-clause"] == [["bsd-3-clause"]]
    assert "mit" not in by["agpl"][0]
