import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import neardup
from fluxpanel.llm.components import components

from .conftest import corpus, invented, near
from .test_textkit import thue_morse


def brute(texts: dict[int, str | None], width=3, percent=85) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(docs, texts):
    assert rows(neardup.near_duplicates(docs)) == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("cell", [1 << 10, 1 << 23])
def test_a_chain_of_near_copies(spark, monkeypatch, cell):
    """Many copies with edits of their own: links need not pass through one centre."""
    import random

    rng = random.Random(5)
    base = invented(rng, 120)
    texts = {k: near(rng, base, rng.randint(0, 7)) for k in range(150)}
    monkeypatch.setattr(neardup, "CELL_BYTES", cell)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows(neardup.near_duplicates(df)) == brute(texts)


def test_odd_rows(spark, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    same = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(None, same, 1), (7, same, 2), (7, same, 3), (9, same, 4), (4, None, 5)], "doc_id long, text string, component_id long")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (4, 4, True)], key=str)


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows_ = [(5, a), (7, a), (7, b), (9, b), (11, c), (12, c), (12, None), (13, b), (13, b), (-3, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert found == sorted([(5, 28, 5, True), (7, 28, 5, False), (7, 28, 5, False), (9, 28, 5, False), (13, 28, 5, False), (13, 28, 5, False), (11, 28, -3, False), (12, 28, -3, False), (12, 0, 12, True), (-3, 28, -3, True)])
    named = spark.createDataFrame([("x1", a), ("w", a), (None, a), ("y", c)], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(named).collect()} == {"x1": "w", "w": "w", None: None, "y": "y"}


@pytest.mark.parametrize(("rounds", "size"), [(0, 64), (3, 256)])
def test_a_chain_of_five_thousand(spark, monkeypatch, rounds, size):
    """Each text is linked with a few before and after it only, so no centre reaches far; once by cells alone."""
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "CELL_ROWS", size)
    n, width = 5000, 80
    words = [f"w{k}" for k in range(n + width)]
    texts = {k: " ".join(words[k : k + width]) for k in range(n) if k % 1000 != 999}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    sets = width - 2
    # Texts k apart share 78 - k of 78 + k shingles: up to 6 apart they are linked, so the gaps of one text are bridged.
    assert 100 * (sets - 6) >= 85 * (sets + 6) > 100 * (sets - 7) - 85
    assert set(got.values()) == {0}


def test_bands():
    assert neardup.band_of(85) == 6 and neardup.band_of(80) == 5
    for percent in (50, 70, 80, 85, 95):
        b = neardup.band_of(percent)
        assert (1 - (percent / 100) ** b) ** (neardup.REGISTERS // b) <= neardup.MISSED


def test_five_words_at_eighty_percent(spark):
    texts = corpus(11, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(neardup.near_duplicates(df, 5, 80)) == brute(dict(enumerate(texts)), 5, 80)


def test_a_very_long_text(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 900_000)]
    long = " ".join(words)
    other = " ".join(words[:400_000] + ["x"] * 3 + words[400_003:])
    df = spark.createDataFrame([(1, long), (2, other), (3, "short text")], "doc_id long, text string")
    got = rows(neardup.near_duplicates(df))
    assert [got[k][1:] for k in (1, 2, 3)] == [(1, True), (1, False), (3, True)] and got[1][0] > 800_000


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        ra, rb = neardup.sketches([a, b])
        size = np.array([float(n)])
        got = neardup.estimate(size, size, *(np.array([float(v)]) for v in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())))
        assert abs(got[0] - share) < 0.12
        assert neardup.reachable(ra[None], rb[None], size, size, 85)[0] == (share >= 0.85)


def test_registers_merge():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(2))
    ra, rb, rc = neardup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rc).all()


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr("fluxpanel.llm.components.LOCAL_EDGES", limit)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 360)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(df.filter(F.lit(False))).count() == 0


def test_corpus_of_another_seed(spark):
    texts = corpus(9, 60)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert rows(neardup.near_duplicates(df)) == brute(dict(enumerate(texts)))


def test_long_words_that_polynomials_confuse(spark):
    texts = {}
    for n in (1024, 2048, 4096):
        for flip in (False, True):
            texts[len(texts)] = f"{thue_morse(n, flip).decode()} one"
    got = rows(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert got == brute(texts) and all(v[2] for v in got.values())


def test_pages_of_one_template_move_no_sets(spark, monkeypatch):
    """Pages that share buckets by their template and are not near: registers settle them."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(150)]
    texts = {k: " ".join(template + [word() for _ in range(50)]) for k in range(150)}
    texts[500] = texts[3] + " more"
    asked, cell = [], neardup._celled

    def counted(rows, held, *rest):
        asked.append((rows.select("node").distinct().count(), "shingles" in held.columns))
        return cell(rows, held, *rest)

    monkeypatch.setattr(neardup, "_celled", counted)
    monkeypatch.setattr(neardup, "REGISTER_ROWS", 64)
    assert rows(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))) == brute(texts)
    assert asked and not asked[0][1] and asked[0][0] > 50 and all(n <= 4 for n, sets in asked if sets)
