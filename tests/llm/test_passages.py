import hashlib

import pytest

from fluxpanel.llm import passages

from .test_textkit import thue_morse


def brute(texts, width=20):
    seen, out = set(), {}
    for k, t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            g = tuple(w[a : a + width])
            if g in seen:
                gone[a : a + width] = [True] * width
            seen.add(g)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [1, 4 << 20])
def test_against_brute_force(docs, texts, monkeypatch, size):
    monkeypatch.setattr(passages, "BLOCK_BYTES", size)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.passage_digest(docs).collect()}
    expected = brute(enumerate(texts))
    assert got == expected and sum(v[1] for v in expected.values()) > 1000


def test_joined_replies(docs, texts, monkeypatch):
    monkeypatch.setattr(passages, "REPLY_BYTES", 0)
    got = {r["doc_id"]: r["n_removed"] for r in passages.passage_digest(docs).collect()}
    assert got == {k: v[1] for k, v in brute(enumerate(texts)).items()}


def test_cover_brings_any_two_positions_together():
    for i in range(passages.PERIOD):
        for j in range(passages.PERIOD):
            assert any((i + s) % passages.PERIOD in passages.COVER and (j + s) % passages.PERIOD in passages.COVER for s in range(passages.PERIOD))
    assert passages.ANCHOR + passages.PERIOD - 1 == passages.WINDOW


def test_odd_rows(spark, nothing):
    assert passages.passage_digest(nothing).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3)], "doc_id long, text string, n_words long").coalesce(1)
    got = sorted(((r["doc_id"], r["n_removed"]) for r in passages.dedup_passages(df).collect()), key=str)
    assert got == sorted([(None, 0), (3, 30), (3, 30)], key=str)


def test_partitions():
    low, high = passages.PART_HASHES
    assert passages.partitions(0) == 1 and passages.partitions(43 * low) == 43
    assert passages.partitions(4 * low * passages.PARTS) == passages.PARTS
    assert passages.partitions(1 << 40) == (1 << 40) // high


def test_many_partitions(docs, texts, monkeypatch):
    monkeypatch.setattr(passages, "PART_HASHES", (64, 1 << 23))
    got = {r["doc_id"]: r["n_removed"] for r in passages.passage_digest(docs).collect()}
    assert got == {k: v[1] for k, v in brute(enumerate(texts)).items()}


def test_a_long_text_and_other_ids(spark):
    words = [f"w{k % 5000}x{k // 700}" for k in range(700_000)]
    long = " ".join(words)
    df = spark.createDataFrame([(1, long), (2, "start " + " ".join(words[300_000:300_060]) + " end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.dedup_passages(df).collect()}
    assert got[1][:2] == (700_000, 0) and got[2] == (62, 60, "start end")
    with pytest.raises(TypeError):
        passages.dedup_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_long_words_that_polynomials_confuse(spark):
    rest = " ".join(f"w{k}" for k in range(19))
    rows = []
    for n in (1024, 2048, 4096):
        rows += [f"{thue_morse(n, flip).decode()} {rest[:k]}" for k, flip in ((None, False), (None, True))]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.passage_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and not any(v[1] for v in got.values())
