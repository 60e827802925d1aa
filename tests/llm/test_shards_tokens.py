import zlib
from collections import Counter

import numpy as np
import pytest

from fluxpanel.llm import shards, tokens

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def jump_one(key: int, n: int) -> int:
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_loop():
    keys = np.array([0, 1, 2, 10**12, -1, -5, 2**63 - 1], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert shards.jump(keys.view(np.uint64), n).tolist() == [jump_one(int(k) % (1 << 64), n) for k in keys]


def test_digest(docs, texts):
    got = shards.shard_digest(docs).collect()
    assert len(got) == len(texts)
    slots = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == jump_one(r["doc_id"], 16)
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_keys_of_all_kinds(spark, docs, nothing):
    assert shards.jump_shards(nothing).count() == 0
    df = spark.createDataFrame([(None, "a"), ("k", "b"), ("k", "c")], "key string, shard string")
    got = shards.jump_shards(df, key="key", shards=4).collect()
    assert len({r["shard"] for r in got if r["key"]}) == 1 and len({(r["shard"], r["slot"]) for r in got}) == 3
    hot = spark.range(5000).selectExpr("7 as doc_id").repartition(9)
    placed = shards.jump_shards(hot).collect()
    assert sorted(r["slot"] for r in placed) == list(range(5000))
    again = shards.jump_shards(docs.withColumnRenamed("lang", "slot")).count()
    assert again == docs.count()


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def test_counts_match_the_library(docs, texts, path):
    library = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in tokens.token_digest(docs, path).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_random_strings_match_the_library(path):
    import random

    rng = random.Random(3)
    letters = list("aaabAB '’sStre'llve'd123½²éÉ́ÇßΣΑςİ一ก😀\n\r\x1c\x85 　<|>_-!#") + ["<|endoftext|>", "<|ENDOFTEXT|>", " the ", "aaaa", "hello"]
    found = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    merges, library = tokens.Merges.load(path), tokenizers.Tokenizer.from_file(path)
    expected = [len(e.ids) for e in library.encode_batch(found, add_special_tokens=False)]
    assert tokens.count_tokens(found, merges, {}) == expected


def test_every_code_point_matches_the_library(path):
    library = tokenizers.Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        text = " q ".join(f"a{chr(c)}b1{chr(c)}." for c in points[k : k + 50_000])
        norm = library.normalizer.normalize_str(text)
        assert tokens.pieces(text)[0] == [norm[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(norm)]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "é你ba"])
def test_long_words_match_the_library(path, letters):
    import random

    rng = random.Random(len(letters))
    merges, library = tokens.Merges.load(path), tokenizers.Tokenizer.from_file(path)
    for n in (tokens.LONG - 1, tokens.LONG + 1, 5000, 300_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert tokens.count_tokens([text], merges, known := {}) == [len(library.encode(text, add_special_tokens=False).ids)]
        assert not known


def test_a_million_letters(spark, path):
    import time

    merges = tokens.Merges.load(path)
    began = time.perf_counter()
    assert tokens.count_tokens(["abcab" * 200_000], merges, {})[0] > 1000
    assert time.perf_counter() - began < 10


def test_other_vocabularies_are_an_error(tmp_path, path):
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": held["model"] | {"end_of_word_suffix": None}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(held | change))
        with pytest.raises(ValueError, match="not a vocabulary"):
            tokens.Merges.load(str(other))


def test_odd_tables(spark, nothing, docs, path):
    assert tokens.with_token_counts(nothing, path).count() == 0
    clash = docs.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")
    out = tokens.with_token_counts(clash, path)
    assert dict(out.dtypes)["n_tokens"] == "bigint" and out.count() == docs.count()


def test_cache_is_bounded(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    merges, known = tokens.Merges.load(path), {}
    for text in ("one two three four five", "six seven", "one"):
        tokens.count_tokens([text], merges, known)
    assert set(known) == {"six", "seven", "one"}


def test_shares_are_even():
    count = Counter(shards.jump(np.arange(64000, dtype=np.uint64), 16).tolist())
    assert max(count.values()) < 1.1 * min(count.values())
