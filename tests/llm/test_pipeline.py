from pyspark.sql import functions as F

import corpus_pipeline as cp
from fluxpanel.llm import mixing, toxicity

from .test_neardup import brute as groups
from .test_scans import brute as contaminated

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bench = [(str(a), b) for a, b in bench]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        got = [r["doc_id"] for r in out.collect()]
        if name == "near_duplicates":
            assert sorted(got) == sorted(k for k, v in groups(rows, 5, 80).items() if v[2])
        elif name == "decontamination":
            flags = contaminated([rows[k] for k in sorted(rows)], bench)
            assert sorted(got) == sorted(k for k, i in zip(sorted(rows), range(len(rows)), strict=True) if not flags[i][4])
        elif name == "toxicity":
            model = toxicity.train(documents, labels, toxicity.allowed_rows())
            scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
            assert sorted(got) == sorted(k for k, v in scored.items() if v < 0.5) and len(got) < len(rows)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, mixing.train(documents, labels)).collect()}
            assert sorted(got) == sorted(k for k, n in copies.items() for _ in range(n)) and 0 in copies.values()
        elif name == "sharding":
            assert len(got) == docs.count()
            places = {(r["shard"], r["slot"]) for r in out.collect()}
            assert len(places) == len(got)
        assert set(got) <= set(rows)
        if name != "sharding":
            assert out.columns == docs.columns
        docs, rows = out, {k: rows[k] for k in set(got)}


def test_odd_documents(spark, docs, nothing):
    extra = docs.withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "score")
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0
        assert stage(spark, extra, FOLDER).count() > 0


def test_columns_of_any_name(spark, docs):
    """Names that the operators use themselves, and those of the stages' own columns."""
    odd = docs.withColumnRenamed("lang", "row").withColumnRenamed("source", "key").withColumnRenamed("n_chars", "copies")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns and out.schema == odd.schema, name
        kept = {r["doc_id"]: tuple(r) for r in odd.collect()}
        assert all(kept[r["doc_id"]] == tuple(r) for r in out.collect())


ODD_NAMES = ["a.b", "back`tick", "a blank", "__row", "__bits", "__items", "__task", "__key", "__n", "_0", "_1", "row", "key", "TEXT2", "c0"]


def test_names_with_dots_and_backticks(spark, docs):
    odd = docs.limit(40).select("*", *[F.lit(k) for k in range(len(ODD_NAMES))]).toDF(*docs.columns, *ODD_NAMES)
    kept = {r[0]: tuple(r) for r in odd.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, odd, FOLDER)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        got = [tuple(r)[: len(odd.columns)] for r in out.collect()]
        assert got and all(kept[r[0]] == r for r in got), name


def test_operators_keep_columns_of_any_name(spark, docs):
    import public_tokenizers

    from fluxpanel.llm import decontaminate, licences, quality_rules, shards, tokens

    odd = docs.limit(40).select("*", *[F.lit(k) for k in range(len(ODD_NAMES))]).toDF(*docs.columns, *ODD_NAMES)
    documents, labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    kept = {r[0]: tuple(r) for r in odd.collect()}
    for out in (
        quality_rules.apply_rules(odd, quality_rules.train(documents, labels)),
        tokens.with_token_counts(odd, public_tokenizers.path("word_bpe_49k.json")),
        shards.jump_shards(odd),
        decontaminate.contamination(odd, bench),
        decontaminate.contamination(odd, bench, limit=4000),
        toxicity.score_toxicity(odd, toxicity.train(documents, labels, toxicity.allowed_rows())),
        licences.scan_licences(odd),
        mixing.mix_rows(odd, mixing.train(documents, labels)),
    ):
        assert out.columns[: len(odd.columns)] == odd.columns
        assert {r[0]: tuple(r)[: len(odd.columns)] for r in out.collect()} == kept


def test_texts_of_one_id_are_judged_apart(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " more"), (None, a), (None, "c " * 9), (None, "c " * 9), (5, None), (5, None), (None, ""), (None, "")]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert sorted(map(str, out)) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (None, "c " * 9), (5, None), (None, ""), (None, "")], "doc_id long, text string").collect()))


def test_repeated_rows_stay_once(spark, docs):
    twice = docs.unionByName(docs)
    out = cp.drop_near_duplicates(spark, twice, FOLDER)
    assert out.count() == out.select("doc_id").distinct().count() == cp.drop_near_duplicates(spark, docs, FOLDER).count()


def test_run(spark):
    assert cp.run(spark, FOLDER).count() > 0
