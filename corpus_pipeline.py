"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing and
sharding, each stage over all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Models are fitted on the labelled rows
of the documents table in sf_dir, whatever an earlier stage removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.llm import mixing, toxicity
from fluxpanel.llm.decontaminate import contamination
from fluxpanel.llm.neardup import near_duplicates
from fluxpanel.llm.runtime import discard, materialise, packed, small_side, table, unpacked
from fluxpanel.llm.shards import jump_shards


#: Words of a shingle and percentage of shingles shared of the near-duplicate stage.
#: It is no query of its own with a rule of its own, so the common rule holds.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is below one half.

    Null and empty texts have the score of a text without hits, and stay where
    that is below one half; repeated rows are judged alike; an empty table stays
    empty; further columns, of whatever name, stay as they are."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.allowed_rows())
    scored = toxicity.score_toxicity(packed(docs, "text"), model)
    return unpacked(scored.filter("score < 0.5"), docs.columns)


def _identity(docs: DataFrame) -> Column:
    """What makes a row a document here: its doc_id (null last) and its text."""
    kind = docs.schema["doc_id"].dataType
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest
    doc_id (null last; of several texts under it, one of them).

    Rows of one doc_id with different texts are different documents: they stay
    unless their texts are near copies.  Rows that repeat doc_id and text are one
    document and stay once.  Texts without words are linked with nothing: they
    stay, also under a null doc_id.  Further columns stay as they are."""
    keyed = docs.select(_identity(docs).alias("doc_id"), "text")
    judged = materialise(near_duplicates(keyed, SHINGLE, PERCENT).select("doc_id", "kept", "n_shingles"))
    dropped = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    n = dropped.count()
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.select("*", _identity(docs).alias("key")).toDF(*names, "key")
    out = own.join(small_side(dropped, n), "key", "left_anti")
    many = judged.filter("kept and not (doc_id.none and n_shingles = 0)").groupBy(F.col("doc_id").alias("key")).count().filter("count > 1").select("key")
    n = many.count()
    if n:
        # First of each key within a task, then of all: no key gathers its rows.
        once = out.join(small_side(many, n), "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in names])
        out = out.join(small_side(many, n), "key", "left_anti").select(*names).union(once.select(*names))
    return out.select(*names).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the benchmark does not contaminate.

    Null and empty texts are clean; repeated rows are judged alike; an empty table
    stays empty; further columns, of whatever name, stay as they are."""
    judged = contamination(packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(judged.filter(~F.col("contaminated")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its rate asks for, which may be never.

    Rows of one doc_id round their rates alike; documents without words have the
    rate of their posteriors; an empty table stays empty; further columns, of
    whatever name, stay as they are."""
    model = mixing.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    fitted = mixing.mix_rows(packed(docs, "doc_id", "text"), model)
    return unpacked(fitted.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, slot and grown_shard, and replaces columns of these names.

    A null doc_id counts as 0; rows that share a doc_id share its shard and have
    slots of their own; texts do not matter; an empty table stays empty."""
    return jump_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the models and the automata; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        was, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(was)
    return STAGES[-1][1](spark, docs, sf_dir)
