"""The registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .decontaminate import contamination_digest
from .licences import licence_digest
from .mixing import mixing_digest
from .neardup import near_duplicates
from .passages import passage_digest
from .quality_kernel import quality_digest
from .quality_rules import rules_digest
from .runtime import table
from .shards import shard_digest
from .spelling import spelling_digest
from .tokens import token_digest
from .toxicity import toxicity_digest
from .urls import url_digest


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Vocabulary of the token counts, among the files of public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def op2_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_digest(table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digest(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_quality": op1_ngram_quality,
    "op2_bpe_tokens": op2_bpe_tokens,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_setsketch_neardup": op4_setsketch_neardup,
    "op5_jump_shards": op5_jump_shards,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_levenshtein_toxicity": op8_levenshtein_toxicity,
    "op9_kernel_quality": op9_kernel_quality,
    "op10_licence_spans": op10_licence_spans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_url_filters": op12_url_filters,
}

#: DuckDB forms, where SQL can express the operator's rows.  The others rest on
#: a checksum, a vocabulary, fitted models or an automaton, and are tested
#: against brute force, a library or held-out labels.
SQL: dict[str, str] = {
    "op4_setsketch_neardup": sql.NEAR_DUPLICATES,
    "op6_passage_dedup": sql.PASSAGES,
    "op7_decontaminate": sql.CONTAMINATION,
    "op12_url_filters": sql.URLS,
}
