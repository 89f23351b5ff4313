"""The queries of this subpackage, each over its whole tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, language, licenses, ngram_join, quality, suffix_tree, tiling, token_counts, toxicity, url_filter
from inkwell.sources.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_all(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache each time: every distinct text is a miss."""
    return token_counts.count(table(spark, sf_dir, "documents"), scratch(spark, "token-counts"))


def token_counts_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass over the cache that a first one has filled: every text is a hit."""
    docs, cache = table(spark, sf_dir, "documents"), scratch(spark, "token-counts")
    token_counts.count(docs, cache)
    return token_counts.count(docs, cache)


def token_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digests(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_toxicity,
        op3_bpe_encoding,
        op4_lm_scoring,
        op5_benchmark_decontamination,
        op6_url_filters,
        op7_language_id,
        op8_token_counts,
        op9_ngram_jaccard_join,
        op10_license_scans,
        token_counts_again,
        token_digests,
    )
}

ORACLE: dict[str, str] = {"op1_quality_rules": quality.sql(), "op6_url_filters": url_filter.sql(), "token_digests": token_counts.digests_sql(), "op9_ngram_jaccard_join": ngram_join.sql(), "op10_license_scans": licenses.sql()}
