"""From raw documents to token ids: five stages, each reading all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, language, ngram_join, tiling, toxicity
from inkwell.sources.shared import remove, scratch, until_exit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents none of whose clauses is rejected (``toxicity.clean``); insulting words are learnt from the labels.

    Null, empty and very long texts, ties, repeated rows, an empty table and further columns: as there; without labels the listed words alone count.
    """
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ``language.clean`` doesn't reject, by trees that are trained on them.

    Null, empty and very long texts, ties, repeated rows, an empty table and further columns: as there.
    """
    return language.clean(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (``ngram_join.one_of_each``).

    Null, empty and very long texts, ties, repeated rows, an empty table and further columns: as there.
    """
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (``tiling.clean``).

    Null, empty and very long texts, ties, repeated rows, empty tables and further columns: as there.
    """
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (``bpe.encode``): one row for each row, of other columns.

    Null, empty and very long texts, repeated rows, an empty table and further columns: as there.
    """
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_foreign),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the table of documents; each stage's result is written and read again, and goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        until_exit(spark, path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Learned stages and iterative matching have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
