"""Set algebra over (doc_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def intersect(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (s.select("doc_id") for s in sets)).distinct()


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def is_empty(a: DataFrame) -> bool:
    return a.isEmpty()


def count(a: DataFrame) -> int:
    return a.select("doc_id").distinct().count()


def from_results(results: DataFrame) -> DataFrame:
    return results.select("doc_id").distinct()
