"""Ranking formulas as column expressions."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


class Scoring(Enum):
    BM25 = "bm25"
    TFIDF = "tfidf"


def bm25(tf: Column, length: Column, average: Column, total: Column, hits: Column) -> Column:
    """Okapi BM25; ``hits``, the size of the whole result, is the document frequency.  Length 0 stands for an average one."""
    average = F.when(average > 0, average).otherwise(F.lit(1.0))
    length = F.when(length > 0, length.cast("double")).otherwise(average)
    idf = F.log(F.lit(1.0) + (total - hits + F.lit(0.5)) / (hits + F.lit(0.5)))
    return idf * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def tfidf(tf: Column, total: Column, hits: Column) -> Column:
    """(1 + ln tf) * (1 + ln((N + 1) / (hits + 1))); no length in it."""
    return F.when(tf > 0, F.lit(1.0) + F.log(tf)).otherwise(F.lit(0.0)) * (F.log((total + F.lit(1.0)) / (hits + F.lit(1.0))) + F.lit(1.0))
