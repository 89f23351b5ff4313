"""The engine: an index and searches over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.scoring import Scoring
from inkwell.plans.ast import Query
from inkwell.plans.compiler import compile
from inkwell.plans.parser import parse
from inkwell.sources.index import Config, Index, Snapshot


class Engine:
    """Search over an index in ``path``.

    Each search sees what is indexed when it is asked.  Results are DataFrames (doc_id, score), the best first and ties by doc_id; they run when an action asks them to.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.store = Index(spark, path, config)

    def __getattr__(self, name: str):
        """Index operations: index, index_all, delete, flush, merge, merge_all, segments, segment_stats, load_doc, dump_entries, dump_deletions, close."""
        if name == "store":  # not there before __init__
            raise AttributeError(name)
        return getattr(self.store, name)

    def search(self, text: str, scoring: Scoring | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Runs a query string."""
        return self.run(parse(text), scoring, snapshot)

    def run(self, query: Query | None, scoring: Scoring | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Runs a syntax tree."""
        return compile(snapshot or self.store.snapshot(), query, scoring).orderBy(F.desc("score"), "doc_id")

    def top(self, text: str, k: int, scoring: Scoring | None = None) -> DataFrame:
        """Extension: the best ``k``, without sorting the rest."""
        return self.search(text, scoring).limit(k)
