"""Syntax tree to plan.

A leaf compiles to its hits.  A boolean of any depth compiles to one pass: each leaf marks its documents with a bit, one shuffle by document ORs the
bits, and the whole expression, negations included, is evaluated over them.  All term and prefix leaves share a single scan of the entries.

Where a conjunction has a term that the dictionary says is in few documents, the other leaves' marks are semi-joined with those documents before the shuffle; a term that
is nowhere makes the result empty.

Scores: the document frequency is the number of hits of the whole query.  What a boolean of several clauses, or with a negation, finds scores alike for all hits; one
clause alone keeps its own scores.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.scoring import Scoring, bm25, tfidf
from inkwell.operators import leaf
from inkwell.plans.ast import Bool, Fuzzy, Phrase, Prefix, Query, Regex, Term
from inkwell.plans.lexer import QueryError
from inkwell.sources.index import Snapshot

LEAVES = {Term: leaf.term, Phrase: leaf.phrase, Prefix: leaf.prefix, Regex: leaf.regex, Fuzzy: leaf.fuzzy}

RESULT = "doc_id string, score double"
#: A term in at most so many documents restricts the other clauses of a conjunction; their ids are broadcast.
RARE = 100_000


def check(snapshot: Snapshot, q: Query) -> None:
    """Errors come before anything runs, wherever in the query they are."""
    if isinstance(q, Regex):
        leaf.valid_regex(snapshot, q.pattern)
    if isinstance(q, Bool):
        q = q.hoisted()
        if q.must_not and not q.must and not q.should:
            raise QueryError("a negation needs something to take from")
        for c in (*q.must, *q.should, *q.must_not):
            check(snapshot, c)


def lone(q: Query) -> Query:
    """A boolean with one positive clause and nothing else is that clause."""
    while isinstance(q, Bool):
        q = q.hoisted()
        if q.must_not or len(q.must) + len(q.should) != 1:
            return q
        q = (*q.must, *q.should)[0]
    return q


class Marks:
    """The leaves of a boolean, each with a bit of the marks column."""

    def __init__(self) -> None:
        self.leaves: list[Query] = []

    def bit(self, q: Query) -> Column:
        if q not in self.leaves:
            self.leaves.append(q)
        k = self.leaves.index(q)
        return F.getbit(F.col(f"m{k // 63}"), F.lit(k % 63)) == 1

    def condition(self, q: Query, ignorable: list[Column]) -> Column:
        q = lone(q)
        if not isinstance(q, Bool):
            return self.bit(q)
        must, should, without = ([self.condition(c, ignorable) for c in own] for own in (q.must, q.should, q.must_not))
        out = F.lit(bool(q.must or q.should))
        for c in must:
            out = out & c
        if should:
            some = reduce(Column.__or__, should)
            if must:  # beside must, should counts only if anything matches it at all
                ignorable.append(some)
                some = some | ~F.col(f"any{len(ignorable) - 1}")
            out = out & some
        for c in without:
            out = out & ~c
        return out

    def marked(self, snapshot: Snapshot, within: DataFrame | None = None) -> DataFrame:
        """(doc_id, m0, m1, ...): a row for each document, of ``within`` if that is given, that a leaf matches."""
        words = -(-len(self.leaves) // 63)
        cheap: list[tuple[int, Column]] = []
        parts: list[DataFrame] = []

        def masks(bits: Callable[[int], Column]) -> list[Column]:
            return [bits(w).alias(f"m{w}") for w in range(words)]

        for k, q in enumerate(self.leaves):
            if isinstance(q, Term | Prefix) and q.field != leaf.ID:
                hit = F.col("term") == q.term if isinstance(q, Term) else F.col("term").startswith(q.prefix)
                cheap.append((k, hit & (F.col("field") == q.field) if q.field else hit))
            else:
                found = LEAVES[type(q)](snapshot, q)
                parts.append(found.select("doc_id", *masks(lambda w, k=k: F.lit(1 << k % 63 if w == k // 63 else 0).cast("bigint"))))
        if cheap:
            own = snapshot.entries.where(reduce(Column.__or__, (c for _, c in cheap)))

            def bits(w: int) -> Column:
                return reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << k % 63)).otherwise(F.lit(0)).cast("bigint") for k, c in cheap if k // 63 == w), F.lit(0).cast("bigint"))

            parts.append(own.select("doc_id", *masks(bits)))
        if within is not None:
            parts = [p.join(F.broadcast(within), "doc_id", "left_semi") for p in parts]
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(*(F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)))


def documents(snapshot: Snapshot, q: Query) -> DataFrame:
    """(doc_id) of what the query finds."""
    marks, ignorable = Marks(), []
    condition = marks.condition(q, ignorable)
    rare = None
    if not ignorable and len(marks.leaves) > 1:  # what is ignored depends on all documents
        rare = rarest(snapshot, q)
    if rare and not rare[1]:
        return snapshot.spark.createDataFrame([], "doc_id string")
    found = marks.marked(snapshot, leaf.term(snapshot, rare[0]).select("doc_id") if rare and rare[1] <= RARE else None)
    for k, some in enumerate(ignorable):  # inner ones come first, and may be used by outer ones
        found = found.crossJoin(F.broadcast(found.agg(F.coalesce(F.max(some), F.lit(False)).alias(f"any{k}"))))
    return found.where(condition).select("doc_id")


def rarest(snapshot: Snapshot, q: Bool) -> tuple[Term, int] | None:
    """The term of ``q``'s conjunction that is in the fewest documents, by a look into the dictionary, and in how many at most."""
    own = [t for t in map(lone, q.must) if isinstance(t, Term) and t.field != leaf.ID]
    if not own:
        return None
    which = [(F.col("term") == t.term) & (F.col("field") == t.field if t.field else F.lit(True)) for t in own]
    counts = snapshot.terms.where(reduce(Column.__or__, which)).agg(*(F.coalesce(F.sum(F.when(w, F.col("docs"))), F.lit(0)) for w in which)).first()
    k = min(range(len(own)), key=lambda i: counts[i])
    return own[k], counts[k]


def scored(snapshot: Snapshot, hits: DataFrame, scoring: Scoring) -> DataFrame:
    total, averages = snapshot.statistics()
    total_column = F.lit(float(total))
    # the count asks for all columns, which are never null, so that both sides have the same exchange and it is made once
    there = F.col("field").isNotNull() & F.col("tf").isNotNull() & F.col("field_len").isNotNull()
    with_count = hits.crossJoin(F.broadcast(hits.agg(F.count(F.when(there, 1)).cast("double").alias("hits"))))
    if scoring is Scoring.TFIDF:
        return with_count.select("doc_id", tfidf(F.col("tf").cast("double"), total_column, F.col("hits")).alias("score"))
    average = F.lit(1.0)
    for name, value in averages.items():
        average = F.when(F.col("field") == name, F.lit(value)).otherwise(average)
    return with_count.select("doc_id", bm25(F.col("tf").cast("double"), F.col("field_len"), average, total_column, F.col("hits")).alias("score"))


def compile(snapshot: Snapshot, query: Query | None, scoring: Scoring | None = None) -> DataFrame:
    """(doc_id, score) of every hit, without an order; nothing for no query."""
    scoring = scoring or snapshot.config.scoring
    if query is None:
        return snapshot.spark.createDataFrame([], RESULT)
    check(snapshot, query)
    query = lone(query)
    if isinstance(query, Bool):
        if not (query.must or query.should):
            return snapshot.spark.createDataFrame([], RESULT)
        hits = documents(snapshot, query).select("doc_id", F.lit("").alias("field"), F.lit(1).cast("bigint").alias("tf"), F.lit(0).cast("bigint").alias("field_len"))
    else:
        hits = LEAVES[type(query)](snapshot, query)
    return scored(snapshot, hits, scoring)
