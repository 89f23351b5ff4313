"""Leaf operators: (doc_id, field, tf, field_len) of each hit, one row a document, from its alphabetically first field that matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import analysis
from inkwell.functions.distance import within
from inkwell.plans.ast import Fuzzy, Phrase, Prefix, Regex, Term
from inkwell.sources.index import Snapshot

ID = "_id"
#: Terms that an expansion may put into a filter.
FEW_TERMS = 1000


def in_field(entries: DataFrame, field: str) -> DataFrame:
    return entries.where(F.col("field") == field) if field else entries


def first_field(hits: DataFrame, field: str) -> DataFrame:
    """One row a document.  Within one field a document is there once already."""
    if field:
        return hits.select("doc_id", "field", "tf", "field_len")
    return hits.groupBy("doc_id").agg(F.min(F.struct("field", "tf", "field_len")).alias("m")).select("doc_id", "m.field", "m.tf", "m.field_len")


def by_id(snapshot: Snapshot, condition: Column) -> DataFrame:
    return snapshot.docs.where(condition).select("doc_id", F.lit(ID).alias("field"), F.lit(1).cast("bigint").alias("tf"), F.lit(0).cast("bigint").alias("field_len"))


def term(snapshot: Snapshot, q: Term) -> DataFrame:
    """Exact raw terms.  Ids are searched only as ``_id:``."""
    if q.field == ID:
        return by_id(snapshot, F.col("doc_id") == q.term)
    return first_field(in_field(snapshot.entries, q.field).where(F.col("term") == q.term), q.field)


def prefix(snapshot: Snapshot, q: Prefix) -> DataFrame:
    """Terms that begin so; tf is the sum over them.  The empty prefix matches whatever has a token."""
    if q.field == ID:
        return by_id(snapshot, F.col("doc_id").startswith(q.prefix))
    found = in_field(snapshot.entries, q.field).where(F.col("term").startswith(q.prefix))
    return first_field(found.groupBy("doc_id", "field").agg(F.sum("tf").alias("tf"), F.first("field_len").alias("field_len")), q.field)


def phrase(snapshot: Snapshot, q: Phrase) -> DataFrame:
    """The analyzed phrase's tokens side by side in one field; tf is 1 however often.  One token is a term; none match nothing."""
    words = phrase_tokens(snapshot, q.phrase)
    if len(words) < 2:
        return term(snapshot, Term(words[0], q.field)) if words else term(snapshot, Term("", q.field)).where("false")
    if q.field == ID:
        return by_id(snapshot, F.lit(False))
    kinds = list(dict.fromkeys(words))
    own = in_field(snapshot.entries, q.field).where(F.col("term").isin(kinds))
    # one scan and one shuffle for all words: their position lists side by side
    lists = own.groupBy("doc_id", "field").agg(F.first("field_len").alias("field_len"), F.count("*").alias("kinds"), *(F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(kinds)))
    there = F.col("kinds") == len(kinds)

    def follows(start: Column) -> Column:
        out = F.lit(True)
        for i, w in enumerate(words[1:], 1):
            out = out & F.array_contains(F.col(f"p{kinds.index(w)}"), start + F.lit(i))
        return out

    found = lists.where(there).where(F.exists("p0", follows)).select("doc_id", "field", F.lit(1).cast("bigint").alias("tf"), "field_len")
    return first_field(found, q.field)


def phrase_tokens(snapshot: Snapshot, text: str) -> list[str]:
    """A phrase through the index's own analyzer; the built-in one has a Python twin, another one is asked in a one-row job."""
    if snapshot.config.analyzer is analysis.tokens:
        return analysis.tokenize(text)
    return list(snapshot.spark.range(1).select(snapshot.config.analyzer(F.lit(text))).first()[0])


def expansion(snapshot: Snapshot, field: str, matches: Column) -> DataFrame:
    """Documents with a term of which ``matches`` holds.

    The condition runs over the dictionary, not the entries.  Up to FEW_TERMS matching terms become a pushed-down filter that prunes row groups of the sorted
    entries; more are joined.  If one of them is in live documents, tf and length count as for a term query; with several, tf is 1 and the length counts only
    within a given field.  How many there are is worked out within the plan.
    """
    if field == ID:
        return by_id(snapshot, F.expr("true")).withColumn("term", F.col("doc_id")).where(matches).drop("term")
    own = in_field(snapshot.entries, field)
    terms = in_field(snapshot.terms, field).select("term").distinct().where(matches)
    few = [r["term"] for r in terms.limit(FEW_TERMS + 1).collect()]
    hits = own.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else own.join(terms, "term", "left_semi")
    one = hits.agg((F.min("term") == F.max("term")).alias("one"))
    single = first_field(hits.crossJoin(F.broadcast(one)).withColumn("tf", F.when(F.col("one"), F.col("tf")).otherwise(F.lit(1))).withColumn("keep", F.col("one") | F.lit(bool(field))).withColumn("field_len", F.when(F.col("keep"), F.col("field_len")).otherwise(F.lit(0))).withColumn("field", F.when(F.col("keep"), F.col("field")).otherwise(F.lit(""))), "")
    return single


def valid_regex(snapshot: Snapshot, pattern: str) -> None:
    from inkwell.plans.lexer import QueryError

    try:
        snapshot.spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise QueryError(f"not a regular expression: {pattern}") from e


def regex(snapshot: Snapshot, q: Regex) -> DataFrame:
    """Terms that match as a whole, or anywhere in mode "search".  A literal beginning of the pattern is pushed to the scan."""
    matches = F.col("term").rlike(rf"\A(?:{q.pattern})\z" if q.mode == "full" else q.pattern)
    if q.mode == "full" and (start := literal_start(q.pattern)):
        matches = F.col("term").startswith(start) & matches
    return expansion(snapshot, q.field, matches)


def literal_start(pattern: str) -> str:
    """The letters and digits that every match begins with."""
    if "|" in pattern or "(?" in pattern:
        return ""
    out = ""
    for i, c in enumerate(pattern):
        if not (c.isalnum() and c.isascii()):
            return out[:-1] if c in "*?{" and out else out
        out += c
    return out


def fuzzy(snapshot: Snapshot, q: Fuzzy) -> DataFrame:
    """Terms within q.fuzziness edits, swaps of neighbours being one edit."""
    return expansion(snapshot, q.field, within(F.col("term"), q.term, q.fuzziness))
