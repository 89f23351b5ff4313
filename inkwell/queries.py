"""The engine's registered queries over the given tables, and SQL over the raw text that states their results.

Each table is indexed once for a session and data folder; the index lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions import analysis
from inkwell.functions.distance import within
from inkwell.functions.scoring import Scoring
from inkwell.operators import docset, leaf
from inkwell.plans.ast import Bool, Fuzzy, Phrase, Prefix, Query, Regex, Term
from inkwell.sources import documents
from inkwell.sources.index import Snapshot, inverted, long_form
from inkwell.sources.shared import scratch, until_exit

#: Table: its key columns and searchable columns.
TABLES = {
    "documents": (["doc_id"], ["text", "lang", "source"]),
    "pages": (["page_id"], ["url", "html"]),
    "part": (["p_partkey"], ["p_name", "p_brand", "p_type"]),
    "conversations": (["conv_id", "turn"], ["role", "text"]),
}

BM, TI = Scoring.BM25, Scoring.TFIDF

T, P, X, R, Z = Term, Phrase, Prefix, Regex, Fuzzy


def every(*clauses: Query, but: tuple[Query, ...] = ()) -> Bool:
    return Bool(must=clauses, must_not=but)


def some(*clauses: Query) -> Bool:
    return Bool(should=clauses)


#: Name: table, query (text or tree), scoring, and, written by hand, what a text means: the SQL is made from that.
SEARCHES: dict[str, tuple[str, str | Query, Scoring, Query | None]] = {
    "term": ("documents", "the", BM, T("the")),
    "term_rare": ("documents", "license", BM, T("license")),
    "term_tfidf": ("documents", "und", TI, T("und")),
    "term_case_sensitive": ("documents", "The", BM, T("The")),
    "term_by_id": ("documents", "_id:7", BM, T("7", "_id")),
    "term_unknown_field": ("documents", "nofield:the", BM, T("the", "nofield")),
    "field": ("documents", "lang:en", BM, T("en", "lang")),
    "field_text": ("documents", "text:la", BM, T("la", "text")),
    "field_first_of_many": ("pages", "example", BM, T("example")),
    "field_part": ("part", "p_type:promo", BM, T("promo", "p_type")),
    "phrase": ("documents", '"of the"', BM, P("of the")),
    "phrase_field": ("documents", 'text:"in the"', TI, P("in the", "text")),
    "phrase_repeated": ("documents", '"the the"', BM, P("the the")),
    "phrase_analyzed": ("documents", '"Licensed UNDER the"', BM, P("licensed under the")),
    "phrase_single": ("documents", '"THE!"', BM, T("the")),
    "prefix": ("documents", "th*", BM, X("th")),
    "prefix_field": ("documents", "source:src1*", BM, X("src1", "source")),
    "prefix_tfidf": ("documents", "licen*", TI, X("licen")),
    "prefix_all": ("conversations", "*", BM, X("")),
    "regex": ("documents", "/th[ae].*/", BM, R("th[ae].*")),
    "regex_field": ("documents", "text:/(un|on)d?/", BM, R("(un|on)d?", "text")),
    "regex_one_term": ("documents", "/licens[e]/", BM, R("licens[e]")),
    "regex_search": ("documents", R("^licen", mode="search"), BM, R("^licen", mode="search")),
    "fuzzy": ("documents", "license~1", BM, Z("license", 1)),
    "fuzzy_two": ("documents", "licence~2", TI, Z("licence", 2)),
    "fuzzy_zero": ("documents", "the~0", BM, Z("the", 0)),
    "fuzzy_field": ("documents", "text:tihn~1", BM, Z("tihn", 1, "text")),
    "and": ("documents", "the AND of", BM, every(T("the"), T("of"))),
    "and_implicit": ("documents", "license the", TI, every(T("license"), T("the"))),
    "or": ("documents", "und OR license", BM, some(T("und"), T("license"))),
    "not": ("documents", "the NOT license", BM, every(T("the"), but=(T("license"),))),
    "not_dash": ("documents", "la -que", TI, every(T("la"), but=(T("que"),))),
    "or_not": ("documents", Bool(should=(T("the"), T("der")), must_not=(T("license"),)), BM, Bool(should=(T("the"), T("der")), must_not=(T("license"),))),
    "must_should": ("documents", Bool(must=(T("the"),), should=(T("license"), T("licensed"))), BM, Bool(must=(T("the"),), should=(T("license"), T("licensed")))),
    "must_should_ignored": ("documents", Bool(must=(T("the"),), should=(T("nosuchterm"),), must_not=(T("license"),)), BM, every(T("the"), but=(T("license"),))),
    "nested": ("documents", "(the OR la) AND (license OR que) NOT der", BM, every(some(T("the"), T("la")), some(T("license"), T("que")), but=(T("der"),))),
    "mixed": ("documents", 'lang:en AND ("of the" OR licen*) -source:src3', BM, every(T("en", "lang"), some(P("of the"), X("licen")), but=(T("src3", "source"),))),
    "mixed_conversations": ("conversations", "role:user AND (/th.*/ OR tihn~1)", TI, every(T("user", "role"), some(R("th.*"), Z("tihn", 1)))),
    "mixed_pages": ("pages", 'html:"doctype html" AND url:https', BM, every(P("doctype html", "html"), T("https", "url"))),
    "mixed_part": ("part", "p_brand:brand NOT p_type:promo", BM, every(T("brand", "p_brand"), but=(T("promo", "p_type"),))),
    "empty": ("documents", "", BM, None),
    "and_rare": ("documents", "the AND license AND und", BM, every(T("the"), T("license"), T("und"))),
    "and_nowhere": ("documents", "the AND nosuchterm", BM, every(T("the"), T("nosuchterm"))),
    "precedence": ("documents", "der OR license AND the", BM, some(T("der"), every(T("license"), T("the")))),
}

#: The same over an index of pages in three unmerged segments, with deletes and replaced versions.
LIVE: dict[str, tuple[str, Scoring, Query]] = {
    "term": ("html:the", BM, T("the", "html")),
    "term_anywhere": ("en", BM, T("en")),
    "term_tfidf": ("html:und", TI, T("und", "html")),
    "phrase": ('html:"of the"', BM, P("of the", "html")),
    "prefix": ("html:th*", BM, X("th", "html")),
    "regex": ("html:/th(e|at|is)/", BM, R("th(e|at|is)", "html")),
    "fuzzy": ("html:teh~1", BM, Z("teh", 1, "html")),
    "and": ("html:the AND url:www", TI, every(T("the", "html"), T("www", "url"))),
    "not": ("url:https NOT html:the", BM, every(T("https", "url"), but=(T("the", "html"),))),
}

_engines: dict[tuple, tuple[Engine, Snapshot]] = {}


def opened(spark: SparkSession, sf_dir: str, table: str) -> tuple[Engine, Snapshot]:
    """The table's index and a snapshot of it; built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _engines:
        engine = Engine(spark, scratch(spark, f"index-{table}"))
        keys, fields = TABLES[table]
        engine.index_all(documents.from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), keys, fields))
        until_exit(spark, engine.store.path)
        _engines[key] = engine, engine.store.snapshot()
    return _engines[key]


def search(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, query, scoring, _ = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, snapshot = opened(spark, sf_dir, table)
        found = engine.search(query, scoring, snapshot) if isinstance(query, str) else engine.run(query, scoring, snapshot)
        return found.withColumn("score", F.round("score", 6))

    return run


#: Ids of pages that are deleted from the live index.
DELETED = ("7", "8", "30", "31")


def living(spark: SparkSession, sf_dir: str) -> Engine:
    """Pages in three segments: ids that leave 0 or 1 when divided by 3, those that leave 1 or 2, those that 5 divides; later versions replace earlier ones, and some are deleted.  Nothing is merged."""
    key = (spark.sparkContext.applicationId, sf_dir, "living")
    if key not in _engines:
        engine = Engine(spark, scratch(spark, "living"))
        docs = documents.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), *TABLES["pages"])
        number = F.col("doc_id").cast("bigint")
        for own in (number % 3 < 2, number % 3 > 0, number % 5 == 0):
            engine.index_all(docs.where(own))
        engine.delete(*DELETED, "nobody")
        engine.flush()
        until_exit(spark, engine.store.path)
        _engines[key] = engine, engine.store.snapshot()
    return _engines[key][0]


def live_search(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, scoring, _ = LIVE[name]
    return lambda spark, sf_dir: living(spark, sf_dir).search(query, scoring).withColumn("score", F.round("score", 6))


#: Documents that wait in the index of ``waiting``: the first replaces a page, the second is new.
WAITING = {"33": {"url": "http://the.example", "html": "The the, THE page of the 33"}, "fresh": {"html": "<p>the</p>", "size": 4}}


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the live index with two documents and a delete that wait, in an engine of its own."""
    engine = Engine(spark, living(spark, sf_dir).store.path)
    for doc_id, doc in WAITING.items():
        engine.index(doc_id, doc)
    engine.delete("36")
    return engine.search("html:the").withColumn("score", F.round("score", 6))


# SQL over the raw text


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WORDS_SQL = "[x for x in string_split_regex(lower(replace(replace(body, 'İ', 'i'), 'Σ', 'σ')), '[^\\p{L}\\p{N}]+') if x <> '']"


def base_sql(table: str) -> str:
    keys, fields = TABLES[table]
    key = " || '-' || ".join(f"{k}::varchar" for k in keys)
    parts = " UNION ALL ".join(f"SELECT {key} AS doc_id, {quoted(f)} AS field, {f}::varchar AS body FROM {table} WHERE {f} IS NOT NULL" for f in fields)
    return f"""
alldocs AS (SELECT {key} AS doc_id FROM {table}),
l AS (SELECT doc_id, field, {WORDS_SQL} AS w FROM ({parts})),
t AS (SELECT doc_id, field, unnest(w) AS term, len(w) AS n FROM l),
total AS (SELECT count(*)::double AS big_n FROM alldocs),
avgs AS (SELECT field, floor(sum(len(w))::double / count(*) * (SELECT count(*) FROM alldocs)) / (SELECT count(*) FROM alldocs) AS average FROM l WHERE len(w) > 0 GROUP BY field)"""


def live_sql(waiting: bool = False) -> str:
    """As ``base_sql``, of the live index: each segment's averages are over all that it was written with, and weigh as many documents as live in it."""
    base = base_sql("pages")
    l_all = base[base.index("l AS (") : base.index("t AS (")]
    gone = ", ".join(map(quoted, (*DELETED, *(("33", "36") if waiting else ()))))
    fresh = extra = ""
    if waiting:
        rows = ", ".join(f"({quoted(i)}, {quoted(f)}, {quoted(v)})" for i, d in WAITING.items() for f, v in d.items() if isinstance(v, str))
        fresh = f", (SELECT doc_id, field, {WORDS_SQL} AS w, 4 AS segment FROM (VALUES {rows}) v(doc_id, field, body))".replace(", (", " UNION ALL (", 1)
        extra = f" UNION ALL SELECT unnest([{', '.join(map(quoted, WAITING))}]), 4"
    return f"""
{l_all.replace("l AS (", "every_l AS (", 1)}
home AS (SELECT page_id::varchar AS doc_id, CASE WHEN page_id % 5 = 0 THEN 3 WHEN page_id % 3 > 0 THEN 2 ELSE 1 END AS segment FROM pages WHERE page_id::varchar NOT IN ({gone}){extra}),
wrote AS (SELECT every_l.*, segment FROM (SELECT *, doc_id::bigint AS k FROM every_l) every_l CROSS JOIN (VALUES (1), (2), (3)) v(segment) WHERE (segment = 1 AND k % 3 < 2) OR (segment = 2 AND k % 3 > 0) OR (segment = 3 AND k % 5 = 0)),
written AS (SELECT doc_id, field, w, segment FROM wrote{fresh}),
alldocs AS (SELECT doc_id FROM home),
l AS (SELECT doc_id, field, w FROM written JOIN home USING (doc_id, segment)),
t AS (SELECT doc_id, field, unnest(w) AS term, len(w) AS n FROM l),
total AS (SELECT count(*)::double AS big_n FROM alldocs),
lives AS (SELECT segment, count(*) AS live FROM home GROUP BY segment),
own AS (SELECT segment, field, sum(len(w))::double / count(*) AS average FROM written WHERE len(w) > 0 GROUP BY segment, field),
avgs AS (SELECT field, sum(floor(average * live)) / sum(live) AS average FROM own JOIN lives USING (segment) GROUP BY field)"""


#: For distances in characters from a plain word: any other letter is one sign that the word lacks.
PLAIN_SQL = "regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g')"


def hits_sql(q: Query) -> str:
    """(doc_id, field, tf, n) of a leaf."""
    if getattr(q, "field", "") == leaf.ID:
        return f"SELECT doc_id, '' AS field, 1 AS tf, 0 AS n FROM alldocs WHERE doc_id = {quoted(q.term)}"  # type: ignore[attr-defined]
    own = f" AND field = {quoted(q.field)}" if q.field else ""  # type: ignore[attr-defined]
    first = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY field) = 1"
    if isinstance(q, Phrase):
        return f"SELECT doc_id, field, 1 AS tf, len(w) AS n FROM l WHERE contains(' ' || array_to_string(w, ' ') || ' ', {quoted(' ' + q.phrase + ' ')}){own} {first}"
    if isinstance(q, Term | Prefix):
        match = f"term = {quoted(q.term)}" if isinstance(q, Term) else f"starts_with(term, {quoted(q.prefix)})"
        return f"SELECT doc_id, field, count(*) AS tf, any_value(n) AS n FROM t WHERE {match}{own} GROUP BY doc_id, field {first}"
    if isinstance(q, Regex):
        match = f"regexp_full_match(term, {quoted(q.pattern)})" if q.mode == "full" else f"regexp_matches(term, {quoted(q.pattern)})"
    else:
        assert isinstance(q, Fuzzy)
        match = f"damerau_levenshtein({PLAIN_SQL}, {quoted(q.term)}) <= {q.fuzziness}"
    one = f"(SELECT count(DISTINCT term) FROM t WHERE {match}{own}) = 1"
    keep = one if not q.field else "true"  # type: ignore[attr-defined]
    return f"SELECT doc_id, CASE WHEN {keep} THEN field ELSE '' END AS field, CASE WHEN {one} THEN count(*) ELSE 1 END AS tf, CASE WHEN {keep} THEN any_value(n) ELSE 0 END AS n FROM t WHERE {match}{own} GROUP BY doc_id, t.field {first.replace('ORDER BY field', 'ORDER BY t.field')}"


def condition_sql(q: Query) -> str:
    if not isinstance(q, Bool):
        return f"doc_id IN (SELECT doc_id FROM ({hits_sql(q)}))"
    parts = [condition_sql(c) for c in q.must]
    if q.should:
        some = "(" + " OR ".join(condition_sql(c) for c in q.should) + ")"
        parts.append(f"({some} OR NOT EXISTS (SELECT 1 FROM alldocs WHERE {some}))" if q.must else some)
    return "(" + " AND ".join(parts + [f"NOT {condition_sql(c)}" for c in q.must_not]) + ")"


def search_sql(name: str) -> str:
    table, _, scoring, tree = SEARCHES[name]
    return ranked_sql(base_sql(table), tree, scoring)


def ranked_sql(base: str, tree: Query | None, scoring: Scoring) -> str:
    if tree is None:
        return "SELECT ''::varchar AS doc_id, 0::double AS score WHERE false"
    hits = f"SELECT doc_id, '' AS field, 1 AS tf, 0 AS n FROM alldocs WHERE {condition_sql(tree)}" if isinstance(tree, Bool) else hits_sql(tree)
    h, a = "(SELECT count(*) FROM h)", "coalesce(average, 1)"
    if scoring is TI:
        score = f"(1 + ln(tf)) * (ln((big_n + 1) / ({h} + 1)) + 1)"
    else:
        score = f"ln(1 + (big_n - {h} + 0.5::double) / ({h} + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * CASE WHEN n > 0 THEN n ELSE {a} END / {a}))"
    return f"WITH {base}, h AS MATERIALIZED ({hits}) SELECT doc_id, round(({score})::double, 6) AS score FROM h CROSS JOIN total LEFT JOIN avgs USING (field)"


# other operators


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = analysis.tokens(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(words).alias("pos", "token")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("pos").alias("positions"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"), *TABLES["conversations"])
    return inverted(long_form(docs, analysis.tokens)).select("field", "term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "field_len")


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, snapshot = opened(spark, sf_dir, "documents")
    return snapshot.lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("field_len").alias("tokens"), F.max("field_len").alias("longest"))


def set_operation(which: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, snapshot = opened(spark, sf_dir, "documents")
        a, b = (leaf.term(snapshot, Term(w)).select("doc_id") for w in ("the", "license"))
        return {"intersect": docset.intersect, "union": docset.union, "subtract": docset.subtract}[which](a, b)

    return run


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every distinct term, in characters."""
    _, snapshot = opened(spark, sf_dir, "documents")
    terms = snapshot.terms.where("field = 'text'").select("term").distinct()
    return terms.select("term", F.levenshtein("term", F.lit("thing")).alias("edits"), within(F.col("term"), "thing", 1).alias("within_one"), within(F.col("term"), "thing", 2).alias("within_two"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "\n", "\n\n")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(analysis.summary(text)).alias("bytes"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, an upsert across them, deletes, a merge: what a search then finds."""
    engine = Engine(spark, scratch(spark, "lifecycle"))
    docs = documents.from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), *TABLES["part"])
    number = F.col("doc_id").cast("bigint")
    engine.index_all(docs.where(number % 3 < 2))
    engine.index_all(docs.where(number % 3 > 0))  # those with 1 replace themselves
    engine.delete("7", "8", "nobody")
    engine.flush()
    engine.merge_all()
    return engine.search("p_type:promo").withColumn("score", F.round("score", 6))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, snapshot = opened(spark, sf_dir, "part")
    return snapshot.docs.select("doc_id", F.get_json_object("stored", "$.p_size").cast("bigint").alias("p_size"), F.get_json_object("stored", "$.p_brand").alias("p_brand"))


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = opened(spark, sf_dir, "documents")
    return engine.dump_entries("text", "license").select("doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = opened(spark, sf_dir, "documents")
    return engine.segments().select("num_docs", "num_deleted")


def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return living(spark, sf_dir).segments().select("num_docs", "num_deleted")


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every segment, in the order in which they were written."""
    engine = living(spark, sf_dir)
    parts = [engine.dump_deletions(name).select(F.lit(k).alias("segment"), "doc_id") for k, name in enumerate(sorted(engine.store.manifest.segments), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def live_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as persisted, of deleted versions too."""
    return living(spark, sf_dir).dump_entries("html", "the").groupBy("doc_id").agg(F.count("*").alias("versions"), F.sum("tf").alias("tf"))


def live_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, average = living(spark, sf_dir).store.snapshot().statistics()
    return spark.createDataFrame([(f, total, a) for f, a in average.items()], "field string, documents bigint, average double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f"search_{name}": search(name) for name in SEARCHES} | {f"live_{name}": live_search(name) for name in LIVE} | {"live_waiting": waiting}
    own |= {"index_live_segments": live_segments, "index_dump_deletions": deletions, "index_live_dump_entries": live_dump, "index_live_averages": live_averages}
    own |= {f"docset_{w}": set_operation(w) for w in ("intersect", "union", "subtract")}
    return own | {"analyze": analyze, "index_entries": entries, "index_statistics": corpus_statistics, "index_lifecycle": lifecycle, "index_stored": stored, "index_dump_entries": dump, "index_segments": segments, "edit_distance": edits, "summary": summaries}


def oracle_sql() -> dict[str, str]:
    docs, conv, part = base_sql("documents"), base_sql("conversations"), base_sql("part")
    some = {w: f"SELECT doc_id FROM t WHERE term = '{w}'" for w in ("the", "license")}
    live = "SELECT p_partkey::varchar AS doc_id, p_type FROM part WHERE p_partkey NOT IN (7, 8)"
    words = "[x for x in string_split_regex(lower(p_type), '[^\\p{L}\\p{N}]+') if x <> '']"
    live_ids = ", ".join(map(quoted, DELETED))
    return {f"search_{name}": search_sql(name) for name in SEARCHES} | {f"live_{name}": ranked_sql(live_sql(), tree, scoring) for name, (_, scoring, tree) in LIVE.items()} | {
        "live_waiting": ranked_sql(live_sql(waiting=True), T("the", "html"), BM),
        "index_live_segments": f"""WITH p AS (SELECT page_id AS k, page_id::varchar IN ({live_ids}) AS gone FROM pages)
SELECT count(*) AS num_docs, count_if(gone OR k % 3 = 1 OR k % 5 = 0) AS num_deleted FROM p WHERE k % 3 < 2
UNION ALL SELECT count(*), count_if(gone OR k % 5 = 0) FROM p WHERE k % 3 > 0
UNION ALL SELECT count(*), count_if(gone) FROM p WHERE k % 5 = 0""",
        "index_dump_deletions": f"""WITH p AS (SELECT page_id AS k, page_id::varchar AS doc_id, page_id::varchar IN ({live_ids}) AS gone FROM pages)
SELECT 1 AS segment, doc_id FROM p WHERE k % 3 < 2 AND (gone OR k % 3 = 1 OR k % 5 = 0)
UNION ALL SELECT 2, doc_id FROM p WHERE k % 3 > 0 AND (gone OR k % 5 = 0)
UNION ALL SELECT 3, doc_id FROM p WHERE k % 5 = 0 AND gone""",
        "index_live_dump_entries": f"WITH {live_sql()} SELECT doc_id, count(*) AS versions, sum(len([x for x in w if x = 'the']))::bigint AS tf FROM written WHERE field = 'html' AND list_contains(w, 'the') GROUP BY doc_id",
        "index_live_averages": f"WITH {live_sql()} SELECT field, (SELECT big_n FROM total)::bigint AS documents, average::double AS average FROM avgs",
        "docset_intersect": f"WITH {docs} SELECT DISTINCT doc_id FROM ({some['the']}) WHERE doc_id IN ({some['license']})",
        "docset_union": f"WITH {docs} {some['the']} UNION {some['license']}",
        "docset_subtract": f"WITH {docs} SELECT DISTINCT doc_id FROM ({some['the']}) WHERE doc_id NOT IN ({some['license']})",
        "analyze": f"WITH {docs}, p AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM l WHERE field = 'text') SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(pos)::bigint AS positions FROM p GROUP BY token",
        "index_entries": f"WITH {conv}, p AS (SELECT doc_id, field, len(w) AS field_len, unnest(w) AS term, unnest(range(len(w))) AS pos FROM l) SELECT field, term, doc_id, count(*) AS tf, string_agg(pos::varchar, ',' ORDER BY pos) AS positions, any_value(field_len)::bigint AS field_len FROM p GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY field, term, doc_id"),
        "index_statistics": f"WITH {docs} SELECT field, count(*) AS docs, sum(len(w))::bigint AS tokens, max(len(w))::bigint AS longest FROM l GROUP BY field",
        "index_lifecycle": f"""WITH live AS ({live}), l AS (SELECT doc_id, {words} AS w FROM live), h AS (SELECT doc_id, len([x for x in w if x = 'promo']) AS tf, len(w) AS n FROM l WHERE list_contains(w, 'promo')),
s AS (SELECT (SELECT count(*) FROM live)::double AS big_n, (SELECT count(*) FROM h)::double AS h, (SELECT floor(sum(len(w))::double / count(*) * (SELECT count(*) FROM live)) / (SELECT count(*) FROM live) FROM l WHERE len(w) > 0) AS a)
SELECT doc_id, round(ln(1 + (big_n - s.h + 0.5::double) / (s.h + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * n / a)), 6) AS score FROM h CROSS JOIN s""",
        "index_stored": "SELECT p_partkey::varchar AS doc_id, p_size::bigint AS p_size, p_brand FROM part",
        "index_dump_entries": f"WITH {docs}, p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM l WHERE field = 'text') SELECT doc_id, count(*) AS tf, string_agg(pos::varchar, ',' ORDER BY pos) AS positions FROM p WHERE term = 'license' GROUP BY doc_id",
        "index_segments": "SELECT count(*) AS num_docs, 0::bigint AS num_deleted FROM documents",
        "edit_distance": f"WITH {docs}, v AS (SELECT DISTINCT term FROM t WHERE field = 'text') SELECT term, levenshtein({PLAIN_SQL}, 'thing')::int AS edits, damerau_levenshtein({PLAIN_SQL}, 'thing') <= 1 AS within_one, damerau_levenshtein({PLAIN_SQL}, 'thing') <= 2 AS within_two FROM v",
        "summary": """WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS x FROM documents),
e AS (SELECT doc_id, x, strlen(split_part(x, chr(10) || chr(10), 1)) AS brk, contains(x, chr(10) || chr(10)) AS broken FROM d),
c AS (SELECT doc_id, unnest(string_split(x, '')) AS ch, unnest(range(1, length(x) + 1)) AS i FROM e WHERE NOT (broken AND brk BETWEEN 1 AND 999) AND strlen(x) > 500),
r AS (SELECT doc_id, ch, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS so_far FROM c),
h AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS head FROM r WHERE so_far <= 500 GROUP BY doc_id),
s AS (SELECT doc_id, head, regexp_extract(head, '(?s)^(.+) [^ ]*$', 1) AS spaced FROM h)
SELECT doc_id, CASE WHEN broken AND brk BETWEEN 1 AND 999 THEN strlen(trim(split_part(x, chr(10) || chr(10), 1))) WHEN strlen(x) > 500 THEN strlen(trim(CASE WHEN spaced <> '' THEN spaced ELSE head END)) + 3 END::int AS bytes
FROM e LEFT JOIN s USING (doc_id)""",
    }
