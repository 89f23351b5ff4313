import math

import pytest
from corpus import DOCS, QUERIES, Brute
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions.scoring import Scoring
from inkwell.operators import docset
from inkwell.plans.ast import Bool, Regex, Term
from inkwell.plans.lexer import QueryError
from inkwell.plans.parser import parse
from inkwell.sources import documents
from inkwell.sources.index import Config

BRUTE = Brute(DOCS)


def found(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    own = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}/one")
    own.index_all(documents.from_literals(spark, list(DOCS.items())))
    return own


@pytest.fixture(scope="module")
def snapshot(engine):
    snap = engine.snapshot()
    snap.entries = snap.entries.cache()
    return snap


@pytest.mark.parametrize("category", QUERIES)
def test_categories(engine, snapshot, category):
    for text, ids in QUERIES[category].items():
        got = found(engine.search(text, snapshot=snapshot))
        assert sorted(got) == ids.split(), text
        assert got == pytest.approx(BRUTE.search(parse(text)), abs=1e-9), text


def test_tfidf(engine, snapshot):
    for text in ["cold", "silk", "s*", '"the sea"', "cold OR salt", "/s[ai]l.*/", "tags:food"]:
        assert found(engine.search(text, Scoring.TFIDF, snapshot)) == pytest.approx(BRUTE.search(parse(text), tfidf=True), abs=1e-9), text


@pytest.mark.parametrize("text", ["-cold", "cold OR -bread", "NOT cold OR bread", "/(/", "nosuch AND /(/", "nosuch -(-cold)"])
def test_errors_come_first(engine, snapshot, text):
    with pytest.raises(QueryError):
        engine.search(text, snapshot=snapshot).collect()


def test_trees_beyond_the_grammar(engine, snapshot):
    c, b, n = Term("cold"), Term("bread"), Term("nosuch")
    for tree in (
        Bool(must=(c,), should=(b, n)),
        Bool(must=(c,), should=(n,)),
        Bool(must=(c,), should=(n,), must_not=(b,)),
        Bool(should=(c, b), must_not=(Term("home"),)),
        Bool(must=(c, Bool(must=(b,), should=(n,)))),
        Bool(must=(c,)),
        Bool(must=(Bool(should=(c,)),)),
        Regex("^sil", mode="search"),
    ):
        assert found(engine.run(tree, snapshot=snapshot)) == pytest.approx(BRUTE.search(tree), abs=1e-9), str(tree)
    assert found(engine.run(Bool(), snapshot=snapshot)) == {}


def test_many_leaves(engine, snapshot):
    text = " OR ".join(f"word{k}" for k in range(70)) + " OR cold"
    assert found(engine.search(text, snapshot=snapshot)) == pytest.approx(BRUTE.search(parse(text)), abs=1e-9)


def test_order_and_top(engine, snapshot):
    rows = [(r["score"], r["doc_id"]) for r in engine.search("cold OR salt", snapshot=snapshot).collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert engine.top("cold", 2).count() == 2


def test_scores_have_the_right_slope(spark, tmp_path):
    own = Engine(spark, f"file://{tmp_path}/slope")
    docs = {f"d{n}": {"body": "filler" + " key" * n + " pad" * (12 - n)} for n in range(1, 11)} | {"long": {"body": "key " + "pad " * 60}, "none": {"body": "pad"}}
    own.index_all(documents.from_literals(spark, list(docs.items())))
    score = found(own.search("key"))
    rising = [score[f"d{n}"] for n in range(1, 11)]
    assert rising == sorted(rising) and len(set(rising)) == 10
    steps = [b - a for a, b in zip(rising, rising[1:], strict=False)]
    assert steps == sorted(steps, reverse=True)  # saturation
    assert score["long"] < score["d1"]  # longer fields score less
    ratio = found(own.search("key", Scoring.TFIDF))
    assert ratio["d10"] / ratio["d1"] == pytest.approx(1 + math.log(10))


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "doc_id string") for t in ("abcc", "bcd"))
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(docset.intersect(a, b)) == ["b", "c"]
    assert ids(docset.union(a, b)) == ["a", "b", "c", "d"]
    assert ids(docset.subtract(a, b)) == ["a"]
    assert docset.count(a) == 3 and docset.is_empty(a.where("false")) and not docset.is_empty(a)
    assert ids(docset.from_results(a.withColumn("score", F.lit(1.0)))) == ["a", "b", "c"]


def test_pushdown(spark, tmp_path, capsys):
    own = Engine(spark, f"file://{tmp_path}/push")
    own.index_all(documents.from_literals(spark, list(DOCS.items())))
    own.search("riv*").explain("formatted")
    assert "StringStartsWith(term,riv)" in capsys.readouterr().out


def test_many_terms_are_joined(engine, snapshot, monkeypatch):
    from inkwell.operators import leaf

    monkeypatch.setattr(leaf, "FEW_TERMS", 1)
    for text in ("/s[ai]l.*/", "body:ships~2", "/silk/"):
        assert found(engine.search(text, snapshot=snapshot)) == pytest.approx(BRUTE.search(parse(text)), abs=1e-9), text


def test_own_analyzer(spark, tmp_path):
    own = Engine(spark, f"file://{tmp_path}/own", Config(analyzer=lambda c: F.split(c, ",")))
    own.index_all(documents.from_literals(spark, [("x", {"f": "One Two,three"}), ("y", {"f": "three,One Two"})]))
    assert set(found(own.search('"One Two,three"'))) == {"x"}


def test_edit_distance_of_all_terms(spark, tmp_path):
    from inkwell.functions.distance import swap_distance
    from inkwell.queries import queries

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words = ["thing", "thign", "einä", "chané", "tionè", "üung", "thîng", "th1ng", "привет", "unrelatedword", "物"]
    spark.createDataFrame([(0, " ".join(words), "xx", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["edit_distance"](spark, str(tmp_path)).collect()
    assert {r["term"]: (r["edits"], r["within_one"], r["within_two"]) for r in rows} == {w: (plain(w, "thing"), swap_distance(w, "thing") <= 1, swap_distance(w, "thing") <= 2) for w in words}


def test_queries_mean_what_is_written_beside_them():
    from inkwell.functions.analysis import tokenize
    from inkwell.plans.ast import Phrase
    from inkwell.plans.compiler import lone
    from inkwell.queries import LIVE, SEARCHES

    def plain(q):
        q = lone(q)
        if isinstance(q, Bool):
            q = q.hoisted()
            return Bool(*(tuple(map(plain, own)) for own in (q.must, q.should, q.must_not)))
        if isinstance(q, Phrase):
            words = tokenize(q.phrase)
            return Term(words[0], q.field) if len(words) == 1 else Phrase(" ".join(words), q.field)
        return q

    texts = [(q, tree) for _, q, _, tree in SEARCHES.values() if isinstance(q, str)] + [(q, tree) for q, _, tree in LIVE.values()]
    for text, tree in texts:
        parsed = parse(text)
        assert (parsed and plain(parsed)) == tree, text


def test_rare_terms_restrict_the_rest(engine, snapshot, monkeypatch):
    from inkwell.plans import compiler

    texts = ["cold AND bread", "cold AND nosuch", "north cold -sea", "salt AND (s* OR \"cold bread\")", "cold river", "bread AND /s.*/"]
    for rare in (0, 1, 100):
        monkeypatch.setattr(compiler, "RARE", rare)
        for text in texts:
            assert found(engine.search(text, snapshot=snapshot)) == pytest.approx(BRUTE.search(parse(text)), abs=1e-9), text


def jobs(spark, run):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        out = run()
        return out, len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_search_starts_no_job_before_its_action(spark, engine):
    for text in ("cold", "sal*", '"cold bread"', "cold OR salt", "(cold OR salt) -sea"):
        assert jobs(spark, lambda text=text: engine.search(text))[1] == 0, text


def test_one_exchange_for_hits_and_their_number(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/exchange")
    engine.index_all(documents.from_literals(spark, list(DOCS.items())))
    for text in ("cold", "sal*", "cold OR salt", "/s[ai]l.*/"):
        df = engine.search(text)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan[: plan.index("Initial Plan")], text
