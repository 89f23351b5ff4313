import json

import pytest
from corpus import DOCS, Brute
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.engine import Engine
from inkwell.plans.parser import parse
from inkwell.repl import Repl
from inkwell.sources import documents
from inkwell.sources.index import Config, ConflictError
from inkwell.streaming.ingest import into


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/index", Config(flush_threshold=6))


def test_life_of_an_index(spark, engine, tmp_path):
    for i, d in DOCS.items():
        engine.index(i, d)
    assert engine.num_segments() == 1 and len(engine.held) == 4  # flushed by itself at six
    assert ids(engine.search("bread")) == ids_of("bread", DOCS)  # what waits is found too
    engine.flush()
    assert engine.num_segments() == 2
    before = engine.snapshot()

    changed = DOCS | {"a1": {"title": "Bread"}, "c1": {"body": "cold"}}
    engine.index("a1", changed["a1"])
    engine.index("c1", changed["c1"])
    del changed["a5"]
    engine.delete("a5", "nobody")
    assert ids(engine.search("bread")) == ids_of("bread", changed)
    engine.flush()
    for text in ("bread", "rivers", "cold", "cold -salt", "s*", '"the sea"'):
        assert ids(engine.search(text)) == ids_of(text, changed), text
    assert ids(engine.search("bread", snapshot=before)) == ids_of("bread", DOCS)  # a snapshot stays as it was

    again = Engine(spark, engine.store.path)
    assert ids(again.search("bread")) == ids_of("bread", changed)
    stats = {r["segment_id"]: (r["num_docs"], r["num_deleted"]) for r in again.segments().collect()}
    assert sorted(stats.values()) == [(2, 0), (4, 0), (6, 2)]
    first = min(stats)
    assert again.segment_stats(first)["fields"] == ["body", "tags", "title"] and again.segment_stats(first)["size_bytes"] > 0
    assert ids(again.dump_deletions(first)) == ["a1", "a5"]
    assert "a5" in ids(again.dump_entries("body", "bread"))  # persisted entries keep deleted documents
    number = again.dump_entries("body", "silk").where("doc_id = 'a4'").first()
    assert number["tf"] == 4 and list(number["positions"]) == [0, 1, 4, 5]
    assert again.load_doc(first, number["doc_num"])["year"] == 1200

    assert again.doc_id(first, number["doc_num"]) == "a4" and again.doc_num(first, "a4") == number["doc_num"] and again.doc_num(first, "zz") is None

    again.merge_all()
    assert again.num_segments() == 1
    brute = Brute(changed)
    for text in ("bread", "cold", "s*", "title:bread", "cold OR salt"):
        assert scores(again.search(text)) == pytest.approx(brute.search(parse(text)), abs=1e-9), text
    assert again.merge_all() is None
    again.vacuum()
    assert ids(again.search("bread")) == ids_of("bread", changed)
    with pytest.raises(ValueError):
        again.merge(["1"])
    with pytest.raises(ValueError):
        again.merge(["1", "2"])


def ids_of(text, docs):
    return sorted(Brute(docs).search(parse(text)))


def test_close_drops_what_waits(spark, engine):
    engine.index("x", {"body": "lost"})
    engine.close()
    assert ids(Engine(spark, engine.store.path).search("lost")) == []
    engine.flush()
    assert engine.num_segments() == 0


def test_empty_index(engine):
    assert ids(engine.search("a")) == [] and ids(engine.search("a OR b*")) == [] and ids(engine.search('"a b"')) == []
    assert engine.segments().count() == 0


def test_repeated_ids_and_null_values(spark, engine):
    rows = [("1", "b", {"f": "second"}), ("1", "a", {"f": "first"}), (None, "c", {"f": "second"}), ("2", None, {"f": None}), ("3", "d", None)]
    engine.index_all(spark.createDataFrame(rows, documents.SCHEMA))
    assert ids(engine.search("second")) == ["1"] and ids(engine.search("first")) == []
    assert engine.snapshot().total() == 3


def test_json_files(spark, engine, tmp_path):
    data = [{"ID": i, "Fields": d} for i, d in DOCS.items()]
    (tmp_path / "docs.json").write_text(json.dumps(data))
    docs = documents.from_json(spark, f"{tmp_path}/docs.json")
    assert docs.count() == len(DOCS)
    assert documents.from_json(spark, f"{tmp_path}/docs.json", 3).count() == 3
    engine.index_all(docs)
    assert ids(engine.search("bread")) == ids_of("bread", DOCS)
    assert ids(engine.search("1200")) == []  # numbers are stored only
    documents.to_json(docs, f"{tmp_path}/out")
    again = documents.from_json(spark, f"{tmp_path}/out", lines=True)
    assert {r["doc_id"]: json.loads(r["stored"]) for r in again.collect()} == {i: {k: v for k, v in d.items()} for i, d in DOCS.items()}


def test_stored_values_keep_their_types(spark, tmp_path):
    fields = {"year": 1200, "ok": True, "n": {"k": 1}, "f": 1.5, "none": None, "list": [1, "a"], "text": "so \"it\" is", "large": 12345678901234567890}
    data = [{"ID": "a", "Fields": fields}, {"ID": "b", "Fields": {"year": "1201", "text": 42}}, {"ID": "c"}, {"Fields": {"text": "no id"}}, {"ID": "d", "Fields": {}}]
    (tmp_path / "docs.json").write_text(json.dumps(data))
    rows = {r["doc_id"]: r for r in documents.from_json(spark, f"{tmp_path}/docs.json").collect()}
    assert set(rows) == {"a", "b", "d"} and json.loads(rows["a"]["stored"]) == fields and json.loads(rows["b"]["stored"]) == {"year": "1201", "text": 42}
    assert rows["a"]["fields"] == {"text": 'so "it" is'} and rows["b"]["fields"] == {"year": "1201"}  # by a value's own type


def test_averages_are_kept_as_written(spark, tmp_path):
    own = Engine(spark, f"file://{tmp_path}/averages")
    own.index_all(documents.from_literals(spark, [(str(n), {"t": "w " * n}) for n in (10, 2, 4)]))
    own.delete("10")
    own.flush()
    assert own.snapshot().average("t") == int(16 / 3 * 2) / 2 == 5.0 and own.snapshot().total() == 2
    name = next(iter(own.manifest.segments))
    assert own.segment_stats(name)["average"] == {"t": 16 / 3} and own.segment_stats(name)["path"].endswith(name)
    own.index("x", {"t": "w " * 7, "u": ""})
    own.delete("4")
    assert own.snapshot().average("t") == (int(16 / 3) + 7) / 2 and own.snapshot().total() == 2 and own.snapshot().average("u") == 0
    own.index_all(documents.from_literals(spark, [("y", {"t": "w"})]))
    assert own.snapshot().average("t") == (5 + 7 + 1) / 3
    own.merge_all()
    assert own.snapshot().average("t") == 10 / 3  # a merge counts anew
    assert Engine(spark, own.path).snapshot().average("t") == 10 / 3


def test_a_frequent_term_is_in_many_files(spark, tmp_path):
    own = Engine(spark, f"file://{tmp_path}/frequent")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own.index_all(spark.range(4000).selectExpr("cast(id as string) doc_id", "'{}' stored", "map('t', 'everywhere') fields"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = own.snapshot().entries.where("term = 'everywhere'").select(F.input_file_name()).distinct().count()
    assert files >= 4 and own.search("everywhere").count() == 4000


def test_runs_of_any_size_have_all_entries(monkeypatch):
    import pyarrow as pa

    from inkwell.sources import inversion

    rows = [("b", "t", ["y", "x", "y", None]), ("a", "u", ["z"]), ("é", "t", []), ("a", "t", ["x", "ÿ", "x", "😀", "�"]), ("c", "t", None)]
    schema = pa.schema([("doc_id", pa.string()), ("field", pa.string()), ("words", pa.list_(pa.string()))])
    want = sorted((f, w, i, [k for k, x in enumerate(ws) if x == w], len(ws)) for i, f, ws in rows for w in {*(ws or [])} - {None})
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in own], schema) for own in (rows[:3], [], rows[3:])]
    for size in (1, 4, 9, 1 << 21):
        for at_once in (1, 3, 1 << 16):
            monkeypatch.setattr(inversion, "RUN", size)
            monkeypatch.setattr(inversion, "ROWS", at_once)
            out = [r for b in inversion.runs(iter(batches)) for r in b.to_pylist()]
            entries = [(r["field"], r["term"], r["doc_id"], r["positions"], r["field_len"]) for r in out if r["term"] is not None]
            assert sorted(entries) == want and all(r["tf"] == len(r["positions"]) for r in out if r["term"] is not None)
            assert sorted((r["doc_id"], r["field"], r["field_len"]) for r in out if r["term"] is None) == sorted((i, f, len(ws or [])) for i, f, ws in rows)
    assert [e[:3] for e in entries] == sorted((e[:3] for e in entries), key=lambda e: [x.encode() for x in e])  # one run, in the order of bytes


def test_entries_are_written_without_a_shuffle(spark, tmp_path):
    """Of the texts and entries nothing is shuffled or written twice; few files are dealt out to all cores."""
    own = Engine(spark, f"file://{tmp_path}/passes")
    docs = spark.range(6000).coalesce(1).selectExpr("cast(id as string) doc_id", "'{}' stored", "map('t', array_join(transform(sequence(1, 20), k -> sha2(cast(id * 20 + k as string), 512)), ' ')) fields")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("passes", "")
    try:
        own.index_all(docs)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("passes") for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 14  # were 25
    assert own.snapshot().entries.select(F.input_file_name()).distinct().count() > 1
    assert own.snapshot().lengths.count() == 6000


def test_two_writers(spark, tmp_path):
    one, other = (Engine(spark, f"file://{tmp_path}/writers") for _ in "ab")
    one.index("a", {"t": "first"})
    one.flush()
    other.index("b", {"t": "second"})
    with pytest.raises(ConflictError):
        other.flush()
    again = Engine(spark, one.path)
    assert ids(again.search("first")) == ["a"] and ids(again.search("second")) == []


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from inkwell.sources.shared import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(cluster)


def test_tables(spark):
    df = spark.createDataFrame([(1, 2, "x", 3.0, None), (None, 1, "y", 1.0, "z")], "a int, b int, s string, d double, t string")
    rows = documents.from_table(df, ["a", "b"]).collect()
    assert [(r["doc_id"], r["fields"]) for r in rows] == [("1-2", {"s": "x"})] and json.loads(rows[0]["stored"])["d"] == 3.0


def test_repl(engine, tmp_path):
    repl = Repl(engine)
    (tmp_path / "f.json").write_text(json.dumps([{"ID": "f1", "Fields": {"body": "from file"}}, {"ID": "f2", "Fields": {"body": "from file"}}]))
    assert repl.execute('index x {"body": "hello there", "n": 1}') == "indexed x"
    assert repl.execute("search hello").startswith("x (score 0.2877)")
    assert repl.execute(f"indexfile {tmp_path}/f.json 1") == "indexed 1 documents"
    assert repl.execute("search nothing") == "no results"
    segment = repl.execute("segments").split(":")[0].splitlines()[0]
    assert "documents 1" in repl.execute(f"segment {segment} stats")
    assert "tf 1 at [0]" in repl.execute("dump entries body hello")
    number = repl.execute("dump entries body hello").split()[1]
    assert '"hello there"' in repl.execute(f"doc {segment} {number}")
    assert repl.execute("delete x") == "deleted x" and repl.execute("flush") == "flushed"
    assert repl.execute(f"dump deletions {segment}").endswith(" x")
    assert repl.execute("merge") == "merged" and repl.execute("search hello") == "no results"
    assert repl.execute("search -x").startswith("error") and repl.execute("index y [1]").startswith("error") and repl.execute("index y {").startswith("error")
    assert "search <query>" in repl.execute("help") and "unknown" in repl.execute("fly") and repl.execute("") == ""
    assert repl.execute("quit") is None


def test_stream(spark, engine, tmp_path):
    source = tmp_path / "in"
    docs = documents.from_literals(spark, list(DOCS.items()))
    docs.limit(4).coalesce(1).write.parquet(f"{source}/1")
    schema = T._parse_datatype_string(documents.SCHEMA)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = into(engine.store, stream, f"{tmp_path}/progress", merge_every=2).trigger(availableNow=True)
    query.start().awaitTermination()
    docs.coalesce(1).write.parquet(f"{source}/2")
    into(engine.store, stream, f"{tmp_path}/progress", merge_every=2).trigger(availableNow=True).start().awaitTermination()
    assert ids(engine.search("cold")) == ids_of("cold", DOCS) and engine.num_segments() == 1


def test_summary_and_analysis(spark):
    from inkwell.functions.analysis import summary, tokenize, tokens
    from inkwell.functions.distance import byte_levenshtein, swap_distance, within

    texts = ["lead text \n\nrest", "\n\nrest", "short", "word " * 150, "x" * 600, "é" * 300, "a" * 1200 + "\n\nb", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(summary(F.col("t"))).collect()]
    assert got[0] == "lead text" and got[1] is None and got[2] is None and got[7] is None
    assert got[3] == ("word " * 100).strip() + "..." and got[4] == "x" * 500 + "..." and got[5] == "é" * 250 + "..." and got[6] == "a" * 500 + "..."
    words = ["It's 3 o'clock", "snake_case ÀÉ İΣ", "", None, "…", "x²"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in words], "t string").select(tokens(F.col("t"))).collect()] == [tokenize(w or "") for w in words]
    pairs = [("kitten", "sitting", 3), ("", "abc", 3), ("abc", "abc", 0), ("flaw", "lawn", 2), ("ab", "ba", 2)]
    assert all(byte_levenshtein(a, b) == n for a, b, n in pairs) and byte_levenshtein("é", "e") == 2
    assert swap_distance("ab", "ba") == 1 and swap_distance("ca", "abc") == 3 and swap_distance("café", "cafe") == 1
    vocabulary = ["abcd", "abdc", "bacd", "badc", "abc", "abcde", "xbcd", "xycd", "xyzd", "dcba", "acbd", "ab", "abcdef", ""]
    df = spark.createDataFrame([(w,) for w in vocabulary], "w string")
    for n in (0, 1, 2):
        assert sorted(r[0] for r in df.where(within(F.col("w"), "abcd", n)).collect()) == sorted(w for w in vocabulary if swap_distance(w, "abcd") <= n)
