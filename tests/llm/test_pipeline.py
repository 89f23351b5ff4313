import ast
from pathlib import Path

import pandas as pd

import corpus_pipeline
from inkwell.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect(spark, tmp_path):
    from test_operators import near, prose

    texts, langs = [], []
    for n, (lang, syllables) in enumerate({"aa": ("ka", "lo", "mi", "ter"), "bb": ("ché", "ou", "ri", "eau")}.items()):
        for k in range(20):
            texts.append(prose(1000 * n + k, 90, syllables))
            langs.append(lang)
    own = ("ka", "lo", "mi", "ter")
    item = prose(77, 30, own)
    texts += ["you idiot. you scum. " + texts[0][:200], texts[1], near(texts[2], 3, 0.03), prose(9, 60, own) + " " + item, texts[25]]
    langs += ["aa", "aa", "aa", "aa", "aa"]  # the last is declared wrongly
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": langs, "source": "s", "n_chars": [len(t) for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [0], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": [0], "quality": [1], "toxic": [0]}).astype({"quality": "int32", "toxic": "int32"}).to_parquet(tmp_path / "labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = set(range(len(texts)))
    assert [sorted(everything - k) for k in kept] == [[40], [40, 44], [40, 41, 42, 44], [40, 41, 42, 43, 44], [40, 41, 42, 43, 44]]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == set(range(40)) and all(r["exact"] for r in final.collect())


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "inkwell").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), path
