"""A command line over an engine: ``python -m inkwell.repl <folder>``."""

from __future__ import annotations

import json
import sys

from inkwell.engine import Engine
from inkwell.sources.documents import from_json

HELP = """\
index <id> <json>               add or replace a document
indexfile <path> [n]            load [{"ID": ..., "Fields": {...}}], the first n
delete <id>                     delete a document
flush                           persist what waits
merge                           merge all segments
search <query>                  every hit with its score
segments                        segments and their sizes
segment <id> stats              documents, deletions, fields of a segment
doc <segment> <n>               a stored document
dump entries <field> <term>     persisted entries of a term
dump deletions <segment>        deleted documents of a segment
help, quit, exit"""


class Repl:
    """Each command gives the text to print; None ends the session."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def execute(self, line: str) -> str | None:
        name, _, rest = line.strip().partition(" ")
        if not name:
            return ""
        if name in ("quit", "exit"):
            self.engine.close()
            return None
        handler = getattr(self, "do_" + name, None)
        if handler is None:
            return f"unknown command {name}; try help"
        try:
            return handler(rest.strip())
        except (ValueError, IndexError) as e:
            return f"error: {e}"

    def do_help(self, _: str) -> str:
        return HELP

    def do_index(self, rest: str) -> str:
        doc_id, _, text = rest.partition(" ")
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise ValueError("a document is a JSON object")
        self.engine.index(doc_id, doc)
        return f"indexed {doc_id}"

    def do_indexfile(self, rest: str) -> str:
        path, *count = rest.split()
        docs = from_json(self.engine.store.spark, path, int(count[0]) if count else 0)
        self.engine.index_all(docs)
        return f"indexed {docs.count()} documents"

    def do_delete(self, rest: str) -> str:
        self.engine.delete(rest)
        return f"deleted {rest}"

    def do_flush(self, _: str) -> str:
        self.engine.flush()
        return "flushed"

    def do_merge(self, _: str) -> str:
        self.engine.merge_all()
        return "merged"

    def do_search(self, rest: str) -> str:
        return "\n".join(f"{r['doc_id']} (score {r['score']:.4f})" for r in self.engine.search(rest).toLocalIterator()) or "no results"

    def do_segments(self, _: str) -> str:
        return "\n".join(f"{r['segment_id']}: {r['num_docs']} documents" for r in self.engine.segments().orderBy("segment_id").collect()) or "no segments"

    def do_segment(self, rest: str) -> str:
        name, what = rest.split()
        if what != "stats":
            raise ValueError("segment <id> stats")
        s = self.engine.segment_stats(name)
        return f"documents {s['num_docs']}, deleted {s['num_deleted']}, fields {', '.join(s['fields'])}, bytes {s['size_bytes']}"

    def do_doc(self, rest: str) -> str:
        name, number = rest.split()
        doc = self.engine.load_doc(name, int(number))
        return "no such document" if doc is None else json.dumps(doc, ensure_ascii=False, indent=2)

    def do_dump(self, rest: str) -> str:
        what, *args = rest.split()
        if what == "entries":
            rows = self.engine.dump_entries(*args).orderBy("segment_id", "doc_num").toLocalIterator()
            return "\n".join(f"{r['segment_id']} {r['doc_num']} tf {r['tf']} at {list(r['positions'])}" for r in rows) or "no entries"
        if what == "deletions":
            return "\n".join(f"{r['doc_num']} {r['doc_id']}" for r in self.engine.dump_deletions(*args).orderBy("doc_num").toLocalIterator()) or "no deletions"
        raise ValueError("dump entries|deletions")


def main() -> None:
    from pyspark.sql import SparkSession

    repl = Repl(Engine(SparkSession.builder.appName("inkwell").getOrCreate(), sys.argv[1]))
    for line in sys.stdin:
        if (said := repl.execute(line)) is None:
            break
        print(said)


if __name__ == "__main__":
    main()
