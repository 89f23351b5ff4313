"""The index: immutable Parquet segments, a manifest for each epoch, logical deletes.

    <path>/segments/<id>/docs       (doc_num, doc_id, stored)
    <path>/segments/<id>/entries    (field, term, doc_id, tf, positions, field_len), in runs that are sorted by field, term and document; without a term: a document's length in a field
    <path>/segments/<id>/terms      (field, term, docs): the dictionary, deleted documents included
    <path>/deletes/<epoch>          (segment_id, doc_id)
    <path>/manifest/<epoch>.json    the segments, with their statistics, and delete folders of the epoch

A snapshot is a set of DataFrames over the files that one manifest names; nothing that it reads is ever changed.  A manifest appears by a rename, so a job that dies
leaves the epoch before it in force.  What scoring needs to know of a segment is counted when it is written and kept in the manifest, so a search starts no job for it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import analysis
from inkwell.functions.scoring import Scoring
from inkwell.sources import documents, inversion
from inkwell.sources.shared import checkpointed, content_size, exists, hadoop_fs, remove

ENTRIES = "field string, term string, doc_id string, tf bigint, positions array<int>, field_len bigint"
TERMS = "field string, term string, docs bigint"
LENGTHS = "doc_id string, field string, field_len bigint"
DOCS = "doc_num bigint, doc_id string, stored string"
DELETES = "segment_id string, doc_id string"


#: Bytes of a row group of the documents that a segment is made from.
ROW_GROUP = 8 << 20
#: Bytes of files whose entries a merge sorts in one task.
MERGED = 32 << 20


class ConflictError(RuntimeError):
    """Two writers made the same epoch; the one that gets this has changed nothing."""


def folder(epoch: int) -> str:
    """A new folder's name: in the order of epochs, and no other writer's."""
    return f"{epoch:012d}-{uuid.uuid4().hex[:8]}"


@dataclass
class Config:
    flush_threshold: int = 1000
    analyzer: analysis.Analyzer = analysis.tokens
    scoring: Scoring = Scoring.BM25


def long_form(docs: DataFrame, analyzer: analysis.Analyzer) -> DataFrame:
    """(doc_id, field, words): a row for each searchable field of each document."""
    return docs.select("doc_id", F.explode("fields").alias("field", "text")).select("doc_id", "field", analyzer(F.col("text")).alias("words"))


def postings(words: DataFrame) -> DataFrame:
    """The entries of ``words`` (as of ``long_form``) in sorted runs, and a row without a term for each row of ``words``: nothing is shuffled, and each text is analyzed once."""
    return words.select("doc_id", "field", "words").mapInArrow(inversion.runs, ENTRIES)


def inverted(words: DataFrame) -> DataFrame:
    """The entries of ``words``."""
    return postings(words).where("term IS NOT NULL")


def lengths(words: DataFrame) -> DataFrame:
    return words.select("doc_id", "field", F.size("words").cast("bigint").alias("field_len"))


def one_each(docs: DataFrame) -> DataFrame:
    """One row for each id, that of the greatest ``stored``; rows without an id are left out.  Only ids are shuffled, and the rows whose ids are repeated."""
    docs = docs.where("doc_id IS NOT NULL")
    repeated = checkpointed(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("stored").desc()))
    chosen = docs.join(repeated, "doc_id", "left_semi").withColumn("__k", rank).where("__k = 1").drop("__k")
    return docs.join(repeated, "doc_id", "left_anti").unionByName(chosen)


@dataclass
class Segment:
    """What the manifest says of a segment: documents; how many of them are deleted; by field, (tokens, documents with a token) as of when it was written."""

    docs: int = 0
    deleted: int = 0
    fields: dict[str, list[int]] = field(default_factory=dict)

    def live(self) -> int:
        return self.docs - self.deleted


def averages(parts: list[tuple[Segment, int]]) -> dict[str, float]:
    """The average length by field of (segment, live documents): each segment's own average, as written, is weighted with its live documents and cut to whole tokens."""
    sums: dict[str, list[int]] = {}
    for segment, live in parts:
        for name, (tokens, docs) in segment.fields.items():
            if docs:
                own = sums.setdefault(name, [0, 0])
                own[0] += int(tokens / docs * live)
                own[1] += live
    return {name: tokens / docs if docs else 0.0 for name, (tokens, docs) in sums.items()}


def field_counts(lengths: DataFrame) -> dict[str, list[int]]:
    rows = lengths.groupBy("field").agg(F.coalesce(F.sum("field_len"), F.lit(0)).alias("tokens"), F.count_if(F.col("field_len") > 0).alias("docs")).collect()
    return {r["field"]: [r["tokens"], r["docs"]] for r in rows}


@dataclass
class Manifest:
    epoch: int = 0
    segments: dict[str, Segment] = field(default_factory=dict)
    deletes: list[str] = field(default_factory=list)


@dataclass
class Snapshot:
    """What a search sees."""

    spark: SparkSession
    docs: DataFrame  # segment_id, doc_num, doc_id, stored: live documents
    lengths: DataFrame
    entries: DataFrame
    terms: DataFrame  # field, term, docs: a superset of the live dictionary
    config: Config
    epoch: int = 0
    segments: dict[str, Segment] = field(default_factory=dict)
    held: DataFrame | None = None  # (doc_id, field, field_len) of documents that wait, and how many they are
    held_docs: int = 0
    gone: DataFrame | None = None  # (segment_id) of each flushed document that a waiting change makes obsolete
    cached: dict = field(default_factory=dict)

    def total(self) -> int:
        """Live documents."""
        return self.statistics()[0]

    def average(self, name: str) -> float:
        """The average length of a field: each segment's average, as of when it was written, is over its documents that have the field; it is weighted with all its live documents, cut to whole tokens."""
        return self.statistics()[1].get(name, 0.0)

    def statistics(self) -> tuple[int, dict[str, float]]:
        """(documents, average length by field): from the manifest.  Only documents and deletes that wait are counted, once for a snapshot."""
        if not self.cached:
            gone = {r[0]: r[1] for r in self.gone.groupBy("segment_id").count().collect()} if self.gone is not None else {}
            parts = [(s, s.live() - gone.get(name, 0)) for name, s in self.segments.items()]
            if self.held is not None:
                parts.append((Segment(self.held_docs, 0, field_counts(self.held)), self.held_docs))
            self.cached |= {"total": sum(live for _, live in parts), "average": averages(parts)}
        return self.cached["total"], self.cached["average"]

    def fields(self) -> list[str]:
        return sorted(r[0] for r in self.lengths.select("field").distinct().collect())


class Index:
    """An index in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.held: dict[str, dict] = {}  # documents of the driver, not yet flushed: ids to fields
        self.gone: set[str] = set()  # ids whose segment versions are obsolete
        self.manifest = self._read_manifest()

    # manifest

    def _read_manifest(self) -> Manifest:
        fs, where = hadoop_fs(self.spark, f"{self.path}/manifest")
        if not fs.exists(where):
            return Manifest()
        epochs = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")]
        if not epochs:
            return Manifest()
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{max(epochs):012d}.json").first()[0]
        read = json.loads(text)
        return Manifest(read["epoch"], {name: Segment(**s) for name, s in read["segments"].items()}, read["deletes"])

    def _commit(self, manifest: Manifest) -> None:
        """Puts ``manifest`` in force; an error if another writer has made that epoch, or if the rename fails."""
        name = f"{self.path}/manifest/{manifest.epoch:012d}"
        fs, draft = hadoop_fs(self.spark, f"{name}.{uuid.uuid4().hex}.draft")
        final = hadoop_fs(self.spark, name + ".json")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ConflictError(f"epoch {manifest.epoch} of {self.path} could not be committed: another writer was first, or the rename failed")
        self.manifest = manifest

    # writing

    def index(self, doc_id: str, doc: dict) -> None:
        """Adds a document or replaces the one of that id.  Flushes when flush_threshold documents wait."""
        self.held.pop(doc_id, None)
        self.held[doc_id] = doc
        self.gone.add(doc_id)
        if len(self.held) >= self.config.flush_threshold:
            self.flush()

    def index_all(self, docs: DataFrame) -> None:
        """Adds or replaces all of ``docs`` (doc_id, stored, fields) as one segment, after what waits.  Of rows with one id, that of the greatest ``stored`` stays."""
        self.flush()
        self._write(one_each(docs), None)

    def delete(self, *doc_ids: str) -> None:
        """Unknown ids are no error."""
        for i in doc_ids:
            self.held.pop(i, None)
            self.gone.add(i)

    def flush(self) -> None:
        """Persists waiting documents and deletes; nothing happens where there are none."""
        if self.held or self.gone:
            docs = documents.from_literals(self.spark, list(self.held.items())) if self.held else None
            ids = self.spark.createDataFrame([(i,) for i in sorted(self.gone)], "doc_id string") if self.gone and self.manifest.segments else None
            self._write(docs, ids)
            self.held, self.gone = {}, set()

    def _write(self, docs: DataFrame | None, gone: DataFrame | None) -> None:
        """A new epoch: ``docs`` as a segment (None: none), and deletes of ``gone``, by default of the ids of ``docs``, in earlier segments."""
        epoch = self.manifest.epoch + 1
        name = folder(epoch)
        new = Manifest(epoch, {name: Segment(**asdict(s)) for name, s in self.manifest.segments.items()}, list(self.manifest.deletes))
        if docs is not None:
            written = self._write_segment(docs, name)
            gone = self.spark.read.schema(DOCS).parquet(f"{self.path}/segments/{name}/docs").select("doc_id") if gone is None else gone
        if gone is not None and self.manifest.segments:
            # only live versions are marked, each once
            at = f"{self.path}/deletes/{name}"
            self._docs(self.manifest).join(gone.distinct(), "doc_id", "left_semi").select("segment_id", "doc_id").write.mode("overwrite").parquet(at)
            for r in self.spark.read.schema(DELETES).parquet(at).groupBy("segment_id").count().collect():
                new.segments[r[0]].deleted += r[1]
            new.deletes.append(name)
        if docs is not None:
            new.segments[name] = written
        self._commit(new)

    def _write_segment(self, docs: DataFrame, name: str) -> Segment:
        """Writes the files; each text is analyzed once, and entries leave for their file as they are made."""
        at = f"{self.path}/segments/{name}"
        # in small row groups: what comes next is dealt out by them, however few files the documents came in
        docs.select(F.monotonically_increasing_id().alias("doc_num"), "doc_id", "stored", "fields").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{at}/source")
        own = self.spark.read.schema(DOCS + ", fields map<string,string>").parquet(f"{at}/source")
        own.select("doc_num", "doc_id", "stored").write.mode("overwrite").parquet(f"{at}/docs")
        postings(long_form(own, self.config.analyzer)).write.mode("overwrite").parquet(f"{at}/entries")
        self._write_terms(at)
        remove(self.spark, f"{at}/source")
        return self._counted(at)

    def _counted(self, at: str) -> Segment:
        own = self.spark.read.schema(ENTRIES).parquet(f"{at}/entries").where("term IS NULL")
        return Segment(self.spark.read.schema(DOCS).parquet(f"{at}/docs").count(), 0, field_counts(own))

    def _write_terms(self, at: str) -> None:
        own = self.spark.read.schema(ENTRIES).parquet(f"{at}/entries").where("term IS NOT NULL").groupBy("field", "term").agg(F.count("*").alias("docs"))
        own.sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{at}/terms")

    # reading

    def _segment(self, name: str, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/{part}").withColumn("segment_id", F.lit(name))

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema + ", segment_id string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _gone(self, manifest: Manifest) -> DataFrame | None:
        if not manifest.deletes:
            return None
        return self.spark.read.schema(DELETES).parquet(*(f"{self.path}/deletes/{d}" for d in manifest.deletes))

    def _live(self, df: DataFrame, manifest: Manifest) -> DataFrame:
        gone = self._gone(manifest)
        return df if gone is None else df.join(gone, ["segment_id", "doc_id"], "left_anti")

    def _docs(self, manifest: Manifest) -> DataFrame:
        return self._live(self._union([self._segment(s, "docs", DOCS) for s in manifest.segments], DOCS), manifest)

    def snapshot(self) -> Snapshot:
        """Everything indexed until now, flushed or not."""
        m, spark = self.manifest, self.spark
        docs = self._union([self._segment(s, "docs", DOCS) for s in m.segments], DOCS)
        both = self._union([self._segment(s, "entries", ENTRIES) for s in m.segments], ENTRIES)
        own_lengths = both.where("term IS NULL").select("doc_id", "field", "field_len", "segment_id")
        entries = both.where("term IS NOT NULL")
        terms = self._union([self._segment(s, "terms", TERMS) for s in m.segments], TERMS)
        docs, own_lengths, entries = (self._live(x, m) for x in (docs, own_lengths, entries))
        gone = held_lengths = None
        if self.gone and m.segments:
            ids = spark.createDataFrame([(i,) for i in sorted(self.gone)], "doc_id string")
            gone = docs.join(ids, "doc_id", "left_semi").select("segment_id")
            docs, own_lengths, entries = (x.join(ids, "doc_id", "left_anti") for x in (docs, own_lengths, entries))
        if self.held:
            head = documents.from_literals(spark, list(self.held.items()))
            live = F.lit("").alias("segment_id")
            docs = docs.unionByName(head.select(F.monotonically_increasing_id().alias("doc_num"), "doc_id", "stored", live))
            words = long_form(head, self.config.analyzer)
            held_lengths = lengths(words)
            own_lengths = own_lengths.unionByName(held_lengths.select("*", live))
            own = inverted(words)
            entries = entries.unionByName(own.select("*", live))
            terms = terms.unionByName(own.groupBy("field", "term").agg(F.count("*").alias("docs")).select("*", live))
        return Snapshot(spark, docs, own_lengths, entries, terms, self.config, m.epoch, m.segments, held_lengths, len(self.held), gone)

    # maintenance and inspection

    def merge(self, names: list[str]) -> str:
        """Rewrites the live documents of the named segments as one; its name.  At least two, all of them known."""
        names = list(dict.fromkeys(names))
        if len(names) < 2:
            raise ValueError("a merge takes two segments or more")
        if missing := [n for n in names if n not in self.manifest.segments]:
            raise ValueError(f"no segment {missing[0]}")
        m = self.manifest
        epoch = m.epoch + 1
        name = folder(epoch)
        at = f"{self.path}/segments/{name}"
        docs, entries = (self._live(self._union([self._segment(s, part, schema) for s in names], schema), m).drop("segment_id") for part, schema in (("docs", DOCS), ("entries", ENTRIES)))
        docs.withColumn("doc_num", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{at}/docs")
        # by hashes: for ranges the joins would run once more to be sampled; as many partitions as are sorted in memory
        size = sum(content_size(self.spark, f"{self.path}/segments/{s}/entries") for s in names)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-size // MERGED))
        entries.repartition(tasks, "field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{at}/entries")
        self._write_terms(at)
        deletes = []
        gone = self._gone(m)
        if gone is not None:
            rest = gone.where(~F.col("segment_id").isin(names))
            rest.write.mode("overwrite").parquet(f"{self.path}/deletes/{name}")
            deletes = [name]
        self._commit(Manifest(epoch, {k: s for k, s in m.segments.items() if k not in names} | {name: self._counted(at)}, deletes))
        return name

    def merge_all(self) -> str | None:
        """Merges all segments; with fewer than two nothing happens."""
        return self.merge(list(self.manifest.segments)) if len(self.manifest.segments) > 1 else None

    def vacuum(self) -> None:
        """Removes the files that the present manifest doesn't name.  Snapshots of earlier epochs can't be read after that."""
        for part, keep in (("segments", self.manifest.segments), ("deletes", self.manifest.deletes)):
            fs, where = hadoop_fs(self.spark, f"{self.path}/{part}")
            if exists(self.spark, f"{self.path}/{part}"):
                for s in fs.listStatus(where):
                    if s.getPath().getName() not in keep:
                        fs.delete(s.getPath(), True)

    def num_segments(self) -> int:
        return len(self.manifest.segments)

    def segments(self) -> DataFrame:
        """(segment_id, num_docs, num_deleted) of each segment, from the manifest."""
        rows = [(name, s.docs, s.deleted) for name, s in self.manifest.segments.items()]
        return self.spark.createDataFrame(rows, "segment_id string, num_docs bigint, num_deleted bigint")

    def segment_stats(self, name: str) -> dict:
        """path, num_docs, num_deleted, fields, average length by field as of when it was written, size_bytes of a segment."""
        if name not in self.manifest.segments:
            raise ValueError(f"no segment {name}")
        own = self.manifest.segments[name]
        average = {f: tokens / docs if docs else 0.0 for f, (tokens, docs) in sorted(own.fields.items())}
        return {"path": f"{self.path}/segments/{name}", "num_docs": own.docs, "num_deleted": own.deleted, "fields": sorted(own.fields), "average": average, "size_bytes": content_size(self.spark, f"{self.path}/segments/{name}")}

    def load_doc(self, name: str, doc_num: int) -> dict | None:
        """A stored document, deleted or not."""
        row = self._segment(name, "docs", DOCS).where(F.col("doc_num") == doc_num).select("stored").first()
        return json.loads(row[0]) if row else None

    def doc_num(self, name: str, doc_id: str) -> int | None:
        """A document's number within a segment."""
        row = self._segment(name, "docs", DOCS).where(F.col("doc_id") == doc_id).select("doc_num").first()
        return row[0] if row else None

    def doc_id(self, name: str, doc_num: int) -> str | None:
        """The id of a number within a segment."""
        row = self._segment(name, "docs", DOCS).where(F.col("doc_num") == doc_num).select("doc_id").first()
        return row[0] if row else None

    def dump_entries(self, field_name: str, term: str) -> DataFrame:
        """(segment_id, doc_num, doc_id, tf, positions) as persisted: with deleted documents, without those that wait."""
        entries = self._union([self._segment(s, "entries", ENTRIES) for s in self.manifest.segments], ENTRIES).where("term IS NOT NULL")
        docs = self._union([self._segment(s, "docs", DOCS) for s in self.manifest.segments], DOCS)
        found = entries.where((F.col("field") == field_name) & (F.col("term") == term))
        return found.join(docs, ["segment_id", "doc_id"]).select("segment_id", "doc_num", "doc_id", "tf", "positions")

    def dump_deletions(self, name: str) -> DataFrame:
        """(doc_num, doc_id) of a segment's deleted documents."""
        gone = self._gone(self.manifest)
        docs = self._segment(name, "docs", DOCS)
        if gone is None:
            return docs.select("doc_num", "doc_id").limit(0)
        return docs.join(gone.where(F.col("segment_id") == name).select("doc_id"), "doc_id").select("doc_num", "doc_id")

    def close(self) -> None:
        """What waits and wasn't flushed is dropped."""
        self.held, self.gone = {}, set()
