"""Token counts from a digest cache.

A text's key is the digest of its normalised content together with the digest of the tokenizer's version (vocabulary and pattern).  Keys are joined to
the stored counts; what misses is encoded once for each distinct content and appended to the cache, so the next run over the same texts encodes nothing.

Digests, not texts, are shuffled.  One row is chosen for each content that misses; its text is picked within the scan by a broadcast of the chosen rows or of the others, whichever is small; where neither is,
by a shuffled join.  Rows that agree in doc_id and text can't be told apart there: their texts, and no others, are shuffled, and one of them stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bpe
from inkwell.llm import kernel as K
from inkwell.sources.shared import checkpointed, exists

CACHE = "version string, digest binary, n_tokens bigint"


def version(content: bytes, pattern: str) -> str:
    return hashlib.sha256(content + b"\x00" + pattern.encode()).hexdigest()


def normal(text: str = "text"):
    """Content that counts as the same: line ends of any kind, and white space around the text, make no difference."""
    lines = F.replace(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(lines, F.lit(" \t\n\x0b\f\r"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the normalised text, in hexadecimal digits.  Null counts as the empty text; repeated rows stay repeated, further columns are ignored."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(normal(), 256).alias("digest"))


def digests_sql() -> str:
    """``digests`` in DuckDB's SQL."""
    return "SELECT doc_id, sha256(trim(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM documents"


@lru_cache(maxsize=2)
def encoder(content: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(content), special_tokens={})


def count(docs: DataFrame, cache: str, path: str = bpe.VOCABULARY, pattern: str = bpe.PATTERN) -> DataFrame:
    """(doc_id, digest, n_tokens, hit) of every row; ``hit``: the count was in the cache before this call.

    ``cache`` is a Parquet folder that this call appends to; it is made where it is missing.  Null counts as the empty text: 0 tokens.  Texts are encoded whole, however long.  Repeated rows and texts
    that are the same after normalising are encoded once and each get their row.  An empty table gives no rows and adds nothing to the cache.  Further columns are ignored.
    """
    spark = docs.sparkSession
    content = bpe.vocabulary(docs, path)
    own_version = version(content, pattern)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    keyed = checkpointed(rows.select("doc_id", "h", F.unhex(F.sha2(normal(), 256)).alias("digest")))
    stored = spark.read.schema(CACHE).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE)
    # two jobs may have appended the same key: one row each is read.  checkpoint: what was there before this call
    before = checkpointed(stored.where(F.col("version") == own_version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))
    contents = keyed.join(before, "digest", "left_anti").groupBy("digest", "doc_id", "h").agg(F.count("*").alias("times"))
    chosen = checkpointed(contents.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "times")).alias("c")).select("digest", F.col("c.doc_id").alias("i"), F.col("c.h").alias("g"), F.col("c.times").alias("times")))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    n_rows, n_chosen = keyed.count(), chosen.count()
    single = chosen.where("times = 1")
    parts = []
    if 2 * n_chosen <= n_rows:
        parts.append(rows.join(K.small(single.drop("times")), same).select("digest", normal().alias("text")))
    else:
        others = checkpointed(keyed.join(single.select("digest", "i", "g"), (keyed["digest"] == single["digest"]) & same, "left_anti").select(F.col("doc_id").alias("i"), F.col("h").alias("g")).distinct())
        left = rows.join(K.small(others), same, "left_anti").select(normal().alias("text"))
        parts.append(left.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text"))
    if not chosen.where("times > 1").isEmpty():
        repeated = rows.join(K.small(chosen.where("times > 1").drop("times")), same).select("digest", normal().alias("text"))
        parts.append(repeated.dropDuplicates(["digest"]))
    sent = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(sent.value, pattern)
        for batch in K.pieces(batches):
            n = np.fromiter((len(own.encode_ordinary(t)) for t in K.strings(batch.column("text"))), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n)], names=["digest", "n_tokens"])

    fresh = checkpointed(reduce(DataFrame.unionByName, parts).mapInArrow(run, "digest binary, n_tokens bigint"))
    fresh.select(F.lit(own_version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    all_counts = before.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
    return keyed.join(all_counts, "digest").select("doc_id", F.lower(F.hex("digest")).alias("digest"), "n_tokens", "hit")
