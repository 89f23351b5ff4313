"""URL filters over a sorted digest array.

A block list is a file of 64-bit xxhash keys in ascending order beside the full strings.  Every Spark task maps both files into memory (the pages are
shared by all workers of a machine and read only where a probe goes), looks all candidate keys of a batch up by one vectorised binary search, and compares the
stored string with the candidate, so that two strings with one digest aren't confused.

An entry is a host ("example.com": the host and all hosts below it) or a host with a path ("example.com/a/b": that page and all below it).  A URL's candidates have at most as many host labels and path parts as the list's
longest entries, so however long a URL is, few strings are made of it.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from importlib.resources import files
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.sources.shared import hadoop_fs, scratch, until_exit

#: The registered query's block list: blocklist.txt beside this file.
BLOCKED = tuple(x for x in files(__package__).joinpath("blocklist.txt").read_text().splitlines() if x and not x.startswith("#"))

OUT = "page_id bigint, url string, host string, blocked boolean, entry string"


#: The seed of Spark's own xxhash64, so that keys made on either side agree.
SEED = 42


def digests(values: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass"), SEED) for v in values), dtype=np.uint64)


def normal(url: str) -> tuple[str, str]:
    """(host, path) in lower-case host, without user, port, query, fragment and final slashes; ('', '') if it isn't a URL."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", ""
    return host, parts.path.rstrip("/") if host else ""


def candidates(host: str, path: str, labels_at_most: int, parts_at_most: int) -> list[str]:
    """Every entry of at most so many labels and path parts that would block the page, the most general first: hosts from the top, then the host's own paths from the top."""
    labels = host.rsplit(".", labels_at_most)[-labels_at_most:] if labels_at_most else []
    out = [".".join(labels[k:]) for k in range(len(labels) - 1, -1, -1)] if host else []
    parts = path.split("/", parts_at_most + 1)[1 : parts_at_most + 1]
    hosts = out[:]
    for k in range(1, len(parts) + 1):
        tail = "/" + "/".join(parts[:k])
        out += [h + tail for h in hosts]
    return out


PARTS = ("keys", "starts", "text")


def write(ordered: Iterable[tuple[int, str]], append: Callable[[str, bytes], None], buffer: int = 1 << 20) -> None:
    """Streams a block list to ``append`` as its three parts: keys, where each string starts, the strings.  (key, entry) come in the order of unsigned keys."""
    held = {part: bytearray() for part in PARTS}
    held["starts"] += struct.pack("<q", 0)
    end = 0
    for key, entry in ordered:
        text = entry.encode("utf-8", "surrogatepass")
        end += len(text)
        held["keys"] += struct.pack("<Q", key & 0xFFFFFFFFFFFFFFFF)
        held["text"] += text
        held["starts"] += struct.pack("<q", end)
        if len(held["text"]) + len(held["keys"]) > buffer:
            for part, own in held.items():
                append(part, bytes(own))
                own.clear()
    for part, own in held.items():
        append(part, bytes(own))


class Digests:
    """A mapped block list."""

    def __init__(self, keys: str, starts: str, text: str):
        self.keys = np.memmap(keys, dtype=np.uint64, mode="r") if os.path.getsize(keys) else np.empty(0, dtype=np.uint64)
        self.starts = np.memmap(starts, dtype=np.int64, mode="r")
        self.text = np.memmap(text, dtype=np.uint8, mode="r") if os.path.getsize(text) else np.empty(0, dtype=np.uint8)

    def string(self, i: int) -> str:
        return bytes(self.text[self.starts[i] : self.starts[i + 1]]).decode("utf-8", "surrogatepass")

    def holds(self, values: list[str], probes: np.ndarray | None = None) -> np.ndarray:
        """Which of ``values`` are entries.  Keys that are equal stand next to each other; each is compared."""
        probes = digests(values) if probes is None else probes
        out = np.zeros(len(values), dtype=bool)
        at = np.searchsorted(self.keys, probes)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probes) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == probes[i]:
                if self.string(k) == values[i]:
                    out[i] = True
                    break
                k += 1
        return out


def publish(spark: SparkSession, entries: Iterable[str] | DataFrame) -> tuple[list[str], int, int]:
    """Puts the files into the shared folder, and has every executor, later ones too, fetch its copy; (their names, most host labels of an entry, most path parts).

    ``entries``: strings, or a DataFrame with a column ``entry``.  Spark digests and sorts them; the driver takes them a partition at a time and streams them to the files by way of Spark's file system, whatever the folder's scheme.
    """
    where = scratch(spark, "urls")
    name = where.rsplit("/", 1)[1]
    fs, _ = hadoop_fs(spark, where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(where))
    listed = entries if isinstance(entries, DataFrame) else spark.createDataFrame([(e,) for e in entries], "entry string")
    keyed = listed.select("entry").where("entry <> ''").distinct().withColumn("key", F.xxhash64("entry")).orderBy(F.col("key") < 0, "key", "entry")
    host = F.substring_index("entry", "/", 1)
    most = listed.where("entry <> ''").agg(F.max(F.size(F.split(host, r"\."))), F.max(F.size(F.split("entry", "/")) - 1)).first()
    names = [f"{name}.{part}" for part in PARTS]
    streams = {part: fs.create(path(f"{where}/{n}"), True) for part, n in zip(PARTS, names, strict=True)}
    write(((r["key"], r["entry"]) for r in keyed.toLocalIterator()), lambda part, own: streams[part].write(bytearray(own)))
    for part, n in zip(PARTS, names, strict=True):
        streams[part].close()
        spark.sparkContext.addFile(f"{where}/{n}")
    until_exit(spark, where)
    return names, most[0] or 0, most[1] or 0


@lru_cache(maxsize=8)
def mapped(*files: str) -> Digests:
    return Digests(*(SparkFiles.get(f) for f in files))


def match(urls: list[str | None], own: Digests, labels: int, parts: int) -> tuple[list[str], list[str | None]]:
    """(host, most general entry that blocks it or None) of each URL."""
    parsed = [normal(u or "") for u in urls]
    lists = [candidates(*p, labels, parts) for p in parsed]
    flat = [c for own_list in lists for c in own_list]
    owner = np.repeat(np.arange(len(urls)), [len(x) for x in lists]) if lists else np.empty(0, dtype=np.int64)
    hits = np.flatnonzero(own.holds(flat))
    entry: list[str | None] = [None] * len(urls)
    for i in hits[::-1].tolist():  # backwards: the first one stays
        entry[owner[i]] = flat[i]
    return [p[0] for p in parsed], entry


def filter_urls(pages: DataFrame, entries: Iterable[str] | DataFrame = BLOCKED) -> DataFrame:
    """(page_id, url, host, blocked, entry) of every page; ``entry`` is the most general entry that blocks it, null if none.

    A null, empty or malformed URL has an empty host and isn't blocked; one of any length is probed whole, as far as entries go.  With no entries nothing is blocked.  Entries that are null, empty or repeated make no difference.
    Repeated rows stay repeated, a null page_id stays null, further columns are ignored, an empty table gives no rows.
    """
    names, labels, parts = publish(pages.sparkSession, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = mapped(*names)
        for batch in K.pieces(batches):
            hosts, entry = match(batch.column("url").to_pylist(), own, labels, parts)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hosts, type=pa.string()), pa.array([e is not None for e in entry], type=pa.bool_()), pa.array(entry, type=pa.string())], names=["page_id", "url", "host", "blocked", "entry"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, OUT)


def sql() -> str:
    """The registered query in DuckDB's SQL."""
    rows = ", ".join(f"('{e}')" for e in BLOCKED)
    return f"""
WITH b AS (SELECT entry, split_part(entry, '/', 1) AS h, substr(entry, length(split_part(entry, '/', 1)) + 1) AS rest FROM (VALUES {rows}) v(entry)),
p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT r, arg_min(entry, (len(string_split(rest, '/')), length(h))) AS entry FROM p JOIN b ON (host = h OR ends_with(host, '.' || h)) AND (rest = '' OR path = rest OR starts_with(path, rest || '/')) GROUP BY r)
SELECT page_id, url, host, entry IS NOT NULL AS blocked, entry FROM p LEFT JOIN m USING (r)
"""
