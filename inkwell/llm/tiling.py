"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared as token sequences.  Documents that share a seed (MATCH consecutive tokens) with an item are found by
a join on seed hashes; for each such pair, running Karp-Rabin greedy string tiling repeatedly marks the longest match that overlaps no earlier
one, down to MATCH tokens.  The share of the item's tokens that tiles cover is the score: it doesn't depend on the order in which the passages come.

The seed join is a filter against the items' sorted seed array within the scan, so documents are never shuffled.  The items are broadcast in slices
of a checked size, one scan a slice: a larger benchmark takes more scans, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernel as K

#: The shortest match that counts, in tokens.
MATCH = 4
#: The share of an item's tokens from which a document counts as holding it.
COVERAGE = 0.5
#: Characters of benchmark text in one broadcast.
SLICE_CHARS = 16 << 20

OUT = "doc_id bigint, item_id bigint, coverage double, tiles bigint, longest bigint"


class Seeds:
    """The items of one slice: their tokens, and a sorted array of seed hashes with the items that have each."""

    def __init__(self, items: list[tuple[int, str]], match: int):
        self.ids = [i for i, _ in items]
        t = K.Tokens([text for _, text in items])
        self.tokens = [t.hash[a:b].tolist() for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
        values, bounds, _ = K.grams(t.hash, t.bounds, match, short=False)
        owner = np.repeat(np.arange(len(items)), np.diff(bounds))
        order = np.lexsort((owner, values))
        self.values, self.owners = values[order], owner[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(values >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into values, item) of every shared seed."""
        at = np.flatnonzero(self.maybe[(values >> np.uint64(42)).view(np.int64)])
        lo, hi = np.searchsorted(self.values, values[at], "left"), np.searchsorted(self.values, values[at], "right")
        count = hi - lo
        run = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(at, count), self.owners[run]


def tile(item: list[int], doc: list[int], places: list[int], match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), longest first; ties by place in the item, then in the document.

    ``places``: where in the document a seed of the item starts; no match of ``match`` tokens or more starts elsewhere.
    """
    base, mask = 0x9E3779B97F4A7C15 | 1, (1 << 61) - 1
    used_item, used_doc = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    # stretches of the document that a match may lie in
    zones: list[list[int]] = []
    for p in places:
        if zones and p <= zones[-1][1]:
            zones[-1][1] = max(zones[-1][1], p + match)
        else:
            zones.append([p, p + match])
    def windows(tokens: list[int], used: bytearray, lo: int, hi: int):
        """Karp-Rabin: (hash, start) of each stretch of ``match`` unmarked tokens within lo..hi."""
        h = n = 0
        for i in range(lo, hi):
            if used[i]:
                h = n = 0
                continue
            if n == match:
                h = (h - tokens[i - match] * drop) % mask
                n -= 1
            h = (h * base + tokens[i]) % mask
            n += 1
            if n == match:
                yield h, i - match + 1

    drop = pow(base, match - 1, mask)
    while True:
        table = defaultdict(list)
        for h, i in windows(item, used_item, 0, len(item)):
            table[h].append(i)
        # equal windows that follow one another on a diagonal are one match: its length is known at its last window
        runs: dict[tuple[int, int], int] = {}
        for a, b in zones:
            for h, j in windows(doc, used_doc, a, b):
                for i in table.get(h, ()):
                    if item[i : i + match] == doc[j : j + match]:
                        runs[i, j] = runs.get((i - 1, j - 1), 0) + 1
        if not runs:
            break
        longest = max(runs.values())
        length = longest + match - 1
        for i, j in sorted((i - longest + 1, j - longest + 1) for (i, j), n in runs.items() if n == longest):
            if not any(used_item[i : i + length]) and not any(used_doc[j : j + length]):
                used_item[i : i + length] = used_doc[j : j + length] = b"\x01" * length
                tiles.append((i, j, length))
    return tiles


def found(texts: list[str], seeds: Seeds, match: int, least: float) -> Iterator[tuple]:
    """(index of the text, item, coverage, number of tiles, longest tile) of each leak."""
    for lo, hi in K.spans(texts):
        t = K.Tokens(texts[lo:hi])
        values, _, first = K.grams(t.hash, t.bounds, match, short=False)
        at, item = seeds.hits(values)
        if not len(at):
            continue
        at = first[at]
        doc = np.searchsorted(t.bounds, at, "right") - 1
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            i, d = int(item[a]), int(doc[a])
            own = seeds.tokens[i]
            if match * (b - a) < least * len(own):  # more than its seeds' tokens can't be covered
                continue
            start = t.bounds[d]
            tiles = tile(own, t.hash[start : t.bounds[d + 1]].tolist(), np.unique(at[a:b] - start).tolist(), match)
            covered = sum(x[2] for x in tiles)
            if covered >= least * len(own):
                yield lo + d, seeds.ids[i], round(covered / len(own), 6), len(tiles), tiles[0][2]


def scan(batches: Iterator[pa.RecordBatch], seeds: Seeds, match: int, least: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "coverage", "tiles", "longest"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for batch in K.pieces(batches):
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[r[0]], *r[1:]) for r in found(K.strings(batch.column("text")), seeds, match, least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=types[k]) for k in range(5)], names=names)


def slices(benchmark: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of at most about ``chars`` characters, streamed to the driver one partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if held and size + len(row[1]) > chars:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, least: float = COVERAGE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of every document that covers ``least`` of a benchmark item's tokens or more.

    Items of fewer than ``match`` tokens can't be matched and give no row; nor do null or empty texts, null items, or empty tables.  A repeated
    document or item gives a row for each combination.  A null doc_id stays null.  Further columns of either table are ignored.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    parts = []
    for items in slices(benchmark, slice_chars):
        sent = spark.sparkContext.broadcast(Seeds(items, match))
        parts.append(own.mapInArrow(lambda it, sent=sent: scan(it, sent.value, match, least), OUT))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], OUT)


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, least: float = COVERAGE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, in narrow passes without a join.

    Each row is judged by its own text: another row with the same doc_id and a clean text stays, and so does a null or empty text.
    """
    for items in slices(benchmark, slice_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(items, match))

        def which(texts: list[str], _: pa.RecordBatch, sent=sent) -> np.ndarray:
            marked = np.ones(len(texts), dtype=bool)
            marked[[r[0] for r in found(texts, sent.value, match, least)]] = False
            return marked

        docs = K.keep(docs, which)
    return docs
