"""N-gram Jaccard join by T-occurrence search.

A document is the set of its word 3-grams.  Two sets with Jaccard similarity of at least t share at least
ceil(t * |larger|) grams, so a query set asks its inverted lists for every set that occurs T times or more in them.
DivideSkip answers that: the longest lists are set aside, the short ones are merged, and what occurs often enough among the short ones is looked up
in the long ones by binary search.

How it is spread out: an inverted index over all documents is not built in one place.  Documents whose sets are equal are collapsed first
(a digest of the whole set), then each distinct set is routed to blocks by its prefix: with grams in one order for all sets, rare ones first, two sets that meet the threshold t
share a gram among the first |set| - ceil(t * |set|) + 1 of each, so no such pair is left out.  Grams that no other set has are dropped from prefixes; most sets then have none left and no partner.  How often a gram occurs
is counted in buckets of gram hashes, to which a set sends 32 bits a gram; where two grams agree in those, a block is larger than need be, and nothing is lost.

A block is a prefix gram and the sets that have it, cut where sizes are too far apart for a pair.  Of blocks with the same members one stays.  Each
block then goes, with all its members, into the largest one that any of them has: what was together stays so, and a set is there in few blocks.
Each block runs the search over its own inverted index, every set being a query; a block of more than PART grams is dealt out to parts, and each two parts are a task of their own, so that no task
grows with a block and no pair is lost.  Gram arrays travel only for sets that share a block.

Pairs never leave a task: it reports how many documents each of its sets is linked to, a pair being counted where it meets first, and an edge from each set to the first one of its group.

The short lists are merged by a heap of list heads that skips (MergeSkip).  A pop takes what its list holds within a narrow window of set numbers, not a single entry: the same result, at a heap step for each
list and window.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.sources.shared import checkpointed, written

N, THRESHOLD = 3, 0.5
#: DivideSkip's constant: how dear a probe of a long list is, against merging.
MU = 1.0
#: Set numbers that a turn of the merge looks at.
WINDOW = 256
#: Long lists that are probed at once, before candidates are weeded out again.
PROBES = 32
#: Grams in a part of a block, about; a task takes two parts at most.
PART = 1 << 20
#: Grams in a bucket, about, when they are counted.
SHARE = 1 << 21

OUT = "doc_id bigint, class_id bigint, links bigint"


def digests(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each gram set."""
    return [K.segments(np.add, K.mix(values ^ s), bounds, np.uint64(0)).view(np.int64) for s in K.factors(2)]


def signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, hi, lo, size) of every document: the digest of its gram set and the number of grams; without a gram, a null digest."""
    for batch in K.pieces(batches):
        texts = K.strings(batch.column("text"))
        for lo, hi in K.spans(texts):
            t = K.Tokens(texts[lo:hi])
            values, bounds = K.sets(*K.grams(t.hash, t.bounds, n)[:2])
            size = np.diff(bounds)
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("text_hash"), *(pa.array(d, mask=size == 0) for d in digests(values, bounds)), pa.array(size)],
                names=["doc_id", "text_hash", "hi", "lo", "size"],
            )


ASKED = "bucket int, span bigint, docs binary, low binary, head binary"
COUNTED = "bucket int, span bigint, docs binary, low binary, times binary, head binary"
PREFIXES = "hi bigint, lo bigint, size bigint, keys array<bigint>"


def asked(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The grams of a few documents at a time (a span), by bucket: the document's place in the span (16 bits) and the gram's lower 32 bits.  One row of a span has the digests and sizes of its documents in ``head``.

    A gram's bucket follows from its upper 32 bits.  A span's number depends on what is in it: rows of different runs of a task never pass for the same span.
    """
    task, count = TaskContext.get().partitionId(), 0
    for batch in K.pieces(batches):
        texts = K.strings(batch.column("text"))
        for lo, hi in K.spans(texts):
            t = K.Tokens(texts[lo:hi])
            values, bounds = K.sets(*K.grams(t.hash, t.bounds, n)[:2])
            if not len(values):
                continue
            size = np.diff(bounds)
            head = np.stack([*digests(values, bounds), size])
            place = np.arange(hi - lo, dtype=np.uint64)
            span = K.mix(K.mix(head[0].view(np.uint64) + place).sum(keepdims=True) ^ np.uint64(task << 32 | count)).view(np.int64)
            count += 1
            bucket = (((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            docs, low = np.repeat(place.astype(np.uint16), size)[order], values.astype(np.uint32)[order]
            at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            own = np.flatnonzero(np.diff(at))
            cut = [[x[at[b] : at[b + 1]].tobytes() for b in own] for x in (docs, low)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array(np.repeat(span, len(own))), *(pa.array(c, type=pa.binary()) for c in cut), pa.array([head.tobytes()] + [None] * (len(own) - 1), type=pa.binary())],
                names=["bucket", "span", "docs", "low", "head"],
            )


def packed(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // np.dtype(dtype).itemsize


def counted(bucket: pa.Table) -> pa.Table:
    """What is left of one bucket's rows without grams that occur once, and how often the others do (65,535 at most)."""
    low, lengths = packed(bucket.column("low"), np.uint32)
    docs, _ = packed(bucket.column("docs"), np.uint16)
    order = np.argsort(low)
    own = low[order]
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    run = np.diff(np.append(head, len(own)))
    times = np.empty(len(low), dtype=np.uint16)
    times[order] = np.repeat(np.minimum(run, 0xFFFF).astype(np.uint16), run)
    keep = times > 1
    at = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])]
    cut = [[x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for x in (docs[keep], low[keep], times[keep])]
    out = pa.table([bucket.column("bucket"), bucket.column("span"), *(pa.array(c, type=pa.binary()) for c in cut), bucket.column("head")], names=["bucket", "span", "docs", "low", "times", "head"])
    return out.filter(pa.array((np.diff(at) > 0) | np.asarray(bucket.column("head").is_valid())))


def prefixes(span: pa.Table, threshold: float) -> pa.Table:
    """(hi, lo, size, keys) of the documents of a span that can have a partner: the grams of their prefixes that occur twice or more."""
    heads = [h for h in span.column("head").to_pylist() if h is not None]
    if len(heads) != 1:
        raise RuntimeError("documents came in another order when a task was run again")
    hi, lo, size = np.frombuffer(heads[0], dtype=np.int64).reshape(3, -1)
    low, lengths = packed(span.column("low"), np.uint32)
    (docs, _), (times, _) = packed(span.column("docs"), np.uint16), packed(span.column("times"), np.uint16)
    key = np.repeat(span.column("bucket").to_numpy().astype(np.int64), lengths) << 32 | low
    need = np.maximum(1, np.ceil(threshold * size - 1e-9).astype(np.int64))
    room = np.bincount(docs, minlength=len(size)) - need + 1  # grams that occur once come first in the order
    some = room > 0
    here = some[docs]
    docs, key, times = docs[here], key[here], times[here]
    order = np.lexsort((key, times, docs))
    docs, key = docs[order], key[order]
    place = np.arange(len(docs)) - np.searchsorted(docs, docs)
    first = np.ones(len(docs), dtype=bool)
    first[1:] = (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])
    pick = (place < room[docs]) & first
    bounds = np.concatenate([[0], np.cumsum(np.bincount(docs[pick], minlength=len(size))[some])])
    return pa.table([pa.array(hi[some]), pa.array(lo[some]), pa.array(size[some]), K.list_array(pa.array(key[pick]), bounds)], names=["hi", "lo", "size", "keys"])


def gram_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Adds each document's ascending distinct gram hashes."""
    for batch in K.pieces(batches):
        texts = K.strings(batch.column("text"))
        for lo, hi in K.spans(texts):
            t = K.Tokens(texts[lo:hi])
            values, bounds = K.sets(*K.grams(t.hash, t.bounds, n)[:2])
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([own.column("hi"), own.column("lo"), K.list_array(pa.array(values.view(np.int64)), bounds)], names=["hi", "lo", "grams"])


def merge_skip(keys: np.ndarray, first: np.ndarray, lists: np.ndarray, end: np.ndarray, stride: int, need: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(values, in how many lists) of what ``need`` of the lists hold, ascending, by a heap of their heads.

    ``keys`` ascend and are list * stride + value; list k of the call is ``lists[k]``, from first[k] to end[k].  A turn pops the lists whose heads are less than ``window`` from the least one and counts what they hold there.
    If fewer than ``need`` are, nothing there can be in enough lists: the next heads are popped until need - 1 are, and all of those jump by binary search to the head that is left on the heap.
    """
    at, base, k = first.copy(), lists * stride, len(lists)
    heap = ((keys[at] - base) * k + np.arange(k)).tolist()
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    values, times = [], []
    while len(heap) >= need:
        least = heap[0] // k
        target = least + window
        popped = []
        while heap and heap[0] < target * k:
            popped.append(pop(heap) % k)
        if len(popped) >= need:
            own = np.array(popped)
            after = np.minimum(np.searchsorted(keys, base[own] + target), end[own])
            length = after - at[own]
            run = np.repeat(at[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            counted = np.bincount(keys[run] - np.repeat(base[own], length) - least)
            enough = np.flatnonzero(counted >= need)
            values.append(enough + least)
            times.append(counted[enough])
        else:
            while heap and len(popped) < need - 1:
                popped.append(pop(heap) % k)
            if not heap:
                break
            own, target = np.array(popped), heap[0] // k
            after = np.minimum(np.searchsorted(keys, base[own] + target), end[own])
        at[own] = after
        left = own[after < end[own]]
        for x in ((keys[at[left]] - base[left]) * k + left).tolist():
            push(heap, x)
    return (np.concatenate(values), np.concatenate(times)) if values else (np.empty(0, dtype=np.int64),) * 2


def matches(grams: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, others, overlaps): all pairs of sets with a Jaccard similarity of ``threshold`` or more, each once, as indices into ``grams``."""
    sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    order = np.argsort(sizes, kind="stable")  # by size: a query looks only for sets before it, none of them larger
    sizes = sizes[order]
    values = np.concatenate([grams[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(values, kind="stable")
    values, post = values[by], owner[by]  # the inverted index: lists of owners, ascending
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    list_of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(values))))
    list_at, keys = list_of, list_of * len(order) + post  # an entry's number: lists one after the other, each ascending
    rank = np.arange(len(values)) - head[list_of]  # entries before this one in its list
    back = np.argsort(by, kind="stable")
    list_of, rank = list_of[back], rank[back]  # in the order of queries again
    at = np.concatenate([[0], np.cumsum(sizes)])
    for q in range(1, len(order)):
        need = max(1, int(np.ceil(threshold * sizes[q] - 1e-9)))
        lists, length = list_of[at[q] : at[q + 1]], rank[at[q] : at[q + 1]]
        some = length > 0
        if some.sum() < need:
            continue
        start, length = head[lists[some]], length[some]
        down = np.argsort(-length, kind="stable")
        start, length = start[down], length[down]
        long = min(need - 1, int(need / (MU * np.log2(max(2, length[0])) + 1)))
        candidate, count = merge_skip(keys, start[long:], list_at[start[long:]], start[long:] + length[long:], len(order), need - long)
        enough = sizes[candidate] >= threshold * sizes[q] - 1e-9
        candidate, count = candidate[enough], count[enough]
        # probe the long ones, some lists at a time, as long as the rest can still lead there
        for k in range(0, long, PROBES):
            if not len(candidate):
                break
            own = start[k : min(k + PROBES, long)]
            probe = (list_at[own] * len(order))[:, None] + candidate[None, :]
            place = np.searchsorted(keys, probe)
            count = count + (keys[np.minimum(place, len(keys) - 1)] == probe).sum(axis=0)
            keep = count >= need - max(0, long - k - PROBES)
            candidate, count = candidate[keep], count[keep]
        keep = count >= threshold * (sizes[candidate] + sizes[q] - count) - 1e-9
        if keep.any():
            yield int(order[q]), order[candidate[keep]], count[keep]


class Met:
    """Which pairs of a block's sets meet in no block of a smaller number.  Only blocks under ``here`` matter: a column of a bit table each."""

    def __init__(self, here: int, blocks: list[np.ndarray]):
        smaller, owner = np.concatenate(blocks), np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        owner, smaller = owner[smaller < here], smaller[smaller < here]
        names, column = np.unique(smaller, return_inverse=True)
        self.table = np.zeros((len(blocks), len(names) // 8 + 1), dtype=np.uint8)
        np.bitwise_or.at(self.table, (owner, column // 8), (1 << (column % 8)).astype(np.uint8))

    def first(self, one: int, others: np.ndarray) -> np.ndarray:
        return ~(self.table[others] & self.table[one]).any(axis=1)


def search(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(hi, lo, links, root_hi, root_lo) of the sets of one task that have a partner in it.

    ``links``: documents of the partners that it meets here first.  root: the first set of the group that the task's pairs connect it to.  A pair within a part
    is looked at in the task that the part shares with the next one, or, the last part, with the one before it.
    """
    rows = block[["hi", "lo"]].to_numpy()
    part, weight = block["part"].to_numpy(), block["weight"].to_numpy()
    first, second, parts = (int(block[c].iloc[0]) for c in ("a", "b", "parts"))
    own = np.zeros(parts, dtype=bool)
    own[first] = second in (first, first + 1)
    own[second] |= second == parts - 1 and second - first <= 1
    met = Met(block["block"].iloc[0], [np.asarray(b) for b in block["blocks"]])
    links, label = np.zeros(len(block), dtype=np.int64), np.arange(len(block))
    partnered = np.zeros(len(block), dtype=bool)
    for q, others, _ in matches([np.asarray(g, dtype=np.int64) for g in block["grams"]], threshold):
        here = (part[others] != part[q]) | own[part[q]]
        others = others[here]
        if not len(others):
            continue
        partnered[q] = partnered[others] = True
        counted = others[met.first(q, others)]
        links[counted] += weight[q]
        links[q] += weight[counted].sum()
        names = np.unique(np.append(label[others], label[q]))
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]
    out = pd.DataFrame({"hi": rows[:, 0], "lo": rows[:, 1], "links": links, "root_hi": rows[label, 0], "root_lo": rows[label, 1]})
    return out[partnered]


def related(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, part: int = PART, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(signatures of all documents, what ``search`` reports of every task): ``docs`` has doc_id and text."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = written(own.mapInArrow(lambda it: signatures(it, n), "doc_id bigint, text_hash bigint, hi bigint, lo bigint, size bigint"), "signatures")
    named = signed.where("hi IS NOT NULL").groupBy("hi", "lo", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"))
    distinct = written(named.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("doc_id").alias("weight"), F.first("size").alias("size")), "sets")
    same = lambda x: F.col("o.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("o.text_hash") == F.col(f"{x}.text_hash"))
    again = signed.alias("o").join(distinct.select("hi", "lo", "rep.doc_id", "rep.text_hash").alias("d"), ["hi", "lo"]).where(~same("d"))
    again = K.small(written(again.select("o.doc_id", "o.text_hash").distinct(), "again"))
    buckets = max(1, -(-(distinct.agg(F.sum("size")).first()[0] or 0) // share))
    asks = own.alias("o").join(again.alias("r"), same("r"), "left_anti").select("text").mapInArrow(lambda it: asked(it, n, buckets), ASKED)
    kept = asks.groupBy("bucket").applyInArrow(counted, COUNTED).groupBy("span").applyInArrow(lambda span: prefixes(span, threshold), PREFIXES)
    keyed = written(kept, "prefixes").dropDuplicates(["hi", "lo"]).select("hi", "lo", "size", F.explode("keys").alias("band"))
    # a block is a prefix gram that two sets have, or what is left of one that is cut where the next larger set is too large for a pair with any before it
    by_size = Window.partitionBy("band").orderBy("size")
    keyed = keyed.withColumn("cut", (F.lag("size").over(by_size) + 1e-6 < F.lit(threshold) * F.col("size")).cast("int"))
    keyed = keyed.withColumn("cut", F.coalesce(F.sum("cut").over(by_size), F.lit(0)))
    keyed = keyed.select("hi", "lo", "size", F.when(F.col("cut") > 0, F.xxhash64("band", "cut")).otherwise(F.col("band")).alias("band"))
    # of blocks with the same members one stays
    blocks = (
        keyed.groupBy("band").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("hi", "lo")).alias("both"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("total")).where("members > 1")
        .groupBy("members", "both", "total").agg(F.min("band").alias("band"))
    )
    placed = keyed.join(blocks.select("band", "members"), "band").select("hi", "lo", "size", "band", "members")
    # a block goes into the largest one that any of its members has
    top = placed.withColumn("top", F.max(F.struct("members", "band")).over(Window.partitionBy("hi", "lo")))
    into = F.max("top").over(Window.partitionBy("band"))["band"]
    joined = checkpointed(top.select("hi", "lo", "size", into.alias("into")).distinct().withColumnRenamed("into", "band"))
    parts = joined.groupBy("band").agg(F.ceil(F.sum("size") / F.lit(part)).cast("int").alias("parts"))
    routed = joined.select("hi", "lo", "band").join(parts, "band").groupBy("hi", "lo").agg(F.collect_list(F.struct("band", "parts")).alias("blocks"))
    routed = written(routed.join(distinct.select("hi", "lo", "rep", "weight"), ["hi", "lo"]), "routes")
    reps = K.small(routed.select("hi", "lo", "rep.doc_id", "rep.text_hash")).alias("r")
    one = own.alias("o").join(reps, same("r"), "inner").select("hi", "lo", "text")
    grams = one.mapInArrow(lambda it: gram_sets(it, n), "hi bigint, lo bigint, grams array<bigint>").dropDuplicates(["hi", "lo"])
    sent = grams.join(routed.select("hi", "lo", "weight", "blocks"), ["hi", "lo"]).select("hi", "lo", "weight", "grams", F.col("blocks.band").alias("blocks"), F.explode("blocks").alias("k"))
    sent = sent.select("hi", "lo", "weight", "grams", "blocks", F.col("k.band").alias("block"), F.col("k.parts").alias("parts")).withColumn("part", F.pmod(F.xxhash64("hi", "lo", "block"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    tasks = sent.withColumn("other", F.explode(others)).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other")
    found = tasks.groupBy("block", "a", "b").applyInPandas(lambda block: search(block, threshold), "hi bigint, lo bigint, links bigint, root_hi bigint, root_lo bigint")
    return signed, found


def linked(found: DataFrame) -> DataFrame:
    """(node, root) of the sets that have a partner: the groups that what ``search`` reports connects."""
    return groups(found.select(F.struct("hi", "lo").alias("a"), F.struct(F.col("root_hi").alias("hi"), F.col("root_lo").alias("lo")).alias("b")))


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, part: int = PART, share: int = SHARE) -> DataFrame:
    """(doc_id, class_id, links) of each document: the smallest doc_id of its group, and how many other documents have a word n-gram set of Jaccard similarity ``threshold`` or more to its own.

    Groups are what such pairs connect.  Documents with equal sets have similarity 1 and count each.  A document is a doc_id and a gram set: repeated rows are one, a doc_id with several
    different texts has a row for each.

    Null or empty texts and texts without letters or numbers have no grams: a group of their own, no links.  Texts of fewer than n tokens have one gram, of all
    of them; very long ones are compared whole.  Rows with a null doc_id have no row and count for no links, though they can connect others.  An empty table gives no rows; further columns are ignored.
    """
    signed, found = related(docs, threshold, n, part, share)
    found = written(found, "found")
    sets = signed.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    counted = found.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    rooted = sets.join(linked(found).select("node.hi", "node.lo", "root"), ["hi", "lo"], "left").join(counted, ["hi", "lo"], "left")
    grouped = checkpointed(rooted.where("root IS NOT NULL OR links IS NOT NULL").withColumn("root", F.coalesce("root", F.struct("hi", "lo"))))
    class_of = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = grouped.join(class_of, "root").select("hi", "lo", "class_id", "links")
    named = signed.where("doc_id IS NOT NULL").select("doc_id", "hi", "lo").distinct()
    whole = named.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.count("*").alias("same"), F.min("doc_id").alias("least")).join(classes, ["hi", "lo"], "left")
    whole = whole.select("hi", "lo", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("links"))
    alone = named.where("hi IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return named.join(whole, ["hi", "lo"]).select("doc_id", "class_id", "links").unionByName(alone)


def groups(pairs: DataFrame) -> DataFrame:
    """(node, root): the connected components of ``pairs`` (a, b), roots being the smallest nodes.

    Alternates large-star and small-star steps; each round is checkpointed, so its lineage doesn't grow, and their number grows with the logarithm of the longest chain.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        star = large.withColumn("m", m)
        edges = checkpointed(star.select("u", F.col("m").alias("v")).unionByName(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The documents without near copies: of each group (as in ``join``) one row stays, that of the smallest doc_id.

    A null doc_id comes before any other; among rows that agree in doc_id the smallest text hash stays, and rows that agree in both stay once.  Documents without a gram
    (null, empty, or signs only) have no copies and all stay.  An empty table stays empty.  Columns, whatever their names, and their order are those of ``docs``.
    """
    names = docs.columns
    own = docs.toDF(*(f"c{k}" for k in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    signed, found = related(own.select(doc_id.alias("doc_id"), text.alias("text")), threshold, n)
    signed = signed.where("hi IS NOT NULL")
    rooted = signed.select("doc_id", "text_hash", F.struct("hi", "lo").alias("node")).join(linked(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    ranked = rooted.join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # per (doc_id, text): whether it goes, and whether it is there more than once
    fate = written(ranked.groupBy("doc_id", "text_hash").agg(F.max(stays).alias("kept"), F.count("*").alias("times")).where(~F.col("kept") | (F.col("times") > 1)), "fates")
    same = doc_id.cast("bigint").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash"))
    joined = own.join(K.small(fate), same, "left")
    columns = [f"c{k}" for k in range(len(names))]
    single = joined.where("text_hash IS NULL").select(*columns)
    repeated = joined.where("kept").dropDuplicates(["doc_id", "text_hash"]).select(*columns)
    return single.unionByName(repeated).toDF(*names)


def sql(n: int = N, threshold: float = THRESHOLD) -> str:
    """``join`` in DuckDB's SQL, by brute force over all documents that share a gram."""
    parts = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE [{parts} for i in range(1, len(w) - {n - 2})] END)) AS own FROM t WHERE len(w) > 0),
named AS (SELECT *, min(doc_id) OVER (PARTITION BY own) AS least, hash(own) AS rep, count(*) OVER (PARTITION BY own) AS weight FROM g),
s AS (SELECT DISTINCT rep, weight, len(own) AS size, unnest(own) AS gram FROM (SELECT DISTINCT ON (rep) * FROM named)),
o AS (SELECT a.rep AS a, b.rep AS b, any_value(b.weight) AS weight, any_value(a.size + b.size) AS sizes, count(*) AS overlap FROM s a JOIN s b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep),
e AS MATERIALIZED (SELECT a, b, weight FROM o WHERE overlap >= {threshold} * (sizes - overlap)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
reps AS (SELECT rep, min(least) AS least FROM named GROUP BY rep),
classes AS (SELECT a AS rep, min(least) AS class_id FROM reach JOIN reps ON rep = b GROUP BY a),
degree AS (SELECT a AS rep, sum(weight) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, least) AS class_id, (coalesce(links, 0) + weight - 1)::bigint AS links FROM named LEFT JOIN classes USING (rep) LEFT JOIN degree USING (rep)
UNION ALL SELECT DISTINCT doc_id, doc_id, 0 FROM t WHERE len(w) = 0
"""
