"""Language-model scores from a probabilistic suffix tree.

``score_all`` scores a corpus by the tree of that corpus, whose states grow with it: a context becomes a state if it occurs MIN_COUNT times and a divergence test says that it
predicts differently from its next shorter suffix.  A state's next-symbol distribution is smoothed by a floor.  A text is scored by the longest state that is a suffix of what came before each symbol.

The tree is never in one place: its grams are dealt out by the latest symbols of their contexts, so that a context lies
with its suffixes, and each slice of the texts gets the costs of the grams that it holds.  Symbols are the UTF-8 bytes of lower-cased text, in any script; contexts have up to ``depth`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.sources.shared import written

#: Bytes of a context; a context and its next byte are packed into 64 bits, so at most 7.
DEPTH, MAX_DEPTH = 5, 7
#: A state's context diverges by at least so many bits from its parent.
MIN_BITS = 0.05
#: Every symbol has at least this probability in every state.
FLOOR = 1e-4
#: A state's context occurs at least so often, whatever the size of the corpus.
MIN_COUNT = 2
#: Characters of text in a slice, and rows of grams in a part of the tree, about.
SLICE, PART = 64_000_000, 2_000_000
#: Contexts of the same KEY latest symbols lie together; shorter ones are made on the driver and sent to all.
KEY = 2

OUT = "doc_id bigint, bits_per_symbol double, bits double, symbols bigint"


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, ascending; sums of their counts)."""
    values, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(n, first)


def mask(k: int) -> int:
    """The latest ``k`` bytes of a packed gram."""
    return (1 << (8 * k)) - 1


def packed(texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): for each UTF-8 byte of each lower-cased text, the ``depth`` bytes before it (line ends before the first) and itself, lowest."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    gap = b"\n" * depth
    own = np.frombuffer(gap + gap.join(encoded), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)))])
    codes = np.zeros(len(own) - depth, dtype=np.int64)
    for k in range(depth + 1):
        codes <<= 8
        codes |= own[k : k + len(codes)]
    inside = np.ones(len(codes), dtype=bool)  # but for the gaps' own bytes
    ends = bounds[1:-1] + depth * np.arange(len(texts) - 1)
    for k in range(depth):
        inside[ends + k] = False
    return codes[inside], bounds


#: The grams of one length: (codes, ascending; their next symbol's share in its context; cost in bits by the longest state).
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def priced(codes: np.ndarray, n: np.ndarray, low: int, high: int, up: Level | None, min_count: int, min_bits: float, floor: float) -> Level:
    """The grams of contexts of ``high`` symbols, given their counts and, unless ``low`` is 0, the level of ``low`` - 1.

    ``codes`` are distinct and ascending, and with a context all others of the same latest ``low`` symbols are there.
    """
    chain, to_shorter = [(codes, n)], []
    for k in range(high - 1, low - 1, -1):
        shorter, at = np.unique(chain[-1][0] & mask(k + 1), return_inverse=True)
        to_shorter.append(at)
        chain.append((shorter, np.bincount(at, weights=chain[-1][1], minlength=len(shorter))))
    for k in range(low, high + 1):
        own, count = chain.pop()
        first = np.flatnonzero(np.diff(own >> 8, prepend=-1))
        whole = np.add.reduceat(count, first)
        sizes = np.diff(np.append(first, len(own)))
        share = count / np.repeat(whole, sizes)
        cost = -np.log2((1 - 256 * floor) * share + floor)
        if up is not None:
            at = to_shorter.pop() if k > low else np.searchsorted(up[0], own & mask(k))
            gain = np.add.reduceat(share * np.log2(share / up[1][at]), first)
            state = (whole >= min_count) & (gain >= min_bits)
            cost = np.where(np.repeat(state, sizes), cost, up[2][at])
        up = (own, share, cost)
    return up


def score_all(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, min_bits: float = MIN_BITS, floor: float = FLOOR, slice_chars: int = SLICE, part_rows: int = PART) -> DataFrame:
    """(doc_id, bits_per_symbol, bits, symbols) of every row, by the tree of all rows.  ``symbols`` are the lower-cased text's characters.

    Texts are put into slices.  A slice's distinct grams are counted, go to the part of the tree that their contexts' latest symbols name, and come back with their costs.  Only
    contexts of fewer than KEY symbols are on the driver.

    Null and empty texts have 0 symbols and null bits_per_symbol.  Texts are read whole, however long.  Repeated rows count as often as they are there and give repeated rows; a null doc_id stays null;
    further columns are ignored; an empty table gives no rows.
    """
    if not KEY < depth <= MAX_DEPTH:
        raise ValueError(f"contexts have {KEY + 1} to {MAX_DEPTH} bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    slices = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars + 1
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))

    def tallied(texts: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in K.pieces(texts.to_batches()):
            own = K.strings(batch.column("text"))
            for lo, hi in K.spans(own, 4 * K.CHUNK):
                codes, _ = packed(own[lo:hi], depth)
                if len(codes):
                    held.append(np.unique(codes, return_counts=True))
                    waiting += len(held[-1][0])
                if waiting > 4_000_000:
                    held = [merged(held)]
                    waiting = len(held[0][0]) // 2
        values, n = merged(held) if held else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        number = texts.column("slice")[0].as_py()
        return pa.table({"slice": pa.array(np.full(len(values), number, dtype=np.int32)), "code": pa.array(values.astype(np.int64)), "n": pa.array(n)})

    grams = written(sliced.select("slice", "text").groupBy("slice").applyInArrow(tallied, "slice int, code bigint, n bigint"), "grams")
    short = grams.groupBy(F.col("code").bitwiseAND(F.lit(mask(KEY))).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).toPandas().sort_values("code")
    if len(short):
        shortest = priced(short["code"].to_numpy(), short["n"].to_numpy(), 0, KEY - 1, None, min_count, min_bits, floor)
    else:
        shortest = None
    sent = spark.sparkContext.broadcast(shortest)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("slice").to_numpy(), b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not sum(len(h[0]) for h in held):
            return
        number, codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        distinct, at = np.unique(codes, return_inverse=True)
        cost = priced(distinct, np.bincount(at, weights=n), KEY, depth, sent.value, min_count, min_bits, floor)[2].astype(np.float32)
        for lo in range(0, len(codes), 200_000):
            own = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(number[own]), pa.array(codes[own]), pa.array(cost[at[own]])], names=["slice", "code", "cost"])

    latest = F.shiftright("code", 8).bitwiseAND(F.lit(mask(KEY)))
    parts = int(short["rows"].sum()) // part_rows + 1
    costs = grams.repartition(parts, latest).mapInArrow(part, "slice int, code bigint, cost float")

    def scored(texts: pa.Table, priced_grams: pa.Table) -> pa.Table:
        codes, cost = priced_grams.column("code").to_numpy(), priced_grams.column("cost").to_numpy()
        order = np.argsort(codes)
        codes, cost = codes[order], cost[order].astype(np.float64)
        out = []
        for batch in K.pieces(texts.to_batches()):
            own = K.strings(batch.column("text"))
            total, sizes = np.zeros(len(own)), np.fromiter((len(t.lower()) for t in own), dtype=np.int64, count=len(own))
            for lo, hi in K.spans(own, 2 * K.CHUNK):
                found, bounds = packed(own[lo:hi], depth)
                values, at = np.unique(found, return_inverse=True)
                total[lo:hi] = K.segments(np.add, cost[np.searchsorted(codes, values)][at] if len(values) else np.empty(0), bounds, 0.0)
            each = np.divide(total, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0)
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(each, 6), from_pandas=True), pa.array(np.round(total, 4)), pa.array(sizes)], names=["doc_id", "bits_per_symbol", "bits", "symbols"]))
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "bits_per_symbol": pa.array([], pa.float64()), "bits": pa.array([], pa.float64()), "symbols": pa.array([], pa.int64())})

    return sliced.groupBy("slice").cogroup(costs.groupBy("slice")).applyInArrow(scored, OUT)
