"""Documents' words to index entries, in Arrow batches.

Words are gathered until there are RUN of them, and leave as one sorted run; what a task holds is bounded by that and by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and rows, of a run.
RUN = 1 << 21
#: Rows that are handed over at once.
ROWS = 1 << 16

SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("doc_id", pa.string()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32())), ("field_len", pa.int64())])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, field, words) to rows of SCHEMA; no text is split, and none is left out."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(counts(batch.column("words")) + 1)
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + RUN - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - before
            if size >= RUN or hi < batch.num_rows:
                yield from run(held)
                held, size = [], 0
            lo = hi
    if held:
        yield from run(held)


def counts(words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The distinct values in order, each value's rank among them, and which values are null."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(max(1, len(order)), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)], values.is_null()


def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of fields, terms and ids, and then a row without a term for each row of ``held``."""
    rows = pa.Table.from_batches(held).combine_chunks()
    rows = rows.take(pc.sort_indices(rows.column("doc_id"))).combine_chunks()
    ids, fields, words = (column(rows, c) for c in ("doc_id", "field", "words"))
    lengths, values = counts(words), words.flatten()
    n, starts = len(values), np.cumsum(lengths) - lengths
    names, own_field, _ = ranked(fields)
    terms, own_term, missing = ranked(values)
    row = np.repeat(np.arange(len(lengths)), lengths)
    key = own_field[row] * max(1, len(terms)) + own_term
    there = np.flatnonzero(~missing.to_numpy(zero_copy_only=False)) if missing.true_count else np.arange(n)
    bits = n.bit_length()
    if len(names) * max(1, len(terms)) < 1 << (63 - bits):  # places in the low bits: a plain sort keeps their order
        at = np.sort((key[there] << bits) | there) & ((1 << bits) - 1)
    else:
        at = there[np.argsort(key[there], kind="stable")]
    k, r = key[at], row[at]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(at) else np.empty(0, dtype=np.int64)
    bounds = np.concatenate([first, [len(at)]])
    positions = pa.array((at - starts[r]).astype(np.int32))
    k, r = k[first], r[first]
    for lo in range(0, len(first), ROWS):
        hi = min(lo + ROWS, len(first))
        own = k[lo:hi]
        lists = pa.ListArray.from_arrays(pa.array((bounds[lo : hi + 1] - bounds[lo]).astype(np.int32)), positions.slice(bounds[lo], bounds[hi] - bounds[lo]))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(own // len(terms))), terms.take(pa.array(own % len(terms))), ids.take(pa.array(r[lo:hi])), pa.array(np.diff(bounds[lo : hi + 1])), lists, pa.array(lengths[r[lo:hi]])], schema=SCHEMA)
    by_field = np.argsort(own_field, kind="stable")
    for lo in range(0, len(by_field), ROWS):
        own = by_field[lo : lo + ROWS]
        yield pa.RecordBatch.from_arrays([fields.take(pa.array(own)), pa.nulls(len(own), pa.string()), ids.take(pa.array(own)), pa.array(np.zeros(len(own), dtype=np.int64)), pa.nulls(len(own), pa.list_(pa.int32())), pa.array(lengths[own])], schema=SCHEMA)


def column(rows: pa.Table, name: str) -> pa.Array:
    chunks = rows.column(name)
    return chunks.chunk(0) if chunks.num_chunks == 1 else pa.concat_arrays(chunks.chunks)
