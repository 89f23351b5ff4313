"""Array kernels shared by the text operators.

A batch of texts is lower-cased, packed into one array of code points and cut into tokens (maximal runs of letters and
numbers) without a Python loop over characters or words.  Tokens and n-grams are 64-bit hashes; they depend on nothing but the text, so they
agree between executors, runs and machines.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points handled at once.  A single longer text is handled whole.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """1 for every code point that is a letter or a number."""
    return marked(r"[^\W_]+", np.zeros(0x110000, dtype=np.uint8), 1)


def marked(pattern: str, table: np.ndarray, value: int) -> np.ndarray:
    """``table`` of all code points with ``value`` where the pattern matches."""
    for m in re.finditer(pattern, "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = value
    return table


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a one-to-one scrambling of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only a few texts at a time are Python strings; at the end of a partition freed memory goes back to the system."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """The column's texts; null counts as the empty text."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def spans(texts: list[str], chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chunk`` characters together; no text is split and none is left out."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > chunk:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str], gap: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, each text followed by ``gap``; and where each text starts, plus the end."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + len(gap)
    packed = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return packed, np.concatenate([[0], np.cumsum(lengths)])


class Tokens:
    """The tokens of some texts.

    ``hash``: a token's 64-bit hash; ``start``, ``end``: where it is in ``points``; ``bounds``: the tokens of text i are those from bounds[i] to
    bounds[i + 1].
    """

    def __init__(self, texts: list[str]):
        self.points, self.offsets = code_points([t.lower() for t in texts])
        inside = word_table()[self.points].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = powers(len(self.points))
        sums = np.zeros(len(self.points) + 1, dtype=U)
        np.cumsum((self.points.astype(U) + U(1)) * up[: len(self.points)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.bounds = np.searchsorted(self.start, self.offsets)

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def owner(self) -> np.ndarray:
        """The text that each token belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


@lru_cache(maxsize=64)
def factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def grams(tokens: np.ndarray, bounds: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, first token) of all n-grams that lie within one text.

    With ``short``, a text of 1 to n - 1 tokens has one gram, of all its tokens.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - n + 1, (sizes > 0).astype(np.int64) if short else 0)
    new = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], counts)
    f, total = factors(n), np.zeros(new[-1], dtype=U)
    if short and len(first):
        last = np.repeat(bounds[1:], counts)
        for k in range(n):
            at = first + k
            total += np.where(at < last, tokens[np.minimum(at, len(tokens) - 1)], U(0)) * f[k]
    elif len(first):
        for k in range(n):
            total += tokens[first + k] * f[k]
    return mix(total), new, first


def gram_of(words: Iterable[int], n: int) -> int:
    """The hash of one gram of token hashes, as ``grams`` makes it."""
    own = np.fromiter(words, dtype=U)
    return int(grams(own, np.array([0, len(own)]), n)[0][0])


def sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, and their bounds."""
    values = values.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[lo:hi].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def segments(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each segment; ``empty`` for segments without values."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def list_array(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), values)


#: Bytes that a table of fixed-width columns may take in a broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of fixed-width columns, marked for a broadcast if its rows, counted, take at most BROADCAST_BYTES there (16 bytes a column and 32 a row); else as it is."""
    return F.broadcast(df) if df.count() * (16 * len(df.columns) + 32) <= BROADCAST_BYTES else df


def keep(docs: DataFrame, which: Callable[[list[str], pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that ``which`` marks, with all columns, whatever their names, as they are.  It gets the texts and the batch, in which only text and lang have their names."""
    names = docs.columns
    own = docs.toDF(*(c if c in ("text", "lang") and names.index(c) == k else f"__{k}" for k, c in enumerate(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(np.asarray(which(strings(batch.column("text")), batch), dtype=bool)))

    return own.mapInArrow(run, own.schema).toDF(*names)
