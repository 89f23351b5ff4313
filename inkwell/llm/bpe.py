"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut by the vocabulary's pattern; each piece is encoded on its own.  Its bytes are a doubly linked list of symbols; a priority queue holds
the rank of every pair that the vocabulary can merge.  The lowest rank, leftmost first, is merged, which makes new pairs with the neighbours; entries
whose symbols have changed since are stale and skipped when they come up.  Decoding concatenates the vocabulary's byte strings.

Pieces repeat, so a worker keeps the ids of those it has met, in a cache of bounded size that is emptied when it is full.

A vocabulary has all 256 bytes, so that any text can be encoded; one that lacks some is refused when it is read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before encoding: contractions, runs of letters, numbers or other signs with one space before, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces and ids that a worker remembers, about.
REMEMBERED = 48 << 20

OUT = "doc_id bigint, n_tokens bigint, token_ids array<int>, exact boolean"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The vocabulary file: a base64 byte string and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        if (rank := ranks.get(piece[i : i + 2])) is not None:
            queue.append((rank, i, 2))
    heapq.heapify(queue)
    push, pop, get = heapq.heappush, heapq.heappop, ranks.get
    while queue:
        _, i, size = pop(queue)
        left, j = symbols[i], after[i]
        # stale: the left symbol is gone, or one of the two has grown
        if left is None or j < 0 or len(left) + len(symbols[j]) != size:  # type: ignore[arg-type]
            continue
        both = left + symbols[j]  # type: ignore[operator]
        symbols[i], symbols[j] = both, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := get(both + symbols[k])) is not None:  # type: ignore[operator]
                push(queue, (r, i, size + len(symbols[k])))  # type: ignore[arg-type]
        if (h := before[i]) >= 0 and (r := get(symbols[h] + both)) is not None:  # type: ignore[operator]
            push(queue, (r, h, size + len(symbols[h])))  # type: ignore[arg-type]
    return [ranks[s] for s in symbols if s is not None]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        import regex

        self.ranks = read_ranks(content)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}: texts that hold them can't be encoded")
        self.strings = [b""] * (max(self.ranks.values()) + 1)
        for s, i in self.ranks.items():
            self.strings[i] = s
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode_packed(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        known, pieces = self.known, self.cut(text)
        for piece in set(pieces).difference(known):
            known[piece] = ids = array("i", merge(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
            self.held += 190 + len(piece) + len(ids)  # the two objects' own sizes and the dictionary's entry
        out = b"".join(map(known.__getitem__, pieces))
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str = PATTERN) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(content, pattern)


def vocabulary(docs: DataFrame, path: str) -> bytes:
    """The vocabulary file's content, by Spark's file system (a path without a scheme is the driver's own); its size is fixed by the vocabulary, not by the data."""
    if ":" not in path:
        path = f"file://{path}"
    return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact) of every row; ``exact``: decoding gives the text back.

    Null counts as the empty text, which has no tokens.  Special tokens' strings are ordinary text.  Texts are encoded whole, however long.  Of pairs of the same rank the leftmost is merged first.  Rows are independent: repeated ones give repeated rows, a null doc_id stays
    null, further columns are ignored, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, pattern)
        for batch in K.pieces(batches):
            texts, ids = K.strings(batch.column("text")), batch.column("doc_id")
            for lo, hi in K.spans(texts):
                encoded = [np.frombuffer(own.encode_packed(t), dtype=np.int32) for t in texts[lo:hi]]
                exact = [own.decode(e.tolist()) == t for e, t in zip(encoded, texts[lo:hi], strict=True)]
                sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=hi - lo)
                flat = np.concatenate(encoded)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), K.list_array(pa.array(flat), np.concatenate([[0], np.cumsum(sizes)])), pa.array(exact)], names=["doc_id", "n_tokens", "token_ids", "exact"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids): null ids give a null text, no ids the empty one; an id that the vocabulary lacks is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(encoded, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in K.pieces(batches):
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id bigint, text string")
