"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A text is covered by windows of 2L shingles, L apart, for each length class L of templates (powers of two): wherever a template of up to L shingles
stands, one window holds all of it.  Then the Jaccard similarity of the two shingle sets is at least (templ. shingles) / (window shingles), 0.25 or more for templates
of over L / 2 shingles, and with BANDS bands of one hash each a window misses its template with a probability of at most (1 - 0.25) ** 48 = 1e-6; one that holds 0.8 of it, (1 - 0.19) ** 48 = 4e-5.  What the bands retrieve
is verified in the window: the share of the template's shingles that it holds.

Window minima come from minima of blocks of L shingles, two neighbours at a time, and a class's blocks are made of those of the class below, so a hash costs one pass over the shingles however many classes there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.llm.license_texts import TEMPLATES

SHINGLE = 3
BANDS = 48
#: The share of a template's shingles that a window holds.
CONTAINMENT = 0.8

OUT = "doc_id bigint, license string, containment double, first_token bigint"


class Templates:
    """Templates by shingle and length class: their shingle sets, and a sorted array of band keys.  The shingle of a template of fewer tokens than that is the whole template."""

    def __init__(self, texts: dict[str, str], shingle: int = SHINGLE, bands: int = BANDS):
        self.names, self.shingle, self.bands = sorted(texts), shingle, bands
        self.seeds = K.factors(bands)
        t = K.Tokens([texts[n] for n in self.names])
        sizes = np.diff(t.bounds)
        self.sets: list[np.ndarray] = []
        self.classes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # band keys, their templates, and which first 16 bits occur
        by_class: dict[tuple[int, int], list[int]] = {}
        for i, size in enumerate(sizes.tolist()):
            n = max(1, min(shingle, size))
            values, _, _ = K.grams(t.hash[t.bounds[i] : t.bounds[i + 1]], np.array([0, size]), n)
            self.sets.append(np.unique(values))
            if size:
                by_class.setdefault((n, 1 << (len(values) - 1).bit_length()), []).append(i)
        for length, own in sorted(by_class.items()):
            keys = K.mix(np.array([[(self.sets[i] * s).min() ^ s for s in self.seeds] for i in own], dtype=np.uint64).ravel())
            which = np.repeat(own, bands)
            order = np.lexsort((which, keys))
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.classes[length] = keys[order], which[order], maybe


class Windows:
    """Windows of 2 * ``length`` shingles, ``length`` apart, over texts whose shingles have ``bounds``; the last one of a text may be shorter.

    ``owner``, ``first``, ``end``: each window's text and shingles.  ``starts``: where each block of ``length`` shingles starts; ``inner``, the same in the blocks of ``finer`` windows.  A window is the block ``block`` and,
    for those in ``both``, the next one.
    """

    def __init__(self, bounds: np.ndarray, length: int, finer: "Windows | None"):
        sizes = np.diff(bounds)
        blocks = -(-sizes // length)
        self.length, self.of_text = length, np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(self.of_text[-1]) - self.of_text[text]
        self.starts = bounds[text] + number * length
        self.inner = None if finer is None else finer.of_text[text] + number * (length // finer.length)
        self.block = np.flatnonzero((number == 0) | (number < blocks[text] - 1))
        self.owner, self.first = text[self.block], self.starts[self.block]
        self.end = np.minimum(self.first + 2 * length, bounds[self.owner + 1])
        self.both = np.flatnonzero(self.first + length < self.end)

    def minima(self, low: np.ndarray) -> np.ndarray:
        """Each window's minimum, from the blocks' minima."""
        out = low[self.block]
        out[self.both] = np.minimum(out[self.both], low[self.block[self.both] + 1])
        return out


def scan(texts: list[str], own: Templates, least: float) -> Iterator[tuple[int, str, float, int]]:
    """(text, license, containment, first token of the window) where a window holds a template: of each template in a text the best window, the first among equals."""
    for lo, hi in K.spans(texts):
        t = K.Tokens(texts[lo:hi])
        if not len(t.hash):
            continue
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n in sorted({n for n, _ in own.classes}):
            values, bounds, _ = K.grams(t.hash, t.bounds, n)
            levels: list[Windows] = []
            for length in sorted(x for m, x in own.classes if m == n):
                levels.append(Windows(bounds, length, levels[-1] if levels else None))
            pairs: list[set[tuple[int, int]]] = [set() for _ in levels]
            for seed in own.seeds:
                low = values * seed
                for level, windows in enumerate(levels):
                    low = np.minimum.reduceat(low, windows.starts if windows.inner is None else windows.inner)
                    keys, which, maybe = own.classes[n, windows.length]
                    key = K.mix(windows.minima(low) ^ seed)
                    at = np.flatnonzero(maybe[(key >> np.uint64(48)).view(np.int64)])
                    left, right = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                    some = right > left
                    pairs[level].update((int(w), int(which[k])) for w, a, b in zip(at[some], left[some], right[some], strict=True) for k in range(a, b))
            for windows, found in zip(levels, pairs, strict=True):
                for w, template in sorted(found):
                    first = windows.first[w]
                    held = np.isin(own.sets[template], values[first : windows.end[w]]).mean()
                    if held >= least - 1e-9:
                        where = (int(windows.owner[w]), template)
                        got = (round(float(held), 6), int(first - bounds[windows.owner[w]]))
                        if where not in best or got[0] > best[where][0]:
                            best[where] = got
        for (doc, template), (held, place) in sorted(best.items()):
            yield lo + doc, own.names[template], held, place


def find(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT, shingle: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, containment, first_token) of every template that a document holds; ``first_token``: where the window starts that holds most of it.

    Null and empty texts hold none.  A text or template of fewer tokens than a shingle is one shingle, and such a template is looked for in shingles of its own length.  Templates that hold one another are all reported; of windows that hold
    as much the first is named.  Texts are scanned whole, however long.  A repeated row gives its rows again; a null doc_id stays null; further columns are ignored; without templates or documents there are no rows.
    """
    own = Templates(TEMPLATES if templates is None else templates, shingle, bands)
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r[0]], *r[1:]) for r in scan(K.strings(batch.column("text")), sent.value, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=x) for k, x in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64()))], names=["doc_id", "license", "containment", "first_token"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def sql(templates: dict[str, str] = TEMPLATES, least: float = CONTAINMENT, n: int = SHINGLE) -> str:
    """``find`` in DuckDB's SQL: the containment of every template of ``n`` tokens or more in every window, without bands."""
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(templates.items()))
    parts = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    shingles = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE [{parts} for i in range(1, len(w) - {n - 2})] END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
p AS (SELECT license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {rows}) v(license, body)),
t AS (SELECT license, pow(2, ceil(log2(len(w) - {n - 1})))::bigint AS l, list_distinct({shingles}) AS s FROM p WHERE len(w) >= {n}),
ts AS (SELECT license, l, len(s) AS whole, unnest(s) AS shingle FROM t),
ds AS MATERIALIZED (SELECT r, {shingles} AS s FROM d WHERE len(w) > 0),
g AS (SELECT r, len(s) AS n, unnest(s) AS shingle, unnest(range(len(s))) AS place FROM ds),
m AS (SELECT r, license, l, whole, n, shingle, place // l AS block FROM g JOIN ts USING (shingle)),
k AS (SELECT * FROM (SELECT r, license, l, whole, shingle, n, unnest([block - 1, block]) AS win FROM m) WHERE win BETWEEN 0 AND greatest(0, (n + l - 1) // l - 2)),
c AS (SELECT r, license, win * l AS first_token, round(count(DISTINCT shingle)::double / any_value(whole), 6) AS containment, count(DISTINCT shingle)::double / any_value(whole) AS held FROM k GROUP BY r, license, win, l),
b AS (SELECT * FROM c WHERE held >= {least} - 1e-9 QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, first_token) = 1)
SELECT doc_id, license, containment, first_token::bigint AS first_token FROM b JOIN d USING (r)
"""
