"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared to its language's reference by the Jensen-Shannon distance.  The
references are the sums over all documents of the language; a language's common words are its COMMON most frequent ones, and all other words are one bin.  Documents under the minimum lengths
are not judged: their histograms are mostly chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.sources.shared import checkpointed

COMMON = 50
#: Documents with fewer characters or words are not judged.
MIN_CHARS, MIN_WORDS = 200, 40
#: The largest distances (0 to 1) that pass.
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.20, 0.40

#: Character classes as regular-expression sets, in order; what is in none of them is the last class.
CLASSES = {
    "lower": r"a-z\x{DF}-\x{F6}\x{F8}-\x{FF}",
    "upper": r"A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}",
    "digit": r"0-9",
    "space": r" ",
    "line": r"\n\r\t",
    "stop": r".,;:!?'\"()\-",
    "bar": r"|",
    "sign": r"#$%&*+/<=>@\[\\\]^_`{}~",
}

OUT = "doc_id bigint, lang string, chars bigint, words bigint, chars_distance double, words_distance double, verdict string, keep boolean"


def class_table() -> np.ndarray:
    table = np.full(0x110000, len(CLASSES), dtype=np.uint8)
    ranges = [[(97, 122), (0xDF, 0xF6), (0xF8, 0xFF)], [(65, 90), (0xC0, 0xD6), (0xD8, 0xDE)], [(48, 57)], [(32, 32)]]
    for k, own in enumerate(ranges):
        for a, b in own:
            table[a : b + 1] = k
    table[[ord(c) for c in "\n\r\t"]] = 4
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    table[ord("|")] = 6
    table[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
    return table


TABLE = class_table()
KINDS = len(CLASSES) + 1


def class_counts(texts: list[str]) -> np.ndarray:
    """Counts by text and class."""
    points, offsets = K.code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = np.bincount(owner * KINDS + TABLE[points], minlength=len(texts) * KINDS).reshape(len(texts), KINDS)
    out[:, 4] -= 1  # the line end after each text
    return out


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of this partition: characters by class, words by word."""
    chars: dict[str | None, np.ndarray] = {}
    words: dict[str | None, dict[int, list]] = {}
    for batch in K.pieces(batches):
        texts, langs = K.strings(batch.column("text")), batch.column("lang").to_pylist()
        for lo, hi in K.spans(texts):
            counts = class_counts(texts[lo:hi])
            t = K.Tokens(texts[lo:hi])
            names = sorted(set(langs[lo:hi]), key=str)
            number = {n: k for k, n in enumerate(names)}
            of = np.array([number[x] for x in langs[lo:hi]])
            for k, lang in enumerate(names):
                chars[lang] = chars.get(lang, 0) + counts[of == k].sum(axis=0)
                at = np.flatnonzero(of[t.owner()] == k)
                values, first, n = np.unique(t.hash[at], return_index=True, return_counts=True)
                own = words.setdefault(lang, {})
                for h, i, c in zip(values.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    if (entry := own.get(h)) is not None:
                        entry[1] += c
                    else:
                        own[h] = [t.word(i), c]
        if sum(map(len, words.values())) > 500_000:
            yield from rows(chars, words)
            chars, words = {}, {}
    yield from rows(chars, words)


def rows(chars: dict, words: dict) -> Iterator[pa.RecordBatch]:
    for lang, counts in chars.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * KINDS, type=pa.string()), pa.array(["char"] * KINDS, type=pa.string()), pa.array([str(k) for k in range(KINDS)], type=pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "kind", "key", "n"])
    for lang, own in words.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), type=pa.string()), pa.array(["word"] * len(own), type=pa.string()), pa.array([e[0] for e in own.values()], type=pa.string()), pa.array([e[1] for e in own.values()], type=pa.int64())], names=["lang", "kind", "key", "n"]
        )


class References:
    """By language: the shares of character classes; the common words' hashes, ascending, and the shares of them and of all other words."""

    def __init__(self, chars: dict, words: dict, totals: dict):
        self.chars, self.words = {}, {}
        for lang, own in chars.items():
            counts = np.array([own.get(str(k), 0) for k in range(KINDS)], dtype=float)
            self.chars[lang] = counts / max(1.0, counts.sum())
        for lang in chars:
            own = words.get(lang, {})
            hashes = K.Tokens(list(own)).hash if own else np.empty(0, dtype=np.uint64)
            order = np.argsort(hashes)
            counts = np.array(list(own.values()), dtype=float)[order] if own else np.empty(0)
            total = totals.get(lang, 0)
            self.words[lang] = (hashes[order], np.append(counts, total - counts.sum()) / max(1, total))


def learn(docs: DataFrame, common: int = COMMON) -> References:
    """References from all documents; an empty table has none.  What comes to the driver is KINDS + ``common`` numbers for each language.  Words that are equally frequent are common in the order of their letters.  Repeated rows count as often as they are there."""
    counted = checkpointed(docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(tally, "lang string, kind string, key string, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "key"))
    chars: dict = {}
    words: dict = {}
    for r in counted.where("kind = 'char'").collect():
        chars.setdefault(r["lang"], {})[r["key"]] = r["n"]
    for r in counted.where("kind = 'word'").withColumn("k", rank).where(F.col("k") <= common).collect():
        words.setdefault(r["lang"], {})[r["key"]] = r["n"]
    totals = {r["lang"]: r["n"] for r in counted.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return References(chars, words, totals)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (base 2) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


def measure(texts: list[str], langs: list[str | None], references: References) -> tuple[np.ndarray, ...]:
    """(characters, words, distance of characters, distance of words) of each text; a distance without counts is nan."""
    n_chars, n_words = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    by_chars, by_words = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    for lo, hi in K.spans(texts):
        counts = class_counts(texts[lo:hi])
        t = K.Tokens(texts[lo:hi])
        owner = t.owner()
        n_chars[lo:hi], n_words[lo:hi] = counts.sum(axis=1), np.diff(t.bounds)
        number = {n: k for k, n in enumerate(dict.fromkeys(langs[lo:hi]))}
        of = np.array([number[x] for x in langs[lo:hi]])
        for lang, k in number.items():
            own = np.flatnonzero(of == k)
            c = counts[own]
            ok = c.sum(axis=1) > 0
            if lang not in references.chars:
                continue
            by_chars[lo + own[ok]] = distance(c[ok] / c[ok].sum(axis=1, keepdims=True), references.chars[lang])
            hashes, share = references.words[lang]
            if not len(hashes):
                continue
            row = np.full(hi - lo, -1)
            row[own] = np.arange(len(own))
            at = np.flatnonzero(of[owner] == k)
            place = np.minimum(np.searchsorted(hashes, t.hash[at]), len(hashes) - 1)
            place[hashes[place] != t.hash[at]] = len(hashes)
            size = len(hashes) + 1
            w = np.bincount(row[owner[at]] * size + place, minlength=len(own) * size).reshape(len(own), size)
            ok = w.sum(axis=1) > 0
            by_words[lo + own[ok]] = distance(w[ok] / w[ok].sum(axis=1, keepdims=True), share)
    return n_chars, n_words, by_chars, by_words


def judge(docs: DataFrame, references: References, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_chars: float = MAX_CHARS_DISTANCE, max_words: float = MAX_WORDS_DISTANCE) -> DataFrame:
    """(doc_id, lang, chars, words, chars_distance, words_distance, verdict, keep) of every row.

    verdict: ``short`` (under a minimum length: not judged), ``unknown`` (a language without a reference), ``chars`` or ``words`` (too far from the reference; characters are looked at first), or
    ``ok``; all but ``chars`` and ``words`` are kept.  Null and empty texts are short, their distances null, as is the distance of words where there are none.  Rows without a language are compared to
    each other: null is a language of its own.  A distance that is just the largest one passes.  Texts are counted whole, however long.  A null doc_id stays null; further columns are ignored; repeated rows stay repeated; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches):
            n_chars, n_words, a, b = measure(K.strings(batch.column("text")), batch.column("lang").to_pylist(), sent.value)
            a, b = np.round(a, 6), np.round(b, 6)
            unknown = np.array([lang not in sent.value.chars for lang in batch.column("lang").to_pylist()], dtype=bool)
            verdict = np.where((n_chars < min_chars) | (n_words < min_words), "short", np.where(unknown, "unknown", np.where(a > max_chars, "chars", np.where(b > max_words, "words", "ok"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(n_chars), pa.array(n_words), pa.array(a, from_pandas=True), pa.array(b, from_pandas=True), pa.array(verdict.astype(object), type=pa.string()), pa.array((verdict != "chars") & (verdict != "words"))],
                names=["doc_id", "lang", "chars", "words", "chars_distance", "words_distance", "verdict", "keep"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, OUT)


def sql() -> str:
    """The same in DuckDB's SQL, from the texts alone."""
    kinds = list(CLASSES)
    count = lambda inside: f"length(regexp_replace(t, '[^{inside}]', '', 'g'))".replace("\\'", "''")
    escaped = {k: v.replace("'", "''").replace("\\\"", '"') for k, v in CLASSES.items()}
    cols = ", ".join(f"{count(escaped[k])} AS c{i}" for i, k in enumerate(kinds))
    rest = " - ".join(["length(t)", *(f"c{i}" for i in range(len(kinds)))])
    n = len(kinds)
    js = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END"
    sums = ", ".join(f"sum(c{i}) AS s{i}" for i in range(n + 1))
    chars = " + ".join(js(f"(c{i}::double / nullif(chars, 0))", f"(s{i}::double / s)") for i in range(n + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
a AS (SELECT *, length(t) AS chars, {cols} FROM d),
c AS (SELECT *, {rest} AS c{n} FROM a),
rc AS (SELECT lang, {sums}, greatest(1, sum(chars)) AS s FROM c GROUP BY lang),
w AS (SELECT r, lang, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS word FROM d),
wn AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
wt AS (SELECT lang, sum(n) AS total FROM wn GROUP BY lang),
common AS (SELECT lang, word, n FROM wn QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}),
bins AS (SELECT lang, word, n::double / total AS q FROM common JOIN wt USING (lang)
  UNION ALL SELECT lang, NULL, (total - (SELECT sum(n) FROM common x WHERE x.lang IS NOT DISTINCT FROM wt.lang))::double / total FROM wt),
own AS (SELECT r, count(*) AS words FROM w GROUP BY r),
got AS (SELECT w.r, c.word, count(*) AS n FROM w LEFT JOIN common c ON c.lang IS NOT DISTINCT FROM w.lang AND c.word = w.word GROUP BY ALL),
wd AS (SELECT r, sum({js("p", "q")}) AS x FROM (
  SELECT d.r, b.q, coalesce(g.n, 0)::double / o.words AS p FROM d JOIN own o USING (r) JOIN bins b ON b.lang IS NOT DISTINCT FROM d.lang
  LEFT JOIN got g ON g.r = d.r AND g.word IS NOT DISTINCT FROM b.word) GROUP BY r),
m AS (SELECT c.doc_id, c.lang, c.chars, coalesce(o.words, 0) AS words,
  CASE WHEN c.chars > 0 THEN round(sqrt(greatest(0, ({chars}) / 2)), 6) END AS chars_distance, round(sqrt(greatest(0, wd.x / 2)), 6) AS words_distance
  FROM c JOIN rc ON rc.lang IS NOT DISTINCT FROM c.lang LEFT JOIN own o USING (r) LEFT JOIN wd USING (r))
SELECT *, verdict IN ('ok', 'short') AS keep FROM (SELECT doc_id, lang, chars, words, chars_distance, words_distance, CASE WHEN chars < {MIN_CHARS} OR words < {MIN_WORDS} THEN 'short'
  WHEN chars_distance > {MAX_CHARS_DISTANCE} THEN 'chars' WHEN words_distance > {MAX_WORDS_DISTANCE} THEN 'words' ELSE 'ok' END AS verdict FROM m)
"""
