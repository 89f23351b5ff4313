"""Language identification by prediction by partial matching.

Each language has a context tree of order ORDER over the bytes of lower-cased text: how often each byte followed each context of up to ORDER bytes.  Its statistics are
frozen after training.  A byte's code length is that of an arithmetic coder under PPM method C: in the longest context that the tree has, the byte's share, or
an escape to the next shorter context, down to order -1, where all 256 bytes are alike.  A document's language is that of the shortest code.

Texts of every length are judged, on the evidence that they give: a code that is n bits shorter speaks for its language at odds of 2**n.  A text is rejected if another language's code is shorter than the declared one's by EVIDENCE bits and by
MARGIN bits a byte (a text that is foreign in part isn't), or if the best code is longer by EVIDENCE bits than MAX_BITS a byte.

Contexts and bytes are packed into integers, so the tree is a set of sorted arrays and a batch is coded in a few passes: each distinct
(context, byte) of a batch is looked up once for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import kernel as K

ORDER = 4
#: Bounds of the labelled sample: documents a language, and languages, those with the most documents.
DOCS_PER_LANGUAGE, LANGUAGES = 250, 200
#: Parts of the sample, each of which is judged by trees of the others.
FOLDS = 6
#: A document whose best code takes more bits a byte than this is in none of the languages.
MAX_BITS = 5.5
#: A declared language is overruled, and the document rejected, if another one's code is shorter by this many bits a byte.
MARGIN = 1.0
#: Bits that either decision takes at least, over the whole text.
EVIDENCE = 40.0

OUT = "doc_id bigint, declared string, language string, bits_per_byte double, margin double, keep boolean"


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from ``order`` on, it and the ``order`` bytes before it in one integer, the byte itself lowest."""
    out = np.zeros(len(data) - order, dtype=np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | data[k : len(data) - order + k].astype(np.uint64)
    return out


def padded(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): the packed bytes of each lower-cased text, which starts after ``order`` line ends."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    gap = b"\n" * order
    data = np.frombuffer(gap + gap.join(encoded), dtype=np.uint8)
    sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    codes = packed(data, order)
    ends = np.cumsum(sizes + order) - order
    inside = np.ones(len(codes), dtype=bool)  # but for the gaps' own bytes
    for k in range(order):
        inside[ends[:-1] + k] = False
    return codes[inside], np.concatenate([[0], np.cumsum(sizes)])


class Tree:
    """Frozen statistics of one language."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        codes, _ = padded(texts, order)
        self.levels = []
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            grams, counts = np.unique(codes & mask, return_counts=True)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else counts
            distinct = np.diff(np.append(first, len(grams)))
            whole = (total + distinct).astype(float)
            of = np.repeat(np.arange(len(contexts)), distinct)
            self.levels.append((mask, grams, -np.log2(counts / whole[of]), contexts, -np.log2(distinct / whole)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of each packed (context, byte)."""
        cost, todo = np.zeros(len(codes)), np.arange(len(codes))
        for mask, grams, share, contexts, escape in reversed(self.levels):
            if not len(todo) or not len(contexts):
                break
            own = codes[todo] & mask
            context = own >> np.uint64(8)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[c] == context
            g = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            seen = known & (grams[g] == own)
            cost[todo[seen]] += share[g[seen]]
            fell = known & ~seen
            cost[todo[fell]] += escape[c[fell]]
            todo = todo[~seen]
        cost[todo] += 8.0
        return cost


def families(texts: list[str]) -> np.ndarray:
    """A number for each text; near copies (a quarter of 16 minimum hashes of word triples in common), and near copies of those, have the same."""
    tokens = K.Tokens(texts)
    grams, bounds, _ = K.grams(tokens.hash, tokens.bounds, 3)
    least = np.stack([K.segments(np.minimum, K.mix(grams ^ f), bounds, np.iinfo(np.uint64).max) for f in K.factors(16)], axis=1)
    out = np.arange(len(texts))
    for i in range(len(texts)):
        alike = np.flatnonzero((least[:i] == least[i]).sum(axis=1) >= 4)
        for j in np.unique(out[alike]):
            out[out == j] = out[i]
    return out


def purged(spark: SparkSession, sample: pd.DataFrame, order: int, max_bits: float, margin: float) -> pd.DataFrame:
    """``sample`` (lang, text) without the texts that aren't in the language that they declare.

    A text is judged by trees of other folds than its own; copies and near copies are in one fold.  It goes if another language codes it better, and as well (within ``margin``) as that
    language's own texts, or if no language codes it in ``max_bits`` while the declared one's texts mostly are.  This is repeated, with trees of what is left, until nothing goes.
    """
    sample = sample.sort_values(["lang", "text"], ignore_index=True)
    sample["fold"] = np.concatenate([np.unique(families(list(own)), return_inverse=True)[1] for _, own in sample.groupby("lang")["text"]]) % FOLDS
    sample["fold"] = sample.groupby("text")["fold"].transform("min")  # the same text in two languages
    names = sorted(sample["lang"].unique())
    while True:
        sent = spark.sparkContext.broadcast((sample["lang"].to_numpy(), sample["text"].to_numpy(), sample["fold"].to_numpy()))

        def judged(fold: int) -> tuple[np.ndarray, np.ndarray]:
            lang, text, folds = sent.value  # noqa: B023
            trees = {n: Tree(list(text[(lang == n) & (folds != fold)]), order) for n in names}
            own = np.flatnonzero(folds == fold)
            bits, sizes = code_lengths(list(text[own]), trees)
            return own, bits / np.maximum(sizes, 1)[:, None]

        each = np.zeros((len(sample), len(names)))
        for own, found in spark.sparkContext.parallelize(range(FOLDS), FOLDS).map(judged).collect():
            each[own] = found
        sent.destroy()
        said = np.searchsorted(names, sample["lang"])
        declared = each[np.arange(len(sample)), said]
        usual = np.array([np.median(declared[said == k]) if (said == k).any() else 8.0 for k in range(len(names))])
        best = each.argmin(axis=1)
        low = each[np.arange(len(sample)), best]
        gone = (low < declared) & (low <= usual[best] + margin) & (low <= max_bits) | (low > max_bits) & (usual[said] <= max_bits)
        if not gone.any():
            return sample
        sample = sample[~gone].reset_index(drop=True)


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER, max_bits: float = MAX_BITS, margin: float = MARGIN, languages: int = LANGUAGES) -> dict[str, Tree]:
    """A tree for each language that ``docs`` declares (the ``languages`` most frequent ones), from at most ``per_language`` documents each: those with the smallest hashes of their texts.

    Null languages and null or empty texts are left out, and copies count once; texts of any other length are taken whole.  Texts that are falsely declared, by the other texts, are taken out; a language of which none is left has an
    empty tree.  No documents give no trees.
    """
    hashed = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h")).where("lang IS NOT NULL AND text <> ''")
    # hashes alone are ranked, and the rank limit is applied before their shuffle too; then the few texts are picked within the scan
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    frequent = hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    smallest = hashed.select("lang", "h").withColumn("k", rank).where(F.col("k") <= per_language).select("lang", "h").distinct().join(F.broadcast(frequent), "lang")
    chosen = hashed.join(F.broadcast(smallest), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text").toPandas()  # bounded by the parameters
    left = purged(docs.sparkSession, chosen, order, max_bits, margin) if len(chosen) else chosen
    return {lang: Tree(sorted(left.loc[left["lang"] == lang, "text"]), order) for lang in sorted(chosen["lang"].unique())}


def code_lengths(texts: list[str], trees: dict[str, Tree]) -> tuple[np.ndarray, np.ndarray]:
    """(bits by text and language, bytes by text)."""
    bits, sizes = np.zeros((len(texts), len(trees))), np.zeros(len(texts), dtype=np.int64)
    order = next(iter(trees.values())).order if trees else ORDER
    for lo, hi in K.spans(texts):
        codes, bounds = padded(texts[lo:hi], order)
        sizes[lo:hi] = np.diff(bounds)
        which, values = pd.factorize(codes)
        by = np.argsort(values)
        for j, tree in enumerate(trees.values()):
            cost = np.empty(len(values))
            cost[by] = tree.bits(values[by])
            bits[lo:hi, j] = K.segments(np.add, cost[which], bounds, 0.0)
    return bits, sizes


def decide(texts: list[str], declared: list[str | None], trees: dict[str, Tree], max_bits: float = MAX_BITS, margin: float = MARGIN, evidence: float = EVIDENCE) -> dict[str, np.ndarray]:
    """By text: the language, bits a byte of its code, by how much the next language's code is longer, and whether the text is rejected."""
    names = np.array(list(trees), dtype=object)
    bits, sizes = code_lengths(texts, trees)
    if not len(names):
        none = np.full(len(texts), None, dtype=object)
        return {"language": none, "bits_per_byte": np.full(len(texts), np.nan), "margin": np.full(len(texts), np.nan), "rejected": np.zeros(len(texts), dtype=bool)}
    each = bits / np.maximum(sizes, 1)[:, None]
    best = each.argmin(axis=1)  # ties: the first in the order of names
    low = each[np.arange(len(texts)), best]
    own = {n: j for j, n in enumerate(names)}
    said = np.array([own.get(d, -1) for d in declared], dtype=np.int64)
    over = np.where(said >= 0, each[np.arange(len(texts)), said] - low, 0.0)
    rest = np.partition(each, 1, axis=1)[:, 1] - low if len(names) > 1 else np.zeros(len(texts))
    language = names[best]
    language[sizes == 0] = None
    foreign = over * sizes > np.maximum(evidence, margin * sizes)
    rejected = foreign | (low * sizes > max_bits * sizes + evidence)
    return {"language": language, "bits_per_byte": np.round(low, 6), "margin": np.round(rest, 6), "rejected": rejected}


def identify(docs: DataFrame, trees: dict[str, Tree], max_bits: float = MAX_BITS, margin: float = MARGIN, evidence: float = EVIDENCE) -> DataFrame:
    """(doc_id, declared, language, bits_per_byte, margin, keep) of every row.

    Not kept: no language codes the text well (its bits are over ``max_bits`` a byte and ``evidence``), or another language than the declared one does so much better (by more than ``margin`` bits
    a byte and ``evidence`` bits in all).  Null and empty texts have no language and 0 bits, and stay; long ones are coded whole.  A null or unknown declared language isn't
    held against a text.  Without trees, languages and figures are null.  Ties go to the first language by name.  A null doc_id stays null, repeated rows stay repeated, further columns are ignored, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches):
            declared = batch.column("declared")
            got = decide(K.strings(batch.column("text")), declared.to_pylist(), sent.value, max_bits, margin, evidence)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), declared, pa.array(got["language"], type=pa.string()), pa.array(got["bits_per_byte"], from_pandas=True), pa.array(got["margin"], from_pandas=True), pa.array(~got["rejected"])],
                names=["doc_id", "declared", "language", "bits_per_byte", "margin", "keep"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("declared"), "text").mapInArrow(run, OUT)


def clean(docs: DataFrame, trees: dict[str, Tree], max_bits: float = MAX_BITS, margin: float = MARGIN, evidence: float = EVIDENCE) -> DataFrame:
    """The documents that ``identify`` doesn't reject, with all their columns, whatever their names, in a narrow pass.

    Rows are judged by their own texts: null and empty ones stay, repeated rows stay or go together, an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    return K.keep(docs, lambda texts, batch: ~decide(texts, batch.column("lang").to_pylist(), sent.value, max_bits, margin, evidence)["rejected"])
