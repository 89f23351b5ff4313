"""Toxicity by a weighted finite-state pattern grammar.

A clause (what lies between punctuation marks or line ends) is read as a string of token classes.  Five transducers run over it in a cascade, each
rewriting symbols for the next: reported speech marks what follows a verb of saying, negation marks the next few tokens, target marks what stands
near a person addressed, threat recognises intent + violent verb + target, insult weighs insulting words by the marks they bear.  ``compose`` turns the cascade into
one deterministic table of (state, class) -> (state, weight); the weights along the path are the clause's score.  A lone insult scores under the
threshold, one aimed at somebody over it; negated or reported ones hardly count; so clauses decide, not words.

A document scores as its strongest clause, or as its plain insults together if they are frequent: the sum over the clauses that score as much as a plain insult, for every WORDS words.  Reported and negated
insults never add up, and a few insults in a long text don't either.

Which words insult is partly listed here and partly learnt from the labels: word beginnings that occur in many toxic documents and in hardly any
other.  Near copies (those that share one of KEYS minimum hashes) count once in that, or one copied document's words would look like evidence.  The sample of labelled rows is bounded by parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import kernel as K
from inkwell.sources.shared import checkpointed

#: Documents from this score on are rejected.
THRESHOLD = 1.0
#: Words over which plain insults add up.
WORDS_TOGETHER = 500
#: Minimum hashes by which near copies in the labelled sample are found.
KEYS = 8
#: Bounds of the labelled sample from which insulting words are learnt.
MAX_TOXIC, MAX_CLEAN = 5000, 10000
#: A learnt beginning has this many letters, is this many times as frequent in toxic documents as in others, and carries this much evidence (log likelihood ratio).
LETTERS, RATE, EVIDENCE = (3, 8), 50.0, 20.0

OTHER, INSULT, VIOLENT, TARGET, INTENT, NEGATION, REPORT = range(7)
CLASSES = ("other", "insult", "violent", "target", "intent", "negation", "report")
WORDS = {
    INSULT: "idiot idiots moron morons scum loser losers pathetic worthless disgusting stupid trash clown imbecile imbeciles vermin bastard bastards dumbass arschloch abschaum idioten connard connards salope imbécile crétin estúpido estúpida idiota basura pendejo",
    VIOLENT: "kill hurt murder destroy stab shoot strangle burn beat töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours u ya yourself they them he she him her these those du dich dir ihr euch tu te toi vous tú usted ustedes",
    INTENT: "will shall gonna going ll must should werde werden vais va voy",
    NEGATION: "not no never isn aren wasn don doesn nicht kein keine keinen pas jamais nunca ningún",
    REPORT: "said says say called calls wrote writes claimed claims quoted sagte sagt nannte dit appelle dijo dice llamó",
}

BARE, AIMED, THREAT, WEAK = 0.6, 1.2, 1.5, 0.25

Step = Callable[[int, str], tuple[int, str]]


def reporting() -> tuple[int, Step]:
    """From a verb of saying to the end of the clause, symbols are marked r."""
    return 0, lambda s, a: (1, a) if a == "report" else (s, a + "/r" if s and a != "other" else a)


def negating(reach: int = 3) -> tuple[int, Step]:
    """The ``reach`` symbols after a negation are marked n."""

    def step(s: int, a: str) -> tuple[int, str]:
        if a.split("/")[0] == "negation":
            return reach, a
        return max(0, s - 1), a + "/n" if s and a != "other" else a

    return 0, step


def targeting(reach: int = 5) -> tuple[int, Step]:
    """An insult up to ``reach`` symbols after a target is marked t; a target so close after an insult becomes a hit that makes good the difference.

    States: 0 nothing near; 1..reach: symbols left in which a target counts; beyond: the same for an insult, with its mark for weak ones.
    """

    def step(s: int, a: str) -> tuple[int, str]:
        kind, *marks = a.split("/")
        weak = bool({"r", "n"} & set(marks))
        if kind == "target":
            hit = s > reach
            return reach, ("late/w" if s > 2 * reach else "late") if hit else a
        if kind == "insult":
            if 0 < s <= reach:
                return s - 1, a + "/t"
            return (3 if weak else 2) * reach, a
        return (0 if s in (0, 1, reach + 1, 2 * reach + 1) else s - 1), a

    return 0, step


def threatening(reach: int = 3) -> tuple[int, Step]:
    """intent .. violent .. target, each within ``reach`` symbols of the one before, ends in a threat.

    States: 0; 1..reach after intent; reach+1..2*reach after intent and a violent verb, beyond that after weakened ones.
    """

    def step(s: int, a: str) -> tuple[int, str]:
        kind, *marks = a.split("/")
        weak = bool({"r", "n"} & set(marks))
        if kind == "intent":
            return reach, a
        if kind == "violent" and 0 < s <= reach:
            return (3 if weak else 2) * reach, a
        if kind in ("target", "late") and s > reach:
            return 0, "threat/w" if s > 2 * reach else "threat"
        return (0 if s in (0, 1, reach + 1, 2 * reach + 1) else s - 1), a

    return 0, step


def weight(symbol: str) -> float:
    """The insult transducer's last tape: a weight for each symbol."""
    kind, *marks = symbol.split("/")
    weak = WEAK if {"r", "n", "w"} & set(marks) else 1.0
    if kind == "insult":
        return weak * (AIMED if "t" in marks else BARE)
    return weak * {"late": AIMED - BARE, "threat": THREAT}.get(kind, 0.0)


def compose(*machines: tuple[int, Step]) -> tuple[np.ndarray, np.ndarray]:
    """The cascade as one table: next state and weight by (state, class); state 0 is the start.  Only reachable states are built."""
    start = tuple(m[0] for m in machines)
    number, todo, nexts, weights = {start: 0}, [start], [], []
    while todo:
        state, row, cost = todo.pop(0), [], []
        for symbol in CLASSES:
            new = []
            for (_, step), s in zip(machines, state, strict=True):
                s, symbol = step(s, symbol)
                new.append(s)
            key = tuple(new)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
            cost.append(weight(symbol))
        nexts.append(row)
        weights.append(cost)
    return np.array(nexts), np.array(weights)


GRAMMAR = compose(reporting(), negating(), targeting(), threatening())


def clause_score(classes: list[int]) -> float:
    nexts, weights = GRAMMAR
    state, total = 0, 0.0
    for c in classes:
        total += weights[state, c]
        state = nexts[state, c]
    return total


class Lexicon:
    """Token classes by hash: whole words, and beginnings of insulting words."""

    def __init__(self, beginnings: list[str] = ()):  # type: ignore[assignment]
        self.beginnings = sorted(beginnings)
        words = [(w, c) for c, text in WORDS.items() for w in text.split()]
        values, codes = K.Tokens([w for w, _ in words]).hash, np.array([c for _, c in words], dtype=np.int8)
        order = np.argsort(values)
        self.values, self.codes = values[order], codes[order]
        self.by_length = {n: np.sort(K.Tokens([b for b in self.beginnings if len(b) == n]).hash) for n in {len(b) for b in self.beginnings}}

    @staticmethod
    def among(own: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Where ``values`` are among the sorted ``own``."""
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(own >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(maybe[(values >> np.uint64(48)).view(np.int64)])
        place = np.minimum(np.searchsorted(own, values[at]), len(own) - 1)
        return at[own[place] == values[at]]

    def classes(self, t: K.Tokens) -> np.ndarray:
        out = np.zeros(len(t.hash), dtype=np.int8)
        up, down = K.powers(len(t.points))
        if self.by_length:
            sums = np.zeros(len(t.points) + 1, dtype=np.uint64)
            np.cumsum((t.points.astype(np.uint64) + np.uint64(1)) * up[: len(t.points)], out=sums[1:])
            for n, own in self.by_length.items():
                long = np.flatnonzero(t.end - t.start >= n)
                at = t.start[long]
                out[long[self.among(own, K.mix((sums[at + n] - sums[at]) * down[at]))]] = INSULT
        at = self.among(self.values, t.hash)
        out[at] = self.codes[np.searchsorted(self.values, t.hash[at])]
        return out


DELIMITER = np.zeros(0x110000, dtype=np.uint8)
DELIMITER[[ord(c) for c in ".,;:!?\n\r()[]{}|\"«»“”„…"]] = 1


def score(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of clauses that score) of each text."""
    totals, clauses = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    strongest, words = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for lo, hi in K.spans(texts):
        t = K.Tokens(texts[lo:hi])
        classes = lexicon.classes(t)
        words[lo:hi] = np.diff(t.bounds)
        heads = np.flatnonzero((classes == INSULT) | (classes == VIOLENT))
        if not len(heads):
            continue
        clause = np.cumsum(DELIMITER[t.points])[t.start]
        owner = np.searchsorted(t.bounds, heads, "right") - 1
        # a clause ends with its text: the line end between two texts counts as a delimiter
        for own, number in dict.fromkeys(zip(owner.tolist(), clause[heads].tolist(), strict=True)):
            a, b = np.searchsorted(clause, number, "left"), np.searchsorted(clause, number, "right")
            got = clause_score(classes[a:b].tolist())
            if got > 0:
                strongest[lo + own] = max(strongest[lo + own], got)
                totals[lo + own] += got if got >= BARE - 1e-9 else 0.0
                clauses[lo + own] += 1
    return np.round(np.maximum(strongest, totals / np.maximum(1.0, words / WORDS_TOGETHER)), 6), clauses


def features(batches: Iterator[pa.RecordBatch], letters: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many documents each word beginning occurs."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in K.pieces(batches):
        for text, toxic in zip(K.strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            found = set()
            for word in set(re.findall(r"[^\W\d_]+", text.lower())):
                found.update(word[:n] for n in range(letters[0], min(len(word), letters[1]) + 1))
            counts[not toxic].update(found)
    names = list(counts[0].keys())  # what occurs in no toxic document can't be evidence
    yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([counts[0][w] for w in names], type=pa.int64()), pa.array([counts[1][w] for w in names], type=pa.int64())], names=["feature", "toxic", "clean"])
    rest = [w for w in counts[1] if w not in counts[0]]
    yield pa.RecordBatch.from_arrays([pa.array(rest, type=pa.string()), pa.array([0] * len(rest), type=pa.int64()), pa.array([counts[1][w] for w in rest], type=pa.int64())], names=["feature", "toxic", "clean"])


def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimum hashes that near copies mostly share, in place of texts."""
    seeds = K.factors(KEYS)
    for batch in K.pieces(batches):
        texts = K.strings(batch.column("text"))
        keys = []
        for lo, hi in K.spans(texts):
            t = K.Tokens(texts[lo:hi])
            values, bounds, _ = K.grams(t.hash, t.bounds, 3)
            keys.append([K.segments(np.minimum, values * s, bounds, np.uint64(0)).view(np.int64) for s in seeds])
        columns = [pa.array(np.concatenate(c)) for c in zip(*keys, strict=True)] if keys else [pa.array([], type=pa.int64())] * KEYS
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), batch.column("toxic"), *columns], names=["id", "h", "toxic", *(f"k{k}" for k in range(KEYS))])


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, letters: tuple[int, int] = LETTERS, rate: float = RATE, evidence: float = EVIDENCE) -> Lexicon:
    """A lexicon from at most ``max_toxic`` + ``max_clean`` labelled documents, those with the smallest hashes of their ids.

    Null labels and ids are left out, repeated labels count once, as are ids with both labels; with too few labels nothing is learnt and the listed words remain.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    chosen = marked.where("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(max_toxic).unionByName(marked.where("toxic = 0").orderBy(F.xxhash64("id"), "id").limit(max_clean))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.xxhash64("text").alias("h"))
    sample = texts.join(F.broadcast(chosen), "id")  # bounded by the parameters
    once = checkpointed(sample.mapInArrow(families, "id bigint, h bigint, toxic int, " + ", ".join(f"k{k} bigint" for k in range(KEYS))))
    for k in range(KEYS):  # only hashes are shuffled
        once = once.dropDuplicates(["toxic", f"k{k}"])
    once = checkpointed(texts.join(F.broadcast(once.select("id", "h", "toxic").distinct()), ["id", "h"]).dropDuplicates(["id", "h"]).select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    counted = once.mapInArrow(lambda it: features(it, letters), "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n1 / (n1 + n0)
    a, b = F.col("toxic"), F.col("clean")
    both = a + b
    gain = a * F.log(a / both / share) + F.when(b > 0, b * F.log(b / both / (1 - share))).otherwise(0.0)
    strong = counted.where((a > 0) & (a / n1 >= rate * b / n0) & (gain >= evidence)).collect()  # a few words: what passes is strong evidence
    found = {r["feature"]: r["toxic"] for r in strong}
    chosen_words = set()
    for word in sorted(found, key=lambda w: (len(w), w)):
        if any(word.startswith(c) for c in chosen_words):
            continue
        while longer := [w for w in found if len(w) == len(word) + 1 and w.startswith(word) and found[w] >= 0.95 * found[word]]:
            word = max(longer, key=lambda w: (found[w], w))
        chosen_words.add(word)
    return Lexicon(sorted(chosen_words))


def judge(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, clauses, toxic) of every document, one row for each row.

    Null and empty texts, and texts of which no clause matches, score 0 and are not toxic.  Texts are read whole, however long.  A score that is just the threshold is toxic.  A null doc_id stays null; further columns are ignored; repeated rows
    stay repeated; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches):
            total, clauses = score(K.strings(batch.column("text")), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(clauses), pa.array(total >= threshold - 1e-9)], names=["doc_id", "score", "clauses", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, clauses bigint, toxic boolean")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic, with all their columns, whatever their names, in a narrow pass without a join.

    Rows are judged by their own texts, as in ``judge``: null and empty texts stay, repeated rows stay or go together, an empty table stays empty.
    """
    return K.keep(docs, lambda texts, batch: score(texts, lexicon)[0] < threshold - 1e-9)
