"""Each operator against brute force, an exact round trip, or what is known of the data."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, language, licenses, ngram_join, quality, queries, suffix_tree, tiling, token_counts, toxicity, url_filter
from inkwell.llm import kernel as K
from inkwell.sources.shared import scratch

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def prose(seed, n, syllables=("ka", "lo", "mi", "ter", "un", "sa", "vor", "el")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "xx"), "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def near(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else "zz" + str(r.randint(0, 999)) for w in text.split())


# kernel


def test_tokens_and_grams():
    texts = ["It's 3 o'clock, MÜLLER!", "", "a b", "one two three four", "x" * 5000 + " y", "a_b ²x"]
    t = K.Tokens(texts)
    got = [[t.word(i) for i in range(a, b)] for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
    assert got == [words_of(x) for x in texts]
    single = {w: int(K.Tokens([w]).hash[0]) for ws in got for w in ws}
    assert t.hash.tolist() == [single[w] for ws in got for w in ws] and len(set(single.values())) == len(single)
    values, bounds, first = K.grams(t.hash, t.bounds, 3)
    assert np.diff(bounds).tolist() == [len(w) - 2 if len(w) > 2 else min(1, len(w)) for w in got]
    assert int(values[bounds[2]]) == K.gram_of([single["a"], single["b"]], 3)
    assert np.diff(K.grams(t.hash, t.bounds, 3, short=False)[1]).tolist() == [max(0, len(w) - 2) for w in got]
    assert [list(s) for s in (K.spans(["a" * 5] * 3, 10))] == [[0, 2], [2, 3]]
    own, b = K.sets(np.array([3, 1, 3, 2, 2], dtype=np.uint64), np.array([0, 3, 3, 5]))
    assert own.tolist() == [1, 3, 2] and b.tolist() == [0, 2, 2, 3]


# 9


def brute_pairs(texts, n=3, threshold=0.5):
    sets = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        if w:
            sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    rep, out = {}, set()
    for i, s in sets.items():
        if s in rep:
            out.add((rep[s], i, 1.0))
        else:
            rep[s] = i
    for a in rep.values():
        for b in rep.values():
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
                out.add((a, b, round(j, 6)))
    return out


def copies():
    shared = prose(999, 70)
    texts = [prose(k, 40 + 12 * k) for k in range(12)]
    texts += [near(texts[k % 12], 100 + k, 0.01 * (k % 9)) for k in range(60)]
    texts += [texts[3]] * 3 + [texts[5].upper()] + [prose(500 + k, 30) + " " + shared for k in range(10)]
    return texts + ["a b", "A, b!", "a", "", None, "...", "b a"]


def gram_sets(texts):
    t = K.Tokens([x or "" for x in texts])
    values, bounds = K.sets(*K.grams(t.hash, t.bounds, 3)[:2])
    return [values[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]


def test_t_occurrence_finds_all_pairs():
    sets = gram_sets(copies())
    for threshold in (0.3, 0.5, 0.8, 1.0):
        found = [(q, int(o), int(n)) for q, others, overlaps in ngram_join.matches(sets, threshold) for o, n in zip(others, overlaps, strict=True)]
        expected = {}
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-12:
                    expected[frozenset((a, b))] = both
        assert {frozenset((a, b)): n for a, b, n in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("window", [1, 7, 256])
def test_merge_by_a_heap(window):
    r = random.Random(window)
    for _ in range(200):
        width = r.choice([20, 400])
        lists = [sorted(r.sample(range(width), r.randint(1, r.choice([3, 20])))) for _ in range(r.randint(1, 12))]
        keys = np.array([k * 1000 + x for k, own in enumerate(lists) for x in own])
        end = np.cumsum([len(x) for x in lists])
        first = end - np.array([len(x) for x in lists])
        counted = Counter(x for own in lists for x in own)
        for need in (1, 2, 5, len(lists)):
            values, times = ngram_join.merge_skip(keys, first, np.arange(len(lists)), end, 1000, need, window)
            assert list(zip(values.tolist(), times.tolist(), strict=True)) == sorted((x, n) for x, n in counted.items() if n >= need)


def brute_classes(texts, ids=None):
    """(doc_id, class_id, links) of every text."""
    ids = ids or list(range(len(texts)))
    sets = [frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if (w := words_of(t)) else None for t in texts]
    near_ones = [[j for j, b in enumerate(sets) if a and b and i != j and len(a & b) >= 0.5 * len(a | b)] for i, a in enumerate(sets)]
    least = list(ids)
    while True:
        new = [min([least[i], *(least[j] for j in near_ones[i])]) for i in range(len(texts))]
        if new == least:
            return {(i, c, len(n)) for i, c, n in zip(ids, least, near_ones, strict=True)}
        least = new


@pytest.mark.parametrize("part", [ngram_join.PART, 700])
def test_join(spark, part):
    texts = copies()
    expected = brute_classes(texts)
    assert sum(n for _, _, n in expected) > 200
    rows = [tuple(r) for r in ngram_join.join(table(spark, texts), part=part).collect()]
    assert set(rows) == expected and len(rows) == len(texts)


def test_recall_at_the_threshold(spark):
    # pairs of nothing but a similarity of 0.5 to 0.6, which bands miss most easily
    texts = []
    for k in range(400):
        words = prose(9000 + k, 120).split()
        texts += [" ".join(words), " ".join(words[: 81 + k % 8] + prose(19000 + k, 0 if k % 2 else 3).split())]
    expected = brute_pairs(texts)
    near_threshold = {(a, b) for a, b, j in expected if j < 0.75}
    got = {r["doc_id"] for r in ngram_join.join(table(spark, texts)).where("links > 0").collect()}
    assert len(near_threshold) >= 390 and len([p for p in near_threshold if p[0] in got]) >= 0.99 * len(near_threshold)


def test_no_pair_at_the_threshold_is_left_out(spark):
    # eight words each, the first six the same: 4 grams of 8, a similarity of exactly 0.5
    words = lambda k, own: " ".join([f"w{k}x{i}" for i in range(6)] + [f"{own}{k}y", f"{own}{k}z"])
    texts = [words(k, own) for k in range(2000) for own in "ab"]
    rows = [tuple(r) for r in ngram_join.join(table(spark, texts)).collect()]
    assert sorted(rows) == [(i, i - i % 2, 1) for i in range(len(texts))]


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.8, 1.0])
def test_join_at_other_thresholds(spark, threshold):
    texts = copies() + [" ".join(prose(k, 400) for k in range(500, 505))]  # and one that is much longer
    expected = brute_pairs(texts, threshold=threshold)
    sets = {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.join(table(spark, texts), threshold, part=700, share=500).collect()}
    grams = [frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if (w := words_of(t)) else None for t in texts]
    links = [sum(1 for j, b in enumerate(grams) if a and b and i != j and len(a & b) >= threshold * len(a | b)) for i, a in enumerate(grams)]
    assert expected and [sets[i][1] for i in range(len(texts))] == links
    assert all(sets[a][0] == sets[b][0] for a, b, _ in expected)


def test_no_task_is_larger_than_two_parts(spark):
    texts = [near(prose(1, 100), k, 0.02) for k in range(300)]
    docs, sizes = table(spark, texts), []
    original = ngram_join.search
    seen = spark.sparkContext.accumulator(0)

    def counted(block, threshold):
        seen.add(int(len(block) > 80))
        return original(block, threshold)

    ngram_join.search = counted
    try:
        signed, found = ngram_join.related(docs, part=3000)  # about 30 texts
        sizes = found.collect()
    finally:
        ngram_join.search = original
    assert sizes and seen.value == 0


def test_one_of_each(spark):
    texts = copies()
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in brute_pairs(texts):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = sorted(i for i in range(len(texts)) if root(i) == i)
    kept = ngram_join.one_of_each(table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_groups_of_long_chains(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in ngram_join.groups(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 102: 100}


# 5


def brute_tiles(item, doc, match):
    used_i, used_d, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = 0
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not used_i[i + k] and not used_d[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if best < match:
            return total
        for k in range(best):
            used_i[at[0] + k] = used_d[at[1] + k] = True
        total += best


def test_tiles_cover_what_brute_force_covers():
    r = random.Random(5)
    for case in range(150):
        item = [r.randint(0, 4 if case % 2 else 30) for _ in range(r.randint(4, 25))]
        cut = sorted(r.sample(range(len(item) + 1), 2))
        doc = [r.randint(0, 30) for _ in range(8)] + item[cut[1] :] + [99] + item[cut[0] : cut[1]] + [r.randint(0, 30) for _ in range(5)] + item[: cut[0]]
        places = [j for j in range(len(doc) - 3) if any(item[i : i + 4] == doc[j : j + 4] for i in range(len(item) - 3))]
        tiles = tiling.tile(item, doc, places, 4)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in tiles) and [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)
        assert sum(t[2] for t in tiles) == brute_tiles(item, doc, 4)


def test_leaks(spark):
    items = [prose(k, 30) for k in range(5)] + ["too short", None, ""]
    w = items[0].split()
    turned = " ".join(w[20:] + ["x"] + w[10:20] + ["y"] + w[:10])
    texts = [prose(77, 50), prose(78, 20) + " " + items[1] + " " + prose(79, 20), turned, " ".join(items[2].split()[:16]), " ".join(items[3].split()[:13]), None, "", items[4].upper().replace(" ", ", ")]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = table(spark, texts)
    expected = set()
    for i, item in enumerate(items):
        for d, text in enumerate(texts):
            a, b = words_of(item), words_of(text)
            if len(a) >= 4 and (c := brute_tiles(a, b, 4)) >= 0.5 * len(a):
                expected.add((d, i, round(c / len(a), 6)))
    assert {d for d, _, _ in expected} == {1, 2, 3, 7}
    for size in (1 << 20, 40):  # one slice, and many
        got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.leaks(docs, benchmark, slice_chars=size).collect()}
        assert got == expected
        assert sorted(r["doc_id"] for r in tiling.clean(docs, benchmark, slice_chars=size).collect()) == [0, 4, 5, 6]
    assert tiling.leaks(docs, benchmark.where("false")).count() == 0


# 2


def test_grammar():
    lexicon = toxicity.Lexicon()
    score = lambda t: toxicity.score([t], lexicon)[0][0]
    assert score("you are an idiot") == 1.2 and score("idiot, you see") == 0.6 and score("what an idiot you are") == 1.2
    assert score("he is not an idiot") == 0.3 and score("an idiot said so") == 0.6 and score("they said you are an idiot") == 0.3
    assert score("i will kill you") == 1.5 and score("kill the lights") == 0 and score("they said i will kill you") == 0.375
    assert score("an idiot here. some scum there") == 1.2 and score("") == 0 and score("nice weather") == 0
    assert score("You IDIOT!") == 1.2 and score("idiotic") == 0
    many = toxicity.score(["idiot", "you idiot", "x", "kill"], lexicon)
    assert many[0].tolist() == [0.6, 1.2, 0, 0] and many[1].tolist() == [1, 1, 0, 0]


def by_rules(classes):
    """A clause's score from what the grammar says, by looking back from each token: no states and no marks."""
    names = ["other", "insult", "violent", "target", "intent", "negation", "report"]
    kinds = [names[c] for c in classes]
    reported = kinds.index("report") if "report" in kinds else len(kinds)
    weak = [i > reported or (k != "negation" and "negation" in kinds[max(0, i - 3) : i]) for i, k in enumerate(kinds)]
    near = None  # the target, or the insult at nobody, that was last: (place, kind)
    armed = None  # the intent, or the violent verb after one: (place, kind)
    total = 0.0
    for i, k in enumerate(kinds):
        if k == "insult":
            aimed = near is not None and near[1] == "target" and i - near[0] <= 5
            total += (1.2 if aimed else 0.6) * (0.25 if weak[i] else 1)
            near = near if aimed else (i, "insult")
        elif k == "intent":
            armed = (i, "intent")
        elif k == "violent" and armed and armed[1] == "intent" and i - armed[0] <= 3:
            armed = (i, "violent")
        elif k == "target":
            if armed and armed[1] == "violent" and i - armed[0] <= 3:
                total += 1.5 * (0.25 if weak[armed[0]] else 1)
                armed = None
            elif near is not None and near[1] == "insult" and i - near[0] <= 5:
                total += 0.6 * (0.25 if weak[near[0]] else 1)
            near = (i, "target")
    return total


def test_grammar_by_its_rules():
    r = random.Random(1)
    for _ in range(3000):
        classes = [r.choice([0, 0, *range(7)]) for _ in range(r.randint(0, 14))]
        assert toxicity.clause_score(classes) == pytest.approx(by_rules(classes)), classes


def test_isolated_and_reported_insults_do_not_add_up():
    lexicon = toxicity.Lexicon()
    score = lambda t: toxicity.score([t], lexicon)[0][0]
    assert score("He said she was a moron. " * 4) == 0.3 and score("They are not idiots. " * 9) == 0.3
    long = prose(1, 20_000)
    assert score(f"What trash. {long}. The clown laughed.") == 0.6 and score(f"{long}. You idiot.") == 1.2
    assert score(". ".join(f"{prose(k, 40)} clown {prose(k, 30)}" for k in range(50))) > 1  # one in 70 words, in a text of any length


def test_what_is_learnt_from_one_half_of_the_labels_judges_the_other(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    lexicon = toxicity.learn(docs, labels.where(half == 0))
    other = toxicity.judge(docs, lexicon).join(labels.where(half == 1).select("doc_id", F.col("toxic").alias("labelled")), "doc_id").collect()
    caught, clean = [r["toxic"] for r in other if r["labelled"] == 1], [r["toxic"] for r in other if r["labelled"] == 0]
    assert sum(caught) >= 0.6 * len(caught) and sum(clean) <= 0.01 * len(clean) and len(caught) > 10


def test_learnt_insults(spark):
    r = random.Random(3)
    texts, labels = [], []
    for k in range(240):
        words = prose(k, 60).split()
        if k % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(60), "grub" + r.choice(["el", "ter", "vor"]))
        texts.append(" ".join(words))
        labels.append((k, 1, int(k % 4 == 0)))
    # many near copies of one toxic document must not teach its other words
    texts += [near(texts[0], k, 0.02) + " odd peculiar" for k in range(40)]
    labels += [(240 + k, 1, 1) for k in range(40)]
    docs, marks = table(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.learn(docs, marks)
    assert lexicon.beginnings and all(b.startswith("gru") for b in lexicon.beginnings)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.judge(docs, lexicon).collect()}
    assert all(got[k] == bool(t) for k, _, t in labels)
    assert toxicity.clean(docs, lexicon).count() == 180
    assert toxicity.learn(docs, marks.where("false")).beginnings == []


# 3


def test_merges_against_a_library():
    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        content = f.read()
    own = bpe.Codec(content)
    other = tiktoken.Encoding("o", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = ["Hello  world, it's 42 o'clock!\n\n", "naïve café ☕ 日本語", "a" * 3000, "  leading", "<|endoftext|>", "", "\x00\t\r\n ", prose(1, 300), "aaaabbbbaaaabbbb" * 9]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t) and own.decode(ids) == t


def naive_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_against_brute_force():
    r = random.Random(2)
    ranks = {bytes([c]): c for c in range(97, 101)}
    for k in range(60):
        a, b = r.choice(list(ranks)), r.choice(list(ranks))
        ranks.setdefault(a + b, 200 + k)
    for _ in range(300):
        piece = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 40)))
        assert bpe.merge(piece, ranks) == ([ranks[piece]] if piece in ranks else naive_merge(piece, ranks))


def test_a_vocabulary_without_all_bytes_is_refused():
    with open(bpe.VOCABULARY, "rb") as f:
        lines = f.read().splitlines()
    with pytest.raises(ValueError, match="lacks the bytes"):
        bpe.Codec(b"\n".join(lines[:100] + lines[101:]))


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    with open(bpe.VOCABULARY, "rb") as f:
        own = bpe.Codec(f.read())
    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    for k in range(50):
        text = f"{prose(k, 20)} {'long' * 500}"
        assert own.decode(own.encode(text)) == text and own.held <= 3000 + 20_000


def test_round_trip(spark):
    texts = ["Some text, twice.", "Some text, twice.", None, "", "ünï " * 50]
    encoded = bpe.encode(table(spark, texts))
    assert all(r["exact"] and r["n_tokens"] == len(r["token_ids"]) for r in encoded.collect())
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}


# 4


def test_states_grow_with_the_corpus(spark, tmp_path):
    rare = "qu wyx zqj " * 3
    for k, size in enumerate((2, 60)):
        rows = [(i, t) for i, t in enumerate([rare, rare, *(prose(j, 3000) for j in range(size))])]
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
    few, many = ({r["doc_id"]: r["bits_per_symbol"] for r in queries.op4_lm_scoring(spark, f"{tmp_path}/{k}").collect()} for k in (0, 1))
    assert few[0] < 1 and many[0] < few[0] + 0.2  # contexts that occur a few times are states in a corpus of any size


def test_other_scripts_are_told_apart(spark, tmp_path):
    words = ["привет", "собака", "молоко", "дорога", "окошко", "берега"]
    r = random.Random(5)
    usual = [" ".join(r.choice(words) for _ in range(80)) for _ in range(40)]
    letters = sorted(set("".join(words)))
    junk = " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(80))
    spark.createDataFrame(list(enumerate([*usual, junk])), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["bits_per_symbol"] for r in queries.op4_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[40] > 2 * max(got[i] for i in range(40))


@pytest.mark.parametrize("depth", [3, 5, 7])
@pytest.mark.parametrize("slice_chars", [300, 10**6])
def test_whole_tree_against_brute_force(spark, slice_chars, depth):
    texts = [prose(k, 60) for k in range(6)] + ["", None, "Ünïcode: 12 ☕\tx\n", prose(0, 60)]
    symbols = [list((t or "").lower().encode()) for t in texts]
    contexts = {}
    for s in symbols:
        padded = [10] * depth + s
        for i in range(len(s)):
            for k in range(depth + 1):
                contexts.setdefault(tuple(padded[i + depth - k : i + depth]), Counter())[s[i]] += 1
    states = {()}
    for context, following in contexts.items():
        if context and (n := sum(following.values())) >= 3:
            up = contexts[context[1:]]
            if sum(c / n * math.log2(c / n * sum(up.values()) / up[s]) for s, c in following.items()) >= 0.1:
                states.add(context)
    got = {r["doc_id"]: r for r in suffix_tree.score_all(table(spark, texts), depth, min_count=3, min_bits=0.1, floor=1e-3, slice_chars=slice_chars, part_rows=500).collect()}
    assert len(got) == len(texts) and len(states) > 50
    for i, s in enumerate(symbols):
        padded, expected = [10] * depth + s, 0.0
        for j in range(len(s)):
            own = next(c for k in range(depth, -1, -1) if (c := tuple(padded[j + depth - k : j + depth])) in states)
            expected -= math.log2((1 - 256 * 1e-3) * contexts[own][s[j]] / sum(contexts[own].values()) + 1e-3)
        assert got[i]["bits"] == pytest.approx(expected, rel=1e-5, abs=1e-3) and got[i]["symbols"] == len((texts[i] or "").lower())
        assert (got[i]["bits_per_symbol"] is None) == (not s)


# 7


def brute_bits(train, text, order):
    counts = {}
    for t in train:
        data = b"\n" * order + t.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, bits = b"\n" * order + text.lower().encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            if (own := counts.get(data[i - k : i])) is None:
                continue
            whole = sum(own.values()) + len(own)
            if data[i] in own:
                bits -= math.log2(own[data[i]] / whole)
                break
            bits -= math.log2(len(own) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force():
    train = {"x": [prose(k, 40) for k in range(3)], "y": [prose(k, 40, ("ché", "ou", "ß", "ri")) for k in range(3)]}
    trees = {n: language.Tree(t, 3) for n, t in train.items()}
    texts = [prose(50, 30), "", "Été ☕ 42", prose(51, 30, ("ché", "ou")), "\n\n", "a"]
    bits, sizes = language.code_lengths(texts, trees)
    for i, t in enumerate(texts):
        assert sizes[i] == len(t.lower().encode())
        assert bits[i].tolist() == pytest.approx([brute_bits(v, t, 3) for v in train.values()], rel=1e-9)


def test_held_out_languages(spark):
    kinds = {"aa": ("ka", "lo", "mi", "ter"), "bb": ("ché", "ou", "ri", "eau"), "cc": ("sch", "un", "ge", "tz")}
    texts, langs = [], {}
    for n, (lang, syllables) in enumerate(kinds.items()):
        for k in range(30):
            langs[len(texts)] = lang
            texts.append(prose(1000 * n + k, 80, syllables))
    docs = table(spark, texts, langs)
    held_out = F.col("doc_id") % 3 == 0
    trees = language.train(docs.where(~held_out), per_language=15)
    assert sorted(trees) == list(kinds)
    rows = language.identify(docs.where(held_out), trees).collect()
    assert all(r["language"] == r["declared"] and r["keep"] and r["margin"] > 1 for r in rows) and len(rows) == 30
    odd = table(spark, [texts[0], "".join(chr(0x4E00 + (k * 37) % 900) for k in range(300)), "ok", None], {0: "bb", 1: "aa", 2: "aa", 3: "aa"})
    assert {r["doc_id"]: r["keep"] for r in language.identify(odd, trees).collect()} == {0: False, 1: False, 2: True, 3: True}
    assert sorted(r["doc_id"] for r in language.clean(odd, trees).collect()) == [2, 3]
    assert all(r["language"] is None and r["keep"] for r in language.identify(odd, {}).collect())


def test_decisions_against_brute_force():
    kinds = {"aa": ("ka", "lo", "mi", "ter"), "bb": ("ché", "ou", "ri", "eau"), "cc": ("sch", "un", "ge", "tz")}
    train = {n: [prose(1000 + k, 60, s) for k in range(6)] for n, s in kinds.items()}
    trees = {n: language.Tree(t, 3) for n, t in train.items()}
    texts, declared = ["", "ok", "ka", "☕☕"], ["aa", "aa", "bb", "aa"]
    for size in (1, 2, 3, 5, 9, 60):
        for n, s in kinds.items():
            text = prose(size, size, s)
            mixed = text + " " + prose(size, size, kinds["aa"])
            for d in (*kinds, None, "zz"):
                texts += [text, mixed, "".join(chr(0x4E00 + (k * 37) % 900) for k in range(size))]
                declared += [d] * 3
    got = language.decide(texts, declared, trees)
    for i, (text, d) in enumerate(zip(texts, declared, strict=True)):
        bits = {n: brute_bits(t, text, 3) for n, t in train.items()}
        size, least = len(text.lower().encode()), min(bits.values())
        over = bits[d] - least if d in bits else 0.0
        assert got["language"][i] == (min(bits, key=bits.get) if size else None)
        assert bool(got["rejected"][i]) == (over > max(40.0, 1.0 * size) or least > 5.5 * size + 40.0), (text, d)
    assert 50 < got["rejected"].sum() < len(texts) - 50


def test_held_out_detection_at_every_length(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) >= 60")
    held_out = F.pmod(F.xxhash64("text"), F.lit(20)) == 0
    trees = language.train(rows.where(~held_out))
    texts = [(r["text"], r["lang"]) for r in rows.where(held_out).select("text", "lang").distinct().collect()]
    names = sorted(trees)
    for size, least in ((20, 0.9), (60, 0.97), (10**6, 0.97)):
        cut = [(t[:size], lang) for t, lang in texts]
        kept = ~language.decide([t for t, _ in cut], [lang for _, lang in cut], trees)["rejected"]
        caught = language.decide([t for t, _ in cut], [names[(names.index(lang) + 1) % len(names)] for _, lang in cut], trees)["rejected"]
        assert kept.mean() >= 0.99 and caught.mean() >= least, (size, kept.mean(), caught.mean())


def test_false_declarations_in_the_sample(spark):
    kinds = {"aa": ("ka", "lo", "mi", "ter"), "bb": ("ché", "ou", "ri", "eau")}
    texts, langs = [], {}
    for n, (lang, syllables) in enumerate(kinds.items()):
        for k in range(40):
            langs[len(texts)] = lang
            texts.append(prose(1000 * n + k, 80, syllables))
    false = [prose(5000 + k, 80, kinds["bb"]) for k in range(8)]  # in bb, declared aa
    false += [near(prose(6000, 80, kinds["bb"]), k, 0.05) for k in range(8)]  # near copies of one
    false += [texts[45]]  # a copy of one that is declared rightly
    false += [prose(7000 + k, 80, kinds["bb"]) for k in range(3)]  # all of language dd
    few = [prose(8000, 80, ("zho", "wiq", "nax", "upf"))]  # a language of its own
    for k in range(len(false)):
        langs[80 + k] = "dd" if k >= 17 else "aa"
    langs[80 + len(false)] = "ee"
    docs = table(spark, texts + false + few, langs)
    trees = language.train(docs)
    assert {r["doc_id"] for r in language.identify(docs, trees).collect() if not r["keep"]} == set(range(80, 80 + len(false)))


# 8


def test_counts_and_cache(spark):
    import regex

    texts = ["one two", " one two\r\n", "one two", None, "", "three\r\nfour", "three\nfour", "\x0b\tone two\f"] + ["said over and over"] * 3
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = bpe.read_ranks(f.read())

    def naive(text):
        pieces = regex.findall(bpe.PATTERN, (text or "").replace("\r\n", "\n").strip())
        return sum(len(naive_merge(p.encode(), ranks)) for p in pieces)

    rows = [(i, t) for i, t in enumerate(texts)] + [(70, "all alike")] * 200 + [(71, "all alike"), (None, "no id"), (None, "no id"), (72, "two texts, one id"), (72, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    cache = scratch(spark, "cache")
    expected = sorted((str(i), naive(t)) for i, t in rows)
    distinct = {(t or "").replace("\r\n", "\n").strip() for _, t in rows}
    got = token_counts.count(docs, cache).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == expected and not any(r["hit"] for r in got)
    assert spark.read.parquet(cache).count() == len(distinct)  # a row for each time that a text is encoded
    more = docs.unionByName(spark.createDataFrame([(99, "brand new"), (99, "brand new")], docs.schema))
    got = token_counts.count(more, cache).collect()
    assert all(r["hit"] == (r["doc_id"] != 99) for r in got) and len(got) == len(rows) + 2 and spark.read.parquet(cache).count() == len(distinct) + 1
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got if r["doc_id"] != 99) == expected
    got = token_counts.count(docs, cache, pattern=r"\s+|\S+").collect()
    assert not any(r["hit"] for r in got)  # another tokenizer version
    assert token_counts.count(docs.where("false"), scratch(spark, "cache")).count() == 0


# 1


def test_distances(spark):
    texts = [prose(k, 100) + "." for k in range(30)] + ["#$% " * 100, "same " * 100, "short", "", None]
    docs = table(spark, texts)
    references = quality.learn(docs)
    rows = {r["doc_id"]: r for r in quality.judge(docs, references, max_chars=0.25, max_words=0.7).collect()}
    assert {rows[i]["verdict"] for i in range(30)} == {"ok"} and [rows[i]["verdict"] for i in range(31, 35)] == ["words", "short", "short", "short"]
    assert all(r["keep"] == (i != 31) for i, r in rows.items())
    assert rows[30]["words"] == 0 and rows[30]["verdict"] == "short" and rows[30]["words_distance"] is None and rows[34]["chars_distance"] is None
    all_words = Counter(w for t in texts for w in words_of(t))
    common = [w for w, _ in sorted(all_words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]]
    total = sum(all_words.values())

    def histogram(counts, whole):
        own = [counts[w] / whole for w in common]
        return [*own, 1 - sum(own)]

    q = histogram(all_words, total)
    own = Counter(words_of(texts[0]))
    p = histogram(own, 100)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 1e-12)
    assert rows[0]["words_distance"] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2), abs=2e-6)


def test_a_language_without_a_reference(spark):
    docs = table(spark, [prose(k, 100) for k in range(5)], {4: "new"})
    rows = {r["doc_id"]: r for r in quality.judge(docs, quality.learn(docs.where("doc_id < 4"))).collect()}
    assert rows[4]["verdict"] == "unknown" and rows[4]["keep"] and rows[4]["chars_distance"] is None and rows[4]["words"] == 100


def test_labelled_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, quality.learn(docs)).where("verdict <> 'short'").join(labels.select("doc_id", "quality"), "doc_id").collect()
    bad, good = [r["keep"] for r in rows if r["quality"] == 0], [r["keep"] for r in rows if r["quality"] == 1]
    assert len(bad) > 30 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good)


# 6


def test_urls(spark, tmp_path):
    entries = ["bad.example", "mixed.example/ads", "mixed.example/a/b", "deep.bad.example", ""]
    urls = ["http://bad.example/", "https://www.BAD.example:8080/x?y#z", "http://notbad.example", "http://mixed.example/ads/1", "http://mixed.example/adsx", "http://sub.mixed.example/a/b/", "http://u:p@deep.bad.example", None, "", "no url", "http://[bad", "bad.example"]
    expected = ["bad.example", "bad.example", None, "mixed.example/ads", None, "mixed.example/a/b", "bad.example", None, None, None, None, None]
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, entries).collect()}
    assert [rows[i]["entry"] for i in range(len(urls))] == expected and all(r["blocked"] == (r["entry"] is not None) for r in rows.values())
    assert not any(r["blocked"] for r in url_filter.filter_urls(pages, []).collect())
    listed = spark.createDataFrame([(f"host{k}.example",) for k in range(500)] + [("bad.example",), (None,)], "entry string")
    assert [r["entry"] for r in url_filter.filter_urls(pages, listed).orderBy("page_id").collect()][:3] == ["bad.example", "bad.example", None]


def test_candidates_stay_few():
    host, path = ".".join(f"l{k}" for k in range(60)), "".join(f"/p{k}" for k in range(1000))
    few = url_filter.candidates(host, path, 3, 2)
    assert few == ["l59", "l58.l59", "l57.l58.l59", *(h + t for t in ("/p0", "/p0/p1") for h in ("l59", "l58.l59", "l57.l58.l59"))]
    assert url_filter.candidates(host, path, 60, 1000)[-1] == host + path and url_filter.candidates("", "", 3, 2) == []


def test_equal_digests_are_told_apart(tmp_path):
    def append(part, own):
        with open(tmp_path / part, "ab") as f:
            f.write(own)

    url_filter.write(sorted((int(url_filter.digests([e])[0]), e) for e in "abc"), append, buffer=5)
    own = url_filter.Digests(*(str(tmp_path / part) for part in url_filter.PARTS))
    assert own.holds(["a", "b", "d"]).tolist() == [True, True, False]
    assert own.holds(["d", "a"], url_filter.digests(["a", "a"])).tolist() == [False, True]  # a digest alone is no hit
    same = url_filter.Digests.__new__(url_filter.Digests)
    same.keys, same.starts, same.text = np.array([7, 7, 9], dtype=np.uint64), np.array([0, 1, 2, 3]), np.frombuffer(b"abc", dtype=np.uint8)
    assert same.holds(["b", "c", "z"], np.array([7, 9, 7], dtype=np.uint64)).tolist() == [True, True, False]


# 10


def brute_licenses(texts, templates, least=0.8):
    """By sets of words, window after window: of 2L shingles, L apart."""
    out = set()
    for i, text in enumerate(texts):
        w = words_of(text)
        for name, body in templates.items():
            p = words_of(body)
            if not p or not w:
                continue
            n = min(3, len(p))
            own, template = [tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))], {tuple(p[k : k + n]) for k in range(max(1, len(p) - n + 1))}
            length = 1
            while length < max(1, len(p) - n + 1):
                length *= 2
            best = (0.0, 0)
            for first in range(0, len(own), length):
                if first and first + length >= len(own):
                    break
                held = round(len(template & set(own[first : first + 2 * length])) / len(template), 6)
                if held > best[0]:
                    best = (held, first)
            if best[0] >= least:
                out.add((i, name, *best))
    return out


def test_licenses_against_brute_force(spark):
    r = random.Random(10)
    texts = []
    for k, (_, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        for at in (0, 7, 333):
            texts.append(prose(k, at) + " " + text + " " + prose(k + 50, 90))
        texts.append(text.upper())
        cut = text.split()
        texts.append(" ".join(cut[: len(cut) // 2]))
        for share in (0.7, 0.78, 0.8, 0.82, 0.85, 0.9, 0.97):
            texts.append(prose(k, r.randint(0, 80)) + " " + " ".join(cut[: round(len(cut) * share)]) + " " + prose(k, 9))
        texts.append(prose(k, 30) + " " + near(text, k, 0.04) + " " + prose(k, 30))  # words replaced here and there
    texts += ["", None, "license", prose(5, 400)]
    expected = brute_licenses(texts, licenses.TEMPLATES)
    got = {tuple(r) for r in licenses.find(table(spark, texts)).collect()}
    assert got == expected and len([x for x in expected if x[2] < 1]) > 3 * len(licenses.TEMPLATES)
    assert licenses.find(table(spark, texts), {}).count() == 0


def test_templates_shorter_than_a_shingle(spark):
    templates = {"one": "Copyleft", "two": "Public Domain", "three": "All rights reserved", "none": "..."}
    texts = [f"{prose(k, 40)} {t} {prose(k, 40)}" for k, t in enumerate(templates.values())] + ["copyleft", "domain public", "public, domain!", ""]
    got = {tuple(r) for r in licenses.find(table(spark, texts), templates).collect()}
    assert got == brute_licenses(texts, templates) and {(x[0], x[1]) for x in got} == {(0, "one"), (1, "two"), (2, "three"), (4, "one"), (6, "two")}


# all of them


def odd_rows():
    long = prose(1, 60_000)
    rows = [(1, "twin text of some words here", "xx"), (1, "twin text of some words here", "xx"), (2, "twin text of some words here", "xx"), (1, "another text under the same id", "xx")]
    rows += [(None, "no id at all but a text", "xx"), (None, None, None), (3, None, "xx"), (4, "", "xx"), (5, " \n\t", None), (6, "…!?", "xx"), (7, long, "xx"), (8, long, "yy"), (9, "you idiot, you scum", None), (10, "\x00퟿☕", "zz")]
    return [(i, t, lang, 1.0, "h", 7, True) for i, t, lang in rows]


def operators(spark, pages=None):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "twin text of some words here"), (1, "twin text of some words here"), (None, "x y z w v"), (2, None)], "item_id bigint, text string")
    same = lambda k: k
    lines = {
        "quality": (lambda d: quality.judge(d, quality.learn(d)), same),
        "toxicity": (lambda d: toxicity.judge(d, toxicity.learn(d, labels)), same),
        "toxicity.clean": (lambda d: toxicity.clean(d, toxicity.learn(d, labels)), lambda k: k - min(k, 1)),
        "bpe": (bpe.encode, same),
        "suffix_tree": (suffix_tree.score_all, same),
        "leaks": (lambda d: tiling.leaks(d, benchmark), lambda k: 6 if k else 0),
        "leaks.clean": (lambda d: tiling.clean(d, benchmark), lambda k: k - 3 if k else 0),
        "url": (lambda d: url_filter.filter_urls(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"})), same),
        "language": (lambda d: language.identify(d, language.train(d)), same),
        "language.clean": (lambda d: language.clean(d, language.train(d)), lambda k: k - min(k, 1)),  # that of 9 is in none of the languages
        "token_counts": (lambda d: token_counts.count(d, scratch(d.sparkSession, "c")), same),
        "join": (ngram_join.join, lambda k: 11 if k else 0),  # two rows of 1 are the same, its third has a text of its own; rows without a doc_id have none
        "join.one_of_each": (ngram_join.one_of_each, lambda k: 11 if k else 0),
        "licenses": (licenses.find, lambda k: 0),
    }
    return lines


CLASH = "doc_id bigint, text string, lang string, score double, hi string, block int, __stays boolean"


#: By operator, whether it leaves out the k-th odd row.
gone = {
    "toxicity.clean": lambda k, r: r[0] == 9,
    "language.clean": lambda k, r: r[0] == 9,
    "leaks.clean": lambda k, r: r[1] == "twin text of some words here",
    "join.one_of_each": lambda k, r: k in (1, 2) or r[0] == 8,
}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = [] if empty else odd_rows()
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    for name, (run, expected) in operators(spark).items():
        out = run(docs)
        assert len(out.collect()) == expected(len(rows)), name
        if "clean" in name or "one_of" in name:
            assert out.columns == docs.columns, name
            left = Counter(map(tuple, out.collect()))
            assert left <= Counter(rows), name  # rows are unchanged, none is there more often than before
            assert Counter(rows) - left == Counter(r for k, r in enumerate(rows) if gone[name](k, r)), name


def test_arrow_strings():
    assert K.strings(pa.array([None, "a"])) == ["", "a"]
