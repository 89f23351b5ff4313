"""A small corpus, and a plain-Python evaluation of queries to hold the engine against."""

from __future__ import annotations

import math
import re

from inkwell.functions.analysis import tokenize
from inkwell.functions.distance import swap_distance
from inkwell.plans.ast import Bool, Fuzzy, Phrase, Prefix, Query, Regex, Term

DOCS = {
    "a1": {"title": "Rivers of the north", "body": "Cold rivers run north. The river bends twice; rivers meet.", "tags": "water travel"},
    "a2": {"title": "Bread at home", "body": "Flour, water and salt: bread needs no more than that.", "tags": "food"},
    "a3": {"title": "Salt roads", "body": "Old roads carried salt to the north and silk to the south.", "tags": "travel history"},
    "a4": {"title": "Silk", "body": "Silk, silk and more silk. Silk roads crossed the cold desert.", "tags": "history", "year": 1200, "rare": True},
    "a5": {"title": "Cold bread", "body": "No bread is cold for long at home in the desert.", "tags": "food"},
    "a6": {"title": "Crème brûlée", "body": "Cream, sugar and a flame. Café food, cold inside.", "tags": "food sweet"},
    "a7": {"title": "", "body": "A ship sails on the open sea, and the sea is cold.", "tags": "water"},
    "a8": {"title": "Numbers 42 and 7", "body": "42 ships, 7 roads, 1 river_bend and 0 maps.", "tags": ""},
    "a9": {"title": "Shpi yard", "body": "Ships are built here; a shop sells bread.", "tags": "trade"},
    "b1": {"title": "Nothing", "body": 5, "tags": None},
}

#: Queries and the ids that each finds, by hand.
QUERIES = {
    "term": {
        'cold': 'a1 a4 a5 a6 a7',
        'salt': 'a2 a3',
        'Salt': '',
        '42': 'a8',
        'nosuch': '',
        'river': 'a1 a8',
        'bend': 'a8',
        'café': 'a6',
        'cafe': '',
    },
    "field": {
        'title:cold': 'a5',
        'body:cold': 'a1 a4 a5 a6 a7',
        'tags:food': 'a2 a5 a6',
        'title: bread': 'a2 a5',
        'tags:travel': 'a1 a3',
        'nofield:cold': '',
        '_id:a3': 'a3',
        '_id:zz': '',
    },
    "phrase": {
        '"cold bread"': 'a5',
        '"the sea"': 'a7',
        '"SILK roads"': 'a4',
        'title:"salt roads"': 'a3',
        'body:"salt roads"': '',
        '"silk silk"': 'a4',
        '"sea and"': 'a7',
        '""': '',
        '"!"': '',
        '"Bread"': 'a2 a5 a9',
        '"and the sea is cold"': 'a7',
        'tags:"food sweet"': 'a6',
    },
    "prefix": {
        'riv*': 'a1 a8',
        's*': 'a2 a3 a4 a6 a7 a8 a9',
        'title:s*': 'a3 a4 a9',
        '*': 'a1 a2 a3 a4 a5 a6 a7 a8 a9 b1',
        'sal*': 'a2 a3',
        'zzz*': '',
        'tags:tra*': 'a1 a3 a9',
        'café*': 'a6',
    },
    "and": {
        'cold AND north': 'a1',
        'cold north': 'a1',
        'bread home': 'a2 a5',
        'cold AND nosuch': '',
        'salt AND silk AND south': 'a3',
        'title:bread body:bread': 'a2 a5',
        'cold AND cold': 'a1 a4 a5 a6 a7',
        '"cold bread" AND home': 'a5',
        'riv* AND north': 'a1',
        'food AND (cold)': 'a5 a6',
    },
    "or": {
        'salt OR silk': 'a2 a3 a4',
        'nosuch OR bread': 'a2 a5 a9',
        'salt OR silk OR bread': 'a2 a3 a4 a5 a9',
        'nosuch OR nothere': '',
        'title:silk OR tags:food': 'a2 a4 a5 a6',
        '"the sea" OR ship*': 'a7 a8 a9',
    },
    "not": {
        'cold NOT bread': 'a1 a4 a6 a7',
        'cold -north': 'a4 a5 a6 a7',
        'NOT bread cold': 'a1 a4 a6 a7',
        'cold -body:bread': 'a1 a4 a6 a7',
        'food NOT (cold OR bread)': '',
        'cold -"cold bread"': 'a1 a4 a6 a7',
        'cold -s*': 'a1 a5',
        'salt -salt': '',
        'cold NOT nosuch': 'a1 a4 a5 a6 a7',
        'cold -north -sea': 'a4 a5 a6',
        '-bread cold': 'a1 a4 a6 a7',
        'cold AND NOT desert': 'a1 a6 a7',
        'food -tags:food': '',
    },
    "grouped": {
        '(salt OR silk) AND north': 'a3',
        '(cold) bread': 'a5',
        '((cold))': 'a1 a4 a5 a6 a7',
        '(salt AND silk) OR (bread AND home)': 'a2 a3 a5',
        '(cold OR salt) (north OR desert)': 'a1 a3 a4 a5',
        '(salt OR bread) NOT north': 'a2 a5 a9',
        '(a OR the) AND -cold AND -salt': 'a9',
        '(title:silk OR title:bread) cold': 'a4 a5',
        '(bread)': 'a2 a5 a9',
    },
    "mixed": {
        'title:cold OR (body:"salt to" AND tags:travel)': 'a3 a5',
        'food AND (cold OR "no more") -title:home': 'a5 a6',
        'sea* OR (roads NOT silk)': 'a7 a8',
        'cold AND ("the sea" OR desert) -tags:history': 'a5 a7',
        '/s[ai].*/ AND north': 'a3',
        'shpi~1 OR silk': 'a3 a4 a7 a9',
        'bread~1 -cold': 'a2 a9',
        '(/riv.*/ OR salt) AND travel': 'a1 a3',
        'title:/s.*/ cold': 'a4',
        'body:ships~2 NOT bread': 'a7 a8',
        'water (riv* OR "and salt")': 'a1 a2',
    },
    "regex": {
        '/s[ai]l.*/': 'a2 a3 a4',
        '/silk/': 'a3 a4',
        'body:/[0-9]+/': 'a8',
        '/nosuch.*/': '',
        '/(cold|salt)/': 'a1 a2 a3 a4 a5 a6 a7',
        'title:/[a-z]+d/': 'a2 a5 a8 a9',
        '/old/': 'a3',
        '/caf./': 'a6',
    },
    "fuzzy": {
        'slik~1': 'a3 a4',
        'slik~2': 'a3 a4 a7',
        'ship~1': 'a7 a8 a9',
        'bred~': 'a2 a5 a9',
        'bread~0': 'a2 a5 a9',
        'nosuchword~2': '',
        'title:shpi~1': 'a9',
        'body:shpi~1': 'a7',
        'café~1': 'a6',
        'cod~1': 'a1 a4 a5 a6 a7',
    },
    "edge": {
        '': '',
        '   ': '',
        'and': 'a2 a3 a4 a6 a7 a8',
        'a-b': '',
        'zz OR zz': '',
        'sea sea sea': 'a7',
    },
}


class Brute:
    """Queries by looking at every document."""

    def __init__(self, docs: dict[str, dict]):
        self.docs = {i: {f: tokenize(v) for f, v in d.items() if isinstance(v, str)} for i, d in docs.items()}
        self.total = len(docs)
        self.average = {}
        for f in {f for d in self.docs.values() for f in d}:
            own = [len(d[f]) for d in self.docs.values() if d.get(f)]
            self.average[f] = math.floor(sum(own) / len(own) * self.total) / self.total if own else 0.0

    def words(self, q: Regex | Fuzzy) -> set[str]:
        vocabulary = {w for d in self.docs.values() for f, ws in d.items() if q.field in ("", f) for w in ws}
        if isinstance(q, Regex):
            match = re.compile(q.pattern)
            return {w for w in vocabulary if (match.fullmatch(w) if q.mode == "full" else match.search(w))}
        return {w for w in vocabulary if swap_distance(w, q.term) <= q.fuzziness}

    def hits(self, q: Query) -> dict[str, tuple[str, float, int]]:
        """Document: (field, tf, length)."""
        if isinstance(q, Bool):
            return dict.fromkeys(self.ids(q), ("", 1.0, 0))
        if q.field == "_id":  # type: ignore[attr-defined]
            return {i: ("", 1.0, 0) for i in self.docs if i == q.term}  # type: ignore[attr-defined]
        constant = False
        if isinstance(q, Phrase):
            words = tokenize(q.phrase)
            if not words:
                return {}
            if len(words) == 1:
                return self.hits(Term(words[0], q.field))
            tf = lambda ws: float(any(ws[k : k + len(words)] == words for k in range(len(ws))))
        elif isinstance(q, Term):
            tf = lambda ws: float(ws.count(q.term))
        elif isinstance(q, Prefix):
            tf = lambda ws: float(sum(w.startswith(q.prefix) for w in ws))
        else:
            own = self.words(q)  # type: ignore[arg-type]
            if len(own) == 1:
                return self.hits(Term(own.pop(), q.field))  # type: ignore[attr-defined]
            tf, constant = (lambda ws: float(any(w in own for w in ws))), not q.field  # type: ignore[attr-defined]
        out = {}
        for i, d in self.docs.items():
            for f in sorted(d):
                if q.field in ("", f) and tf(d[f]):  # type: ignore[attr-defined]
                    out[i] = ("", 1.0, 0) if constant else (f, tf(d[f]), len(d[f]))
                    break
        return out

    def ids(self, q: Query) -> set[str]:
        if not isinstance(q, Bool):
            return set(self.hits(q))
        q = q.hoisted()
        if q.must_not and not q.must and not q.should:
            raise ValueError
        out = set(self.docs)
        for c in q.must:
            out &= self.ids(c)
        some = set().union(*(self.ids(c) for c in q.should))
        if q.should and (some or not q.must):
            out &= some
        for c in q.must_not:
            out -= self.ids(c)
        return out

    def search(self, q: Query | None, tfidf: bool = False) -> dict[str, float]:
        if q is None:
            return {}
        while isinstance(q, Bool) and not (h := q.hoisted()).must_not and len(h.must) + len(h.should) == 1:
            q = (*h.must, *h.should)[0]
        found = self.hits(q)
        n = len(found)
        out = {}
        for i, (f, tf, length) in found.items():
            if tfidf:
                out[i] = (1 + math.log(tf)) * (math.log((self.total + 1) / (n + 1)) + 1)
            else:
                average = self.average.get(f) or 1.0
                out[i] = math.log(1 + (self.total - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (length or average) / average))
        return out
