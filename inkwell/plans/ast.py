"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


class Query:
    """Any node."""


def at(name: str, body: str) -> str:
    return f"{name}:{body}" if name else body


@dataclass(frozen=True)
class Term(Query):
    term: str
    field: str = ""

    def __str__(self) -> str:
        return f"term({at(self.field, self.term)})"


@dataclass(frozen=True)
class Phrase(Query):
    phrase: str
    field: str = ""

    def __str__(self) -> str:
        quoted = f'"{self.phrase}"'
        return f"phrase({at(self.field, quoted)})"


@dataclass(frozen=True)
class Prefix(Query):
    prefix: str
    field: str = ""

    def __str__(self) -> str:
        return f"prefix({at(self.field, self.prefix + '*')})"


@dataclass(frozen=True)
class Regex(Query):
    pattern: str
    field: str = ""
    #: "full": the whole term must match; "search": any part of it.
    mode: str = "full"

    def __str__(self) -> str:
        return f"regex({at(self.field, '/' + self.pattern + '/')})"


@dataclass(frozen=True)
class Fuzzy(Query):
    term: str
    fuzziness: int = 1
    field: str = ""

    def __str__(self) -> str:
        return f"fuzzy({at(self.field, self.term)}~{self.fuzziness})"


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = field(default=())
    should: tuple[Query, ...] = field(default=())
    must_not: tuple[Query, ...] = field(default=())

    def __str__(self) -> str:
        parts = [f"{name}({', '.join(map(str, own))})" for name, own in (("AND", self.must), ("OR", self.should), ("NOT", self.must_not)) if own]
        return f"bool({' '.join(parts) or 'empty'})"

    def hoisted(self) -> Bool:
        """Clauses of ``must`` that only negate become negations of this node."""
        only = [c for c in self.must if isinstance(c, Bool) and c.must_not and not c.must and not c.should]
        return Bool(tuple(c for c in self.must if c not in only), self.should, self.must_not + tuple(n for c in only for n in c.must_not))
