"""Edit distances over a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def swap_distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``, no place being edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def byte_levenshtein(a: str, b: str) -> int:
    """Plain edit distance over UTF-8 bytes."""
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def swaps(word: str) -> list[str]:
    """``word`` with one pair of neighbours swapped."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def within(term: Column, word: str, edits: int) -> Column:
    """Whether ``term`` is at most ``edits`` (0 to 2) from ``word``, swaps of neighbours counting one.

    Built-in expressions only.  With a swap, what lies before the swapped pair and what lies after it are equal but for the other edit.
    """
    if edits == 0:
        return term == F.lit(word)
    near = F.levenshtein(term, F.lit(word), edits) >= 0
    if edits == 1:
        return (near | term.isin(swaps(word))) if swaps(word) else near
    twice = {new for i in range(len(word) - 1) for new in (word[:i] + word[i + 1] + word[i] + tail for tail in [word[i + 2 :], *swaps(word[i + 2 :])])}
    if twice:
        near = near | term.isin(sorted(twice))
    for i in range(len(word) - 1):
        if word[i] == word[i + 1]:
            continue
        head, pair, tail = word[:i], word[i + 1] + word[i], word[i + 2 :]
        near = near | (term.endswith(pair + tail) & (F.levenshtein(F.left(term, F.length(term) - len(pair + tail)), F.lit(head), 1) >= 0))
        near = near | (term.startswith(head + pair) & (F.levenshtein(F.substring(term, F.lit(i + 3), F.length(term)), F.lit(tail), 1) >= 0))
    return near
