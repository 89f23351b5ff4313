"""Text analysis as column expressions, and the same in Python for query text.

The analyzer lower-cases and takes maximal runs of letters and numbers.  ``lower`` in the JVM looks at context for two characters; mapping those two
first makes it a plain mapping of characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

NOT_WORD = r"[^\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """array<string>: the tokens in order; empty for null."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def tokenize(text: str) -> list[str]:
    """``tokens`` for a query string on the driver."""
    out: list[str] = []
    word = ""
    for c in text.translate({ord("İ"): "i", ord("Σ"): "σ"}).lower():
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def summary(text: Column, least: int = 1, most: int = 999, cut: int = 500) -> Column:
    """A lead: what comes before the first blank line if that is within the bounds (in bytes), else the first ``cut`` bytes up to a space with an ellipsis, else null.

    Text that is no longer than ``cut`` and has no early blank line has no summary.
    """
    raw = F.encode(text, "UTF-8")
    at = F.octet_length(F.substring_index(text, "\n\n", 1))
    broken = F.instr(text, "\n\n") > 0
    # an unfinished character at the cut goes
    head = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, cut).cast("string")), "\ufffd+$", "")
    spaced = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    lead = F.concat(F.trim(F.when(spaced != "", spaced).otherwise(head)), F.lit("..."))
    return F.when(broken & at.between(least, most), F.trim(F.substring_index(text, "\n\n", 1))).when(F.octet_length(text) > cut, lead)
