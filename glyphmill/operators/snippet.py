"""Highlighted snippets of the rows of a result page.

A page has at most 50 rows, so the walk over the text runs in an Arrow batch of
those; the search itself never gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.query import tokenize

STEP, LENGTH = 20, 150
_SPACE = " \t\n\x0b\f\r"


def best_window(text: str, terms: list[str], length: int = LENGTH) -> int:
    """Start of the first window with the most case-sensitive term starts."""
    best, most = 0, 0
    for at in range(0, len(text), STEP):
        end, n = min(at + length, len(text)), 0
        for term in terms:
            p = text.find(term, at)
            while 0 <= p < end:
                n += 1
                p = text.find(term, p + len(term))
        if n > most:
            best, most = at, n
    return best


def snippet(text: str | None, query: str, length: int = LENGTH) -> str:
    """The best window with its terms in <em>, cut at characters."""
    if not text or not length:
        return ""
    length = LENGTH if length < 40 else length
    terms = tokenize(query)
    start = best_window(text, terms, length)
    while start > 0 and text[start] not in _SPACE:
        start -= 1
    if start and text[start] in _SPACE:
        start += 1
    raw = text[start : start + length]
    low, out, at = raw.lower() if len(raw.lower()) == len(raw) else raw, [], 0
    while at < len(raw):
        for term in terms:
            after = raw[at + len(term) : at + len(term) + 1]
            if low.startswith(term, at) and not (after.isascii() and after.isalnum()) and after != "-":
                out.append(f"<em>{raw[at : at + len(term)]}</em>")
                at += len(term)
                break
        else:
            out.append(raw[at])
            at += 1
    return ("..." if start else "") + "".join(out) + ("..." if start + len(raw) < len(text) else "")


def snippet_column(text: Column, query: str, length: int = LENGTH) -> Column:
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: snippet(t, query, length))

    return run(text)
