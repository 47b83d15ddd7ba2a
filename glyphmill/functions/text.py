"""Tokenizer, stemmer, stop words and small text functions as Columns.

Lengths are bytes and case folding is ASCII only, so that multi-byte text passes
through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a token, and the bounds of its length in bytes.
DELIMITERS = r"""[ \t\n\x0B\f\r.,;:!?()\[\]{}"/\\<>=+*&|^%$#@~`]+"""
MIN_BYTES, MAX_BYTES = 2, 40
#: The default stop words, matched against stemmed tokens.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can cannot could
couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my
myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with
won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()


def fold(text: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` is the fast path where it is the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_tokens(text: Column) -> Column:
    """Array of all non-empty tokens, before any length filter; null gives []."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def _undouble(word: Column) -> Column:
    last = F.right(word, F.lit(1))
    doubled = (F.octet_length(word) >= 3) & (F.right(word, F.lit(2)) == F.concat(last, last)) & ~last.isin(*"aeiou") & (F.octet_length(last) == 1)
    return F.when(doubled, F.left(word, F.char_length(word) - 1)).otherwise(word)


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.char_length(word) - n)


def stem(word: Column) -> Column:
    """The suffix rules, first hit wins; lengths in bytes."""
    n = F.octet_length(word)
    return (
        F.when(n <= 3, word)
        .when((n > 5) & word.endswith("ing"), _undouble(_cut(word, 3)))
        .when((n > 5) & word.endswith("tion"), _cut(word, 4))
        .when((n > 4) & word.endswith("ed"), _undouble(_cut(word, 2)))
        .when((n > 4) & word.endswith("ies"), F.concat(_cut(word, 3), F.lit("y")))
        .when((n > 4) & word.endswith("es"), _cut(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss"), _cut(word, 1))
        .otherwise(word)
    )


def is_kept_length(raw: Column) -> Column:
    return F.octet_length(raw).between(MIN_BYTES, MAX_BYTES)


def is_stop_word(term: Column, words: list[str] | None = None) -> Column:
    return term.isin(STOP_WORDS if words is None else words)


def bytes_as_characters(text: Column) -> Column:
    """A string with one character for every byte of the UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def bounded_levenshtein(a: Column, b: Column, most: int, characters: bool = False) -> Column:
    """The edit distance in bytes, or in characters, ``most + 1`` where it is larger."""
    if not characters:
        a, b = bytes_as_characters(a), bytes_as_characters(b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def decode_url(text: Column) -> Column:
    """%XX and + decoded; a malformed % stays as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def leading_integer(text: Column) -> Column:
    """Leading digits with an optional sign as a number, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("long"), F.lit(0).cast("long"))


def query_parameters(query_string: Column) -> Column:
    """Map of the parameters of a query string; the last of a name wins."""
    pairs = F.filter(F.split(query_string, "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), decode_url(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def category_of(source: Column) -> Column:
    return F.coalesce(source, F.lit("General"))
