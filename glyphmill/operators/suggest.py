"""Prefix suggestions and spelling corrections over the term table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_levenshtein
from .index import Index

#: Words looked at for a prefix, words compared for a correction,
#: the largest edit distance, and the results below which a correction is sought.
LOOKED_AT, COMPARED, MAX_EDITS, FEW_RESULTS = 256, 50, 2, 3


def suggest(index: Index, prefix: str, limit: int = 5) -> DataFrame:
    """(term, cf): of the first 256 words of the prefix in byte order, the most
    frequent ones. A negative limit takes all of them."""
    first = index.terms.where(F.col("term").startswith(prefix)).orderBy("term").limit(LOOKED_AT)
    best = first.orderBy(F.col("cf").desc(), "term")
    return (best if limit < 0 else best.limit(limit)).select("term", "cf")


def word_frequency(index: Index, word: str) -> DataFrame:
    """One row: the word's collection frequency, 0 if it isn't there."""
    return index.terms.where(F.col("term") == word).agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("cf"))


def did_you_mean(index: Index, term: str, full_vocabulary: bool = False) -> DataFrame:
    """At most one row (term, edits): the nearest candidate within two edits."""
    pool = index.terms if full_vocabulary else suggest(index, "", COMPARED)
    near = pool.select("term", "cf", bounded_levenshtein(F.col("term"), F.lit(term), MAX_EDITS).alias("edits"))
    return near.where(F.col("edits") <= MAX_EDITS).orderBy("edits", F.col("cf").desc(), "term").limit(1).select("term", "edits")
