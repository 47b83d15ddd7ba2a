"""Ranking formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Weight of a term by the field it stands in.
FIELD_WEIGHTS = {"title": 4.0, "heading": 3.0, "keywords": 3.0, "description": 2.0, "body": 1.0}


def field_weight(field: Column) -> Column:
    weight = F.lit(1.0)
    for name, value in FIELD_WEIGHTS.items():
        weight = F.when(field == name, value).otherwise(weight)
    return weight


def tfidf(wtf: Column, df: Column, n_docs: Column) -> Column:
    return F.when(wtf > 0, (1 + F.log(wtf)) * (F.log((n_docs + 1) / (df + 1)) + 1)).otherwise(0.0)


def bm25(wtf: Column, df: Column, n_docs: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5) + 1))
    mean = F.when(mean_length > 0, mean_length).otherwise(1.0)
    return idf * wtf * (k1 + 1) / (wtf + k1 * (1 - b + b * length / mean))


def coordination(score: Column, matched: Column, total: Column) -> Column:
    """More matched terms weigh more, in queries of more than one term."""
    return F.when(total > 1, score * (1 + 0.5 * matched / total)).otherwise(score)
