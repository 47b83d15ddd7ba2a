"""Labelled training rows: a bounded, repeatable sample, and the held-out part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Classes of crc32(id as text); rows of class 0 are held out of training.
FOLDS = 5


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of labelled documents outside the held-out part, as a
    written table of at most ``rows`` rows and ``most_bytes`` bytes of text.

    The ids with the smallest hashes are taken, in their order, each whole text
    that still fits; so the choice depends on nothing but ids and texts. Null
    labels and ids are left out. An id with several labels has the one that most
    of its rows give, 0 if they are even; an id with several texts has one row,
    with the text of the smallest hash.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    given = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    settled = given.where(~held_out(F.col("id"))).groupBy("id").agg((F.avg((F.col("label") > 0).cast("double")) > 0.5).cast("int").alias("label"))
    kept = settled.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(kept), "id")
    one = texts.groupBy("id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    taken = scratch.save(one, "sample")
    sizes = taken.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(F.xxhash64("id"), "id").collect()
    chosen, held = [], 0
    for r in sizes:
        if held + r["bytes"] <= most_bytes:
            chosen.append((r["id"],))
            held += r["bytes"]
    if len(chosen) == len(sizes):
        return taken
    few = docs.sparkSession.createDataFrame(chosen, f"id {taken.schema['id'].dataType.simpleString()}")
    return scratch.save(taken.join(F.broadcast(few), "id", "left_semi"), "sample-that-fits")
