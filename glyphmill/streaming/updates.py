"""Incremental index updates: micro-batches of documents into a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import index as I
from ..sources import store

#: Layers of a version from which they are merged into one.
MOST_LAYERS = 16


def upsert(current: I.Index, changed: DataFrame) -> I.Index:
    """The index with documents replaced or added by id."""
    fresh = I.build(I.latest(changed), current.stop_words)
    ids = fresh.docs.select("doc_id")
    old = current.without(ids, purge=True)
    postings = old.postings.unionByName(fresh.postings)
    docs = old.docs.unionByName(fresh.docs, allowMissingColumns=True)
    terms = I.term_table(postings)
    return I.Index(docs, postings, terms, I.corpus_stats(docs, terms), current.stop_words)


def apply_batch(batch: DataFrame, epoch: int, path: str, most_layers: int = MOST_LAYERS) -> bool:
    """Adds a micro-batch to the stored index, as a version of its own; False if it
    is the batch that made the current version.

    A batch is known by its epoch and the checksum of its rows: a repeated epoch
    changes nothing, while another stream, whose epochs start anew, is applied. An
    upsert that is applied again gives the same index in any case.
    """
    spark = batch.sparkSession
    one = I.latest(batch) if I.repeated_ids(batch) else batch
    known = {"epoch": epoch, **store.summary(batch)}
    now = store.manifest(spark, path)
    if now.get("epoch") == known or not known["rows"]:
        return False
    store.add_layer(spark, path, one, known)
    if len(now["layers"]) + 1 >= most_layers:
        store.merge(spark, path, epoch=known)
    return True


def update_index(documents: DataFrame, path: str, most_layers: int = MOST_LAYERS) -> DataStreamWriter:
    """A stream of documents into the index at ``path``. Every batch is a layer of
    its own documents; ``most_layers`` of them are merged."""
    return documents.writeStream.foreachBatch(lambda batch, epoch: apply_batch(batch, epoch, path, most_layers) and None)


def windowed_counts(events: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by window and type; rows of a stream later than the watermark are
    dropped."""
    window = F.window(time_col, width)
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).groupBy(window, "event_type").agg(F.count("*").alias("n"))
