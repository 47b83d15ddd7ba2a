"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.

==================== ==========================================================
stage                decision
==================== ==========================================================
toxicity             rows that the classifier scores 0.5 or more go
ngram_jaccard        of each group of near copies (0.8 of the shingles of five
                     words, or more) the smallest doc_id stays
decontamination      rows with windows of two benchmark items go; from rows
                     with those of one item the hit words are cut
pii                  personal data become format-preserving pseudonyms
packing              texts become pieces of at most 2048 tokens in sequences
==================== ==========================================================

Defined cases, in all stages: null texts stay null up to packing, where they are
the end id alone; empty and very long texts are rows like all others; a null
doc_id keeps its row, also among near copies; repeated rows are one document among
near copies (one stays) and are kept by the other stages; of equal near copies the
smallest doc_id stays; empty tables stay empty; columns that ``documents`` has
besides, whatever their names, are handed on up to packing, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontam, jaccard, packing, pii, toxicity
from glyphmill.llm.queries import pseudonym_key, table
from glyphmill.llm.store import Scratch


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"), drop_items=2))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(pii.pseudonymise(docs, key=pseudonym_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary="byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_leaks), ("pii", hide_personal_data), ("packing", pack)]

#: A fitted classifier, keyed permutations and a tokenizer: no SQL has the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
