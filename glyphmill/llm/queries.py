"""The queries opN_<name> and pipeline: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, jaccard, labelled, packing, pii, quality, secrets, topk, toxicity, warc
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "PSEUDONYM_KEY", "pseudonym_key", "table"]

#: The key where the session sets none, so that results can be compared.
PSEUDONYM_KEY = "glyphmill-test-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key; Spark hides settings whose names hold "secret"."""
    return spark.conf.get("spark.glyphmill.pii.secret", PSEUDONYM_KEY) or PSEUDONYM_KEY


def joined_sha256(values: Column) -> Column:
    return F.sha2(F.array_join(values, ","), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.size(decontam.hit_positions(F.col("spans"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), joined_sha256(ids).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, key=pseudonym_key(spark), matches_col="matches")
    count = lambda kind: F.coalesce(F.size(F.filter("matches", lambda m: m["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *map(count, pii.KINDS))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _scored(scores: DataFrame, least: float) -> DataFrame:
    id_ = F.col("id")
    return scores.select(id_.alias("doc_id"), labelled.held_out(id_).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return spans.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"), live
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_exact_topk, op3_warc, op4_packing, op5_ngram_jaccard_join, op6_pii, op7_html_extraction, op8_toxicity, op9_secrets, op10_quality)
}
