"""The positional, field-weighted inverted index as DataFrames.

A document's postings are made where its text is; everything else is derived from
them by a pre-aggregated groupBy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import rows as R
from ..functions import text as T

#: Ids that are broadcast: 64 MB at 40 bytes each.
FEW_IDS = 64_000_000 // 40


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", path_col: str | None = "url", indexed_at: int = 0) -> DataFrame:
    """HTML rows to documents; ``indexed_at`` is the time of indexing in epoch s."""
    html = F.col(html_col)
    cut = pages.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.col(path_col) if path_col else F.lit("")).alias("path"), F.octet_length(html).cast("long").alias("file_size"),
        F.arrow_udf(P.fields, P.TYPE)(html.cast("string")).alias("p"),
    )
    return cut.select("doc_id", "path", *(f"p.{c}" for c in ("title", "description", "category", "keywords", "headings", "links", "body_text")), "file_size", F.lit(indexed_at).cast("long").alias("modified_time"))


def plain_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", category_col: str = "source") -> DataFrame:
    """Text rows to documents that have a body only."""
    none = F.array().cast("array<string>")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"),
        T.category_of(F.col(category_col)).alias("category"), none.alias("keywords"), none.alias("headings"), none.alias("links"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body_text"), F.octet_length(text_col).cast("long").alias("file_size"), F.lit(0).cast("long").alias("modified_time"),
    )


def latest(docs: DataFrame, id_col: str = "doc_id", order_col: str = "modified_time", tie_col: str | None = None) -> DataFrame:
    """One row of each id, the newest: an upsert by id. Ties go to the larger
    ``tie_col``, else to the larger hash of the row."""
    tie = F.col(tie_col).desc() if tie_col else F.xxhash64(*docs.columns).desc()
    newest = Window.partitionBy(id_col).orderBy(F.col(order_col).desc(), tie)
    return docs.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def _field(text: Column, name: str) -> Column:
    return F.transform(T.raw_tokens(text), lambda w: F.struct(w.alias("raw"), F.lit(name).alias("field")))


def tokens(docs: DataFrame, keep_fields: bool = True) -> DataFrame:
    """(doc_id, position, raw, term, field) of the tokens whose length is kept.

    One counter runs over title, headings, keywords, description and body, and
    counts dropped tokens too.
    """
    def lists(name: str, field: str) -> Column:
        return F.flatten(F.transform(F.col(name), lambda t: _field(t, field)))

    if keep_fields:
        all_ = F.concat(_field(F.col("title"), "title"), lists("headings", "heading"), lists("keywords", "keywords"), _field(F.col("description"), "description"), _field(F.col("body_text"), "body"))
        each = docs.select("doc_id", F.posexplode(all_).alias("k", "t")).select("doc_id", (F.col("k") + 1).alias("position"), "t.raw", "t.field")
    else:
        each = docs.select("doc_id", F.posexplode(T.raw_tokens(F.col("body_text"))).alias("k", "raw")).select("doc_id", (F.col("k") + 1).alias("position"), "raw", F.lit("body").alias("field"))
    kept = each.where(T.is_kept_length(F.col("raw"))).select("doc_id", "position", "raw", T.stem(F.col("raw")).alias("term"), "field")
    return kept.where(F.octet_length("term") >= T.MIN_BYTES)


@dataclass
class Index:
    """docs: documents with word_count; postings(term, doc_id, tf, wtf,
    positions); terms(term, df, cf); stats: one row n_docs, n_terms, avgdl;
    stop_words: the list it was built with, None for the default one."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    stop_words: list[str] | None = None

    @cached_property
    def sizes(self) -> Row:
        """The row of ``stats``, read once."""
        return self.stats.first()

    def is_stop_word(self, term: str) -> bool:
        return term in (T.STOP_WORDS if self.stop_words is None else self.stop_words)

    def posting_list(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def without(self, doc_ids: DataFrame, purge: bool = False) -> Index:
        """Postings of the documents removed. With ``purge`` documents and counts
        go too; without, documents and terms stay, with frequencies of what is left."""
        ids = few_ids(doc_ids.select("doc_id").distinct())
        postings = self.postings.join(ids, "doc_id", "left_anti")
        if purge:
            docs = self.docs.join(ids, "doc_id", "left_anti")
            terms = term_table(postings)
            return Index(docs, postings, terms, corpus_stats(docs, terms), self.stop_words)
        left = self.terms.select("term").join(term_table(postings), "term", "left")
        return Index(self.docs, postings, left.select("term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("cf", F.lit(0)).alias("cf")), self.stats, self.stop_words)

    def cached(self) -> Index:
        return Index(*(d.cache() for d in (self.docs, self.postings, self.terms, self.stats)), self.stop_words)


def few_ids(ids: DataFrame, n: int | None = None) -> DataFrame:
    """Marks ids, ``n`` of them if known, for a broadcast if they fit 64 MB in a hash
    table, so that postings needn't be shuffled to meet them."""
    n = ids.count() if n is None else n
    return F.broadcast(ids) if n <= FEW_IDS else ids


def repeated_ids(docs: DataFrame) -> bool:
    """Whether an id stands in several rows; looks at ids only."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").take(1))


def grouped(docs: DataFrame, stop_words: list[str] | None = None, keep_fields: bool = True, positions: bool = True, distinct: bool = True) -> DataFrame:
    """(term, doc_id, tf, wtf[, positions]) without stop words. A document's postings
    are grouped where its text is, without a shuffle; rows of ids that are not
    ``distinct`` are summed up afterwards."""
    fields = R.FIELDS if keep_fields else R.BODY_ONLY
    schema = "term string, doc_id long, tf long, wtf double" + (", positions array<int>" if positions else "")
    each = docs.select("doc_id", *fields).mapInArrow(lambda batches: R.postings(batches, fields, stop_words, positions), schema)
    if distinct:
        return each
    parts = [F.sum("tf").alias("tf"), F.sum("wtf").alias("wtf")]
    if positions:
        parts.append(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return each.groupBy("term", "doc_id").agg(*parts)


def term_table(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def counted_terms(docs: DataFrame, stop_words: list[str] | None = None, keep_fields: bool = True, distinct: bool = True) -> DataFrame:
    """The term table of documents. Terms are summed up where the texts are, many
    documents at once, so that postings are made for repeated ids only."""
    fields = R.FIELDS if keep_fields else R.BODY_ONLY
    once, more = docs, None
    if not distinct:
        again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))
        ids, same = few_ids(again), F.col("doc_id").eqNullSafe(F.col("_again"))
        once, more = docs.join(ids, same, "left_anti"), term_table(grouped(docs.join(ids, same, "left_semi"), stop_words, keep_fields, False, False))
    each = once.select(*fields).mapInArrow(lambda batches: R.term_counts(batches, fields, stop_words), "term string, df long, cf long")
    each = each if more is None else each.unionByName(more)
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def word_counts(docs: DataFrame, keep_fields: bool = True, distinct: bool = True) -> DataFrame:
    """docs with word_count: tokens before the stop-word filter."""
    fields = [F.col(c) for c in (R.FIELDS if keep_fields else R.BODY_ONLY)]
    n = F.when(F.col("doc_id").isNotNull(), F.arrow_udf(R.counts, "long")(*fields)).otherwise(0)
    if distinct:
        return docs.withColumn("word_count", n)
    sums = docs.select("doc_id", n.alias("n")).groupBy("doc_id").agg(F.sum("n").alias("word_count"))
    return docs.join(sums, "doc_id", "left").withColumn("word_count", F.coalesce("word_count", F.lit(0)).cast("long"))


def corpus_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    sizes = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avgdl"))
    return sizes.crossJoin(terms.where("df > 0").agg(F.count("*").alias("n_terms"))).select("n_docs", "n_terms", "avgdl")


def build(docs: DataFrame, stop_words: list[str] | None = None, keep_fields: bool = True, positions: bool = True) -> Index:
    """The index of documents, which should have distinct ids, as a plan;
    ``store.build`` also writes it."""
    distinct = not repeated_ids(docs)
    postings = grouped(docs, stop_words, keep_fields, positions, distinct)
    sized, terms = word_counts(docs, keep_fields, distinct), counted_terms(docs, stop_words, keep_fields, distinct)
    return Index(sized, postings, terms, corpus_stats(sized, terms), stop_words)
