"""Ranked and boolean evaluation of queries over an index.

Ranked evaluation scores every document that has any term of the query's bag.
Boolean evaluation first finds the documents that satisfy the tree (AND, OR, NOT,
phrase adjacency, field restriction) and scores them by the positive terms.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.rows import FIELDS as FIELDS_OF
from ..plans import query as Q
from .index import Index, tokens

#: Query terms are broadcast; a batch of this many distinct ones at most.
MAX_BATCH_TERMS = 1_000_000
#: Terms that are looked up one by one, and postings that are broadcast: 100,000
#: rows of some 100 bytes.
FEW_TERMS, FEW_HITS = 1_000, 100_000
FIELDS = {"title": ["title"], "heading": ["heading"], "headings": ["heading"], "keywords": ["keywords"], "description": ["description"], "body": ["body"]}


def term_score(algorithm: str, k1: float = scoring.K1, b: float = scoring.B) -> Column:
    if algorithm == "tfidf":
        return scoring.tfidf(F.col("wtf"), F.col("df"), F.col("n_docs"))
    return scoring.bm25(F.col("wtf"), F.col("df"), F.col("n_docs"), F.col("word_count"), F.col("avgdl"), k1, b)


def _table(spark: SparkSession, rows: list[tuple], schema: dict[str, pa.DataType]) -> DataFrame:
    """A small table that is part of the plan, so that it costs no job."""
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(schema.items())}))


def score_bags(index: Index, bags: list[list[str]], algorithm: str = "bm25", k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(query_id, doc_id, score, matched, total, modified_time) of bags of terms: one
    pass over the postings of all of them. A posting is scored once, however many
    queries have its term.

    Up to FEW_TERMS distinct terms are looked up first. They prune the postings to
    the ranges of the terms, and the sum of their document frequencies is the number
    of postings that will be read: up to FEW_HITS of them are broadcast to the
    documents' word counts, more are joined as the optimizer likes. More terms are
    broadcast to the postings, MAX_BATCH_TERMS at most.
    """
    spark = index.postings.sparkSession
    wanted = [(i, term, n, len(bag)) for i, bag in enumerate(bags) for term, n in Counter(bag).items()]
    if len(wanted) > MAX_BATCH_TERMS:
        raise ValueError(f"a batch has at most {MAX_BATCH_TERMS} terms; split it")
    distinct = sorted({w[1] for w in wanted})
    asked = {"query_id": pa.int32(), "term": pa.string(), "times": pa.int64(), "total": pa.int64()}
    postings, docs = index.postings.select("term", "doc_id", "wtf"), index.docs.select("doc_id", "word_count", "modified_time")
    if len(distinct) <= FEW_TERMS:
        found = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(distinct)).select("term", "df").collect()} if distinct else {}
        if len(bags) == 1:
            terms = _table(spark, [(*w, found[w[1]]) for w in wanted if w[1] in found], asked | {"df": pa.int64()})
        else:
            terms = _table(spark, sorted(found.items()), {"term": pa.string(), "df": pa.int64()})
        hits = postings.where(F.col("term").isin(sorted(found))).join(F.broadcast(terms), "term")
        hits = F.broadcast(hits) if sum(found.values()) <= FEW_HITS else hits
    else:
        terms = index.terms.join(F.broadcast(_table(spark, [(t,) for t in distinct], {"term": pa.string()})), "term").select("term", "df")
        hits = postings.join(F.broadcast(terms), "term")
    sizes = index.sizes
    sized = docs.join(hits, "doc_id").withColumns({"n_docs": F.lit(sizes["n_docs"]), "avgdl": F.lit(sizes["avgdl"])})
    each = sized.withColumn("s", term_score(algorithm, k1, b))
    if "query_id" not in terms.columns:
        each = each.select("term", "doc_id", "modified_time", "s").join(F.broadcast(_table(spark, wanted, asked)), "term")
    summed = each.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("s") * F.col("times")).alias("sum"), F.sum("times").alias("matched"), F.first("total").alias("total"), F.first("modified_time").alias("modified_time")
    )
    score = scoring.coordination(F.col("sum"), F.col("matched"), F.col("total"))
    return summed.where("sum > 0").select("query_id", "doc_id", score.alias("score"), "matched", "total", "modified_time")


def order() -> list[Column]:
    """Score (ties within 1e-6), matched terms, newer first, then id."""
    return [F.round("score", 6).desc(), F.col("matched").desc(), F.col("modified_time").desc(), F.col("doc_id").asc()]


def ranked(index: Index, text: str, algorithm: str = "bm25", k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """All matches of one query, unordered: doc_id, score, matched, total and the
    documents' modified_time, which orders ties."""
    return score_bags(index, [Q.bag(Q.parse(text))], algorithm, k1, b).drop("query_id")


def batch(index: Index, texts: list[str], limit: int = 10, algorithm: str = "bm25") -> DataFrame:
    """The first ``limit`` results of many queries at once: query_id, rank,
    doc_id, score, matched. One job, whatever the number of queries."""
    scored = score_bags(index, [Q.bag(Q.parse(t)) for t in texts], algorithm)
    best = Window.partitionBy("query_id").orderBy(*order())
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score", "matched")


def page(results: DataFrame, index: Index, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of results in order, with the documents' columns."""
    page, page_size = clamp(page, page_size)
    timed = results if "modified_time" in results.columns else results.join(index.docs.select("doc_id", "modified_time"), "doc_id")
    best = timed.orderBy(*order()).offset((page - 1) * page_size).limit(page_size)
    return best.drop("modified_time")


def clamp(page: int, page_size: int) -> tuple[int, int]:
    return max(1, page), 10 if page_size < 1 else min(50, page_size)


def page_count(total: Column, page_size: int) -> Column:
    return F.ceil(total / page_size)


def compare(index: Index, text: str) -> DataFrame:
    """BM25 and TF-IDF side by side: doc_id and both scores and ranks."""
    sides = []
    for name in ("bm25", "tfidf"):
        scored = ranked(index, text, name)
        at = F.row_number().over(Window.orderBy(*order()))
        top = scored.orderBy(*order()).limit(50).withColumn("r", at)
        sides.append(top.select("doc_id", F.col("score").alias(f"{name}_score"), F.col("r").alias(f"{name}_rank")))
    return sides[0].join(sides[1], "doc_id", "full")


def positions_of(index: Index, term: str, fields: DataFrame | None = None) -> DataFrame:
    return index.posting_list(term).select("doc_id", F.explode("positions").alias("position"))


def phrase(index: Index, terms: list[str]) -> DataFrame:
    """doc_id of documents with the terms at consecutive positions; the index's
    stop words, which have no postings, keep their place but match anything."""
    at = [(i, t) for i, t in enumerate(terms) if not index.is_stop_word(t)]
    if not at:
        return index.docs.select("doc_id").where("false")

    def starts(shift: int, term: str, name: str) -> DataFrame:
        return index.posting_list(term).select("doc_id", F.transform("positions", lambda p: p - shift).alias(name))

    found = starts(*at[0], "starts")
    for shift, term in at[1:]:
        other = starts(shift, term, "next")
        found = found.join(other, "doc_id").select("doc_id", F.array_intersect("starts", "next").alias("starts")).where(F.size("starts") > 0)
    return found.select("doc_id")


def _tokens_of(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Tokens of some fields only; the texts of the others aren't read."""
    dropped = [c for c, field in FIELDS_OF.items() if field not in fields]
    kinds = dict(docs.dtypes)
    return tokens(docs.withColumns({c: (F.array() if kinds[c].startswith("array") else F.lit("")).cast(kinds[c]) for c in dropped}) if dropped else docs)


def _field(index: Index, toks: DataFrame | None, name: str, term: str) -> DataFrame:
    if name == "category":
        return index.docs.where(F.lower("category").contains(term)).select("doc_id")
    if toks is None:
        raise ValueError("field restriction needs the tokens of the index's documents, or these")
    if "body_text" in toks.columns:
        toks = _tokens_of(toks, FIELDS.get(name, [name]))
    return toks.where((F.col("term") == term) & F.col("field").isin(FIELDS.get(name, [name]))).select("doc_id").distinct()


def satisfying(index: Index, node: Q.Node | None, toks: DataFrame | None = None) -> DataFrame:
    """doc_id of the documents that satisfy the tree. The index's stop words, and
    phrases of nothing else, say nothing: an AND, OR or NOT is what it is without
    them, and a query of nothing else has no documents."""
    found = _satisfying(index, node, toks)
    return index.docs.select("doc_id").where("false") if found is None else found


def _satisfying(index: Index, node: Q.Node | None, toks: DataFrame | None) -> DataFrame | None:
    if node is None:
        return None
    if node.kind == "term":
        return None if index.is_stop_word(node.value) else index.posting_list(node.value).select("doc_id")
    if node.kind == "phrase":
        return None if all(map(index.is_stop_word, node.terms)) else phrase(index, node.terms)
    if node.kind == "field":
        return _field(index, toks, node.value, node.left.value)
    left = _satisfying(index, node.left, toks)
    if node.kind == "not":
        return left if left is None else index.docs.select("doc_id").join(left, "doc_id", "left_anti")
    negated = node.kind == "and" and node.right.kind == "not"
    right = _satisfying(index, node.right.left if negated else node.right, toks)
    if right is None:
        return left
    if left is None:
        return index.docs.select("doc_id").join(right, "doc_id", "left_anti") if negated else right
    if node.kind == "or":
        return left.union(right).distinct()
    return left.join(right, "doc_id", "left_anti" if negated else "left_semi")


def has_field(node: Q.Node | None) -> bool:
    """Whether the tree restricts a term to a field that postings don't keep."""
    return node is not None and (node.kind == "field" and node.value != "category" or has_field(node.left) or has_field(node.right))


def boolean(index: Index, text: str, toks: DataFrame | None = None, algorithm: str = "bm25") -> DataFrame:
    """Matches of the tree, scored by its positive terms; documents that only a
    negation lets in score 0. ``toks``, for fields: tokens, or documents, of which
    only the fields that are asked for are tokenized."""
    tree = Q.parse(text)
    found = satisfying(index, tree, toks)
    terms = Q.positive(tree)
    scores = score_bags(index, [terms], algorithm).drop("query_id", "modified_time")
    joined = found.join(scores, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched", F.lit(0)).alias("matched"), F.lit(len(terms)).alias("total"))
