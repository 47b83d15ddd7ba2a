"""The engine's queries over the test tables, and the same rows as DuckDB SQL."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as T
from .functions.scoring import coordination
from .operators import client, index, search, serving, snippet, suggest
from .plans.api import Api
from .sources import corpus, sinks, store
from .sources.shared import app_dir
from .streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TEXT = "clown loser thanedble"
PHRASE = '"eriner thanea"'
PAGE_TEXT = "thnd rest stead"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of fewer files than cores, whose row groups may be large, dealt to all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.plain_documents(dealt(table(spark, sf_dir, "documents")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.parse_pages(dealt(table(spark, sf_dir, "pages")))


def index_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The stored index of a table; built by the first query that asks for it."""
    path = f"{app_dir(spark)}/indexes/{name}-{zlib.crc32(sf_dir.encode()):08x}"
    if not store.versions(spark, path):
        if name == "documents":
            store.build(documents(spark, sf_dir), path, keep_fields=False)
        else:
            store.build(pages(spark, sf_dir), path)
    return path


def text_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return store.load(spark, index_path(spark, sf_dir, "documents"))


def page_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return store.load(spark, index_path(spark, sf_dir, "pages"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- parts of the SQL -------------------------------------------------------

_UP, _LOW = T.UPPER, T.LOWER
_CLASS = "[ \\t\\n\\x0B\\f\\r.,;:!?()\\[\\]{}\"/\\\\<>=+*&|^%$#@~`]+"
_SP = "[ \\t\\n\\x0B\\f\\r]"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({x}, ''), '{_UP}', '{_LOW}'), '{_CLASS}'), lambda t: t <> '')"


def _undouble(w: str) -> str:
    return f"CASE WHEN strlen({w}) >= 3 AND right({w}, 2) = repeat(right({w}, 1), 2) AND strlen(right({w}, 1)) = 1 AND right({w}, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({w}, length({w}) - 1) ELSE {w} END"


def _stem(w: str) -> str:
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return (
        f"CASE WHEN strlen({w}) <= 3 THEN {w} WHEN strlen({w}) > 5 AND suffix({w}, 'ing') THEN {_undouble(cut(3))} WHEN strlen({w}) > 5 AND suffix({w}, 'tion') THEN {cut(4)} "
        f"WHEN strlen({w}) > 4 AND suffix({w}, 'ed') THEN {_undouble(cut(2))} WHEN strlen({w}) > 4 AND suffix({w}, 'ies') THEN {cut(3)} || 'y' "
        f"WHEN strlen({w}) > 4 AND suffix({w}, 'es') THEN {cut(2)} WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN {cut(1)} ELSE {w} END"
    )


def _decode(x: str) -> str:
    for name, char in H.ENTITIES:
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{quoted}')"
    return x


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


_TITLE = "<[tT][iI][tT][lL][eE](?:[^a-zA-Z0-9>][^>]*)?>.*?(?:</title>|</TITLE>)"
_PAGES = f"""
seg AS (SELECT page_id, unnest(s) AS seg, generate_subscripts(s, 1) AS pos FROM
  (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<!--.*?(?:-->|\\z)|{_TITLE}|<[^>]*>|<[^>]*|[^<]+') AS s FROM pages)),
marked AS (SELECT *, CASE WHEN regexp_matches(seg, '(?i)^<script([^a-z0-9]|$)') THEN 1 WHEN regexp_matches(seg, '(?i)^</script([^a-z0-9]|$)') THEN 0 END AS script,
  CASE WHEN regexp_matches(seg, '(?i)^<style([^a-z0-9]|$)') THEN 1 WHEN regexp_matches(seg, '(?i)^</style([^a-z0-9]|$)') THEN 0 END AS style FROM seg),
flagged AS (SELECT *, coalesce(last_value(script IGNORE NULLS) OVER w, 0) + coalesce(last_value(style IGNORE NULLS) OVER w, 0) AS hidden FROM marked
  WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
bodies AS (SELECT page_id, {_trim(_decode(f"regexp_replace(regexp_replace(coalesce(string_agg(seg, '' ORDER BY pos) FILTER (WHERE seg NOT LIKE '<%' AND hidden = 0), ''), '{_SP}+', ' ', 'g'), '^ ', '')"))} AS body_text FROM flagged GROUP BY page_id),
titles AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?s){_TITLE}') THEN {_trim(_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} ELSE 'Untitled Document' END AS title FROM pages),
heads AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<h[0-9][^>]*>(.*?)</h[0-9]>', 1), lambda h: {_trim(_decode("h"))}), lambda h: h <> '') AS headings FROM pages)"""


def _tokens(source: str, id_: str = "doc_id", text: str = "text") -> str:
    return f"""
raw AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS position FROM (SELECT {id_} AS doc_id, {_split(text)} AS l FROM {source})),
stemmed AS (SELECT doc_id, position, raw, {_stem("raw")} AS term FROM raw WHERE strlen(raw) BETWEEN 2 AND 40),
tokens AS (SELECT * FROM stemmed WHERE strlen(term) >= 2)"""


_DOCS = _tokens("documents")
_INDEX = f"""{_DOCS},
postings AS (SELECT term, doc_id, count(*) AS tf, count(*) * 1.0 AS wtf FROM tokens WHERE term NOT IN ({_STOP}) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY term),
lengths AS (SELECT d.doc_id, d.source AS category, count(t.doc_id) AS word_count FROM documents d LEFT JOIN tokens t USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(word_count) AS avgdl FROM lengths)"""
_PAGE_INDEX = f"""{_PAGES},
fields AS (SELECT page_id AS doc_id, 4.0 AS weight, title AS text FROM titles UNION ALL SELECT page_id, 3.0, unnest(headings) FROM heads UNION ALL SELECT page_id, 1.0, body_text FROM bodies),
raw AS (SELECT doc_id, weight, unnest({_split("text")}) AS raw FROM fields),
tokens AS (SELECT * FROM (SELECT doc_id, weight, {_stem("raw")} AS term FROM raw WHERE strlen(raw) BETWEEN 2 AND 40) WHERE strlen(term) >= 2),
postings AS (SELECT term, doc_id, count(*) AS tf, sum(weight) AS wtf FROM tokens WHERE term NOT IN ({_STOP}) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM postings GROUP BY term),
lengths AS (SELECT p.page_id AS doc_id, count(t.doc_id) AS word_count FROM pages p LEFT JOIN tokens t ON t.doc_id = p.page_id GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(word_count) AS avgdl FROM lengths)"""
_BM25 = "greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * word_count / (CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END)))"
_TFIDF = "(1 + ln(wtf)) * (ln((n_docs + 1) / (df + 1)) + 1)"


def _scored(bag: str, formula: str = _BM25) -> str:
    """CTE scored(doc_id, matched, total, score) of a bag of stemmed terms."""
    terms = bag.split()
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    n = len(terms)
    boost = f"sum(s * times) * (1 + 0.5 * sum(times) / {n})" if n > 1 else "sum(s * times)"
    return f"""q(term, times) AS (VALUES {values}),
each AS (SELECT p.doc_id, times, {formula} AS s FROM postings p JOIN q USING (term) JOIN terms USING (term) JOIN lengths l ON l.doc_id = p.doc_id, stats),
scored AS (SELECT doc_id, CAST(sum(times) AS BIGINT) AS matched, CAST({n} AS BIGINT) AS total, {boost} AS score FROM each GROUP BY doc_id HAVING sum(s * times) > 0)"""


_ORDER = "round(score, 6) DESC, matched DESC, doc_id"
_BAG = "clown loser thanedble"


def shown(results: DataFrame) -> DataFrame:
    return results.select("doc_id", F.round("score", 4).alias("score"), F.col("matched").cast("long").alias("matched"))


# --- text -------------------------------------------------------------------


@query(f"WITH {_DOCS} SELECT doc_id, CAST(position AS BIGINT) AS position, raw, term FROM tokens")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(documents(spark, sf_dir), keep_fields=False).select("doc_id", F.col("position").cast("long").alias("position"), "raw", "term")


@query(f"WITH {_DOCS} SELECT raw, term, count(*) AS n FROM tokens GROUP BY raw, term")
def normalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(documents(spark, sf_dir), keep_fields=False).groupBy("raw", "term").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT doc_id, count(*) FILTER (WHERE term IN ({_STOP})) AS n_stop, count(*) FILTER (WHERE term NOT IN ({_STOP})) AS n_kept FROM tokens GROUP BY doc_id")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = T.is_stop_word(F.col("term"))
    return index.tokens(documents(spark, sf_dir), keep_fields=False).groupBy("doc_id").agg(F.count(F.when(stop, 1)).alias("n_stop"), F.count(F.when(~stop, 1)).alias("n_kept"))


@query(f"WITH {_INDEX} SELECT term, df, CAST(cf AS BIGINT) AS cf FROM terms")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).terms


@query(f"WITH {_INDEX} SELECT term, doc_id, tf FROM postings")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(f"WITH {_INDEX} SELECT doc_id, word_count FROM lengths")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).docs.select("doc_id", "word_count")


@query(f"WITH {_INDEX} SELECT n_docs, (SELECT count(*) FROM terms) AS n_terms, round(avgdl, 4) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).stats.select("n_docs", "n_terms", F.round("avgdl", 4).alias("avgdl"))


@query(f"WITH {_DOCS} SELECT doc_id, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM tokens WHERE term = 'thanea' GROUP BY doc_id")
def positions_of_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_index(spark, sf_dir).posting_list("thanea")
    return found.select("doc_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), '0')::BIGINT AS page, nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), '') AS ref FROM pages")
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = T.query_parameters(F.when(F.col("url").contains("?"), F.regexp_replace("url", r"^[^?]*\?", "")).otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", given.alias("p"))
    return rows.select("page_id", T.leading_integer(F.try_element_at("p", F.lit("page"))).alias("page"), F.try_element_at("p", F.lit("ref")).alias("ref"))


@query()
def crc32_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


# --- HTML -------------------------------------------------------------------


@query(f"WITH {_PAGES} SELECT page_id AS doc_id, title FROM titles")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "title")


@query(f"WITH {_PAGES} SELECT page_id AS doc_id, array_to_string(headings, '|') AS headings FROM heads")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", F.array_join("headings", "|").alias("headings"))


@query(f"""SELECT page_id AS doc_id, array_to_string(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: {_trim(_decode("h"))}), '|') AS links FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", F.array_join("links", "|").alias("links"))


@query(f"WITH {_PAGES} SELECT page_id AS doc_id, body_text FROM bodies")
def html_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "body_text")


@query(f"SELECT page_id, {_decode('html')} AS decoded FROM pages")
def html_entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.decode_entities(F.col("html")).alias("decoded"))


@query("SELECT page_id AS doc_id, '' AS description, 'General' AS category, CAST(0 AS BIGINT) AS n_keywords, CAST(strlen(html) AS BIGINT) AS file_size FROM pages")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "description", "category", F.size("keywords").cast("long").alias("n_keywords"), "file_size")


@query(f"WITH {_PAGE_INDEX} SELECT term, doc_id, tf, CAST(wtf AS DOUBLE) AS wtf FROM postings")
def fielded_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_index(spark, sf_dir).postings.select("term", "doc_id", "tf", "wtf")


# --- ranking ----------------------------------------------------------------


@query(f"WITH {_INDEX}, {_scored(_BAG)} SELECT doc_id, round(score, 4) AS score, matched FROM scored ORDER BY {_ORDER} LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = text_index(spark, sf_dir)
    return shown(search.page(search.ranked(ix, TEXT), ix))


@query(f"WITH {_INDEX}, {_scored(_BAG, _TFIDF)} SELECT doc_id, round(score, 4) AS score, matched FROM scored ORDER BY {_ORDER} LIMIT 10")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = text_index(spark, sf_dir)
    return shown(search.page(search.ranked(ix, TEXT, "tfidf"), ix))


@query(f"WITH {_PAGE_INDEX}, {_scored('thnd rest stead')} SELECT doc_id, round(score, 4) AS score, matched FROM scored")
def bm25_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.ranked(page_index(spark, sf_dir), PAGE_TEXT))


@query(f"WITH {_INDEX}, {_scored(_BAG)} SELECT doc_id, round(score, 4) AS score, matched FROM scored")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.ranked(text_index(spark, sf_dir), TEXT))


@query("SELECT doc_id, CAST(1 + n_chars % 3 AS BIGINT) AS matched, round(n_chars * (1 + 0.5 * (1 + n_chars % 3) / 3.0), 4) AS score FROM documents")
def coordination_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = 1 + F.col("n_chars") % 3
    return table(spark, sf_dir, "documents").select("doc_id", matched.alias("matched"), F.round(coordination(F.col("n_chars").cast("double"), matched, F.lit(3)), 4).alias("score"))


@query(f"""WITH {_INDEX}, {_scored(_BAG)}, b AS (SELECT doc_id, round(score, 4) AS bm25_score, row_number() OVER (ORDER BY {_ORDER}) AS bm25_rank FROM scored),
each2 AS (SELECT p.doc_id, times, {_TFIDF} AS s FROM postings p JOIN q USING (term) JOIN terms USING (term), stats),
s2 AS (SELECT doc_id, CAST(sum(times) AS BIGINT) AS matched, sum(s * times) * (1 + 0.5 * sum(times) / 3) AS score FROM each2 GROUP BY doc_id),
t AS (SELECT doc_id, round(score, 4) AS tfidf_score, row_number() OVER (ORDER BY {_ORDER}) AS tfidf_rank FROM s2)
SELECT doc_id, bm25_score, bm25_rank, tfidf_score, tfidf_rank FROM (SELECT * FROM b WHERE bm25_rank <= 50) FULL JOIN (SELECT * FROM t WHERE tfidf_rank <= 50) USING (doc_id)""")
def rank_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = search.compare(text_index(spark, sf_dir), TEXT)
    return both.select("doc_id", F.round("bm25_score", 4).alias("bm25_score"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("tfidf_score", 4).alias("tfidf_score"), F.col("tfidf_rank").cast("long").alias("tfidf_rank"))


@query(f"WITH {_INDEX}, {_scored(_BAG)} SELECT doc_id, round(score, 4) AS score, matched FROM scored ORDER BY {_ORDER} LIMIT 5 OFFSET 10")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = text_index(spark, sf_dir)
    return shown(search.page(search.ranked(ix, TEXT), ix, page=3, page_size=5))


@query(f"WITH {_INDEX}, {_scored(_BAG)} SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages FROM scored")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked(text_index(spark, sf_dir), TEXT).agg(F.count("*").alias("total"))
    return found.select("total", search.page_count(F.col("total"), 7).alias("pages"))


@query(f"WITH {_INDEX}, {_scored('clown clown')} SELECT doc_id, round(score, 4) AS score, matched FROM scored")
def field_term_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.ranked(text_index(spark, sf_dir), "body:clown"))


@query(f"WITH {_INDEX}, {_scored('clown loser')} SELECT doc_id, round(score, 4) AS score, matched FROM scored")
def ranked_ignores_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.ranked(text_index(spark, sf_dir), "clown AND NOT loser"))


def _batch_sql() -> str:
    texts = ["clown loser", "idiot", "thanedble anea eriner"]
    values = ", ".join(f"({i}, '{t}', {len(x.split())})" for i, x in enumerate(texts) for t in x.split())
    return f"""WITH {_INDEX}, q(query_id, term, total) AS (VALUES {values}),
each AS (SELECT query_id, p.doc_id, total, {_BM25} AS s FROM postings p JOIN q USING (term) JOIN terms USING (term) JOIN lengths l ON l.doc_id = p.doc_id, stats),
scored AS (SELECT query_id, doc_id, count(*) AS matched, CASE WHEN max(total) > 1 THEN sum(s) * (1 + 0.5 * count(*) / max(total)) ELSE sum(s) END AS score FROM each GROUP BY ALL HAVING sum(s) > 0)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM scored) WHERE rank <= 10"""


@query(_batch_sql())
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.batch(text_index(spark, sf_dir), ["clown loser", "idiot", "thanedble anea eriner"])
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


# --- boolean ----------------------------------------------------------------


def _boolean_sql(condition: str, bag: str) -> str:
    return f"""WITH {_INDEX}, {_scored(bag)} SELECT l.doc_id, round(coalesce(score, 0), 4) AS score, coalesce(matched, 0) AS matched
FROM lengths l LEFT JOIN scored s ON s.doc_id = l.doc_id WHERE {condition}"""


def _has(term: str) -> str:
    return f"l.doc_id IN (SELECT doc_id FROM postings WHERE term = '{term}')"


@query(_boolean_sql(f"{_has('clown')} AND {_has('loser')}", "clown loser"))
def boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.boolean(text_index(spark, sf_dir), "clown loser"))


@query(_boolean_sql(f"({_has('clown')} OR {_has('loser')})", "clown loser"))
def boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.boolean(text_index(spark, sf_dir), "clown OR loser"))


@query(_boolean_sql(f"{_has('thanedble')} AND NOT ({_has('clown')} OR {_has('loser')})", "thanedble"))
def boolean_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.boolean(text_index(spark, sf_dir), "thanedble AND NOT (clown OR loser)"))


@query(_boolean_sql("l.doc_id IN (SELECT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'eriner' AND b.term = 'thanea')", "eriner thanea"))
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.boolean(text_index(spark, sf_dir), PHRASE))


@query(f"WITH {_PAGE_INDEX} SELECT DISTINCT doc_id FROM tokens WHERE term = 'thnd' AND weight = 4.0")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = page_index(spark, sf_dir)
    return search.boolean(ix, "title:thnd", ix.docs).select("doc_id")


@query(_boolean_sql(f"{_has('clown')} AND NOT {_has('loser')}", "the clown"))
def boolean_stop_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words restrict nothing, whether they are asked for or ruled out."""
    return shown(search.boolean(text_index(spark, sf_dir), "the AND clown AND NOT (loser OR the)"))


@query(f"WITH {_INDEX}, {_scored('and clown')} SELECT doc_id, round(score, 4) AS score, matched FROM scored")
def leading_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leading operator word is a term like others."""
    return shown(search.ranked(text_index(spark, sf_dir), "AND clown"))


_ASKED = [("(clown", 400, "INVALID_QUERY_SYNTAX"), ('"clown', 400, "INVALID_QUERY_SYNTAX"), ("((((((((((((((((((((((clown", 400, "INVALID_QUERY_SYNTAX"), ("w" * 300, 400, "QUERY_TOO_LONG"), ("()", 200, None), ("clown)", 200, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', {n}::BIGINT, {repr(code) if code else 'NULL'})" for q, n, code in _ASKED) + ") t(q, status, code)")
def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the API answers to queries of wrong and of odd syntax."""
    api, rows = Api(text_index(spark, sf_dir)), []
    for q, _, _ in _ASKED:
        status, body = api.search(q)
        rows.append((q, status, json.loads(body).get("code")))
    return spark.createDataFrame(rows, "q string, status long, code string")


@query("SELECT doc_id, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS matched FROM documents WHERE false")
def null_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without a term has no rows, and is no error."""
    return shown(search.ranked(text_index(spark, sf_dir), "()"))


@query(f"WITH {_INDEX}, {_scored(_BAG)} SELECT doc_id, round(score, 4) AS score, matched FROM scored ORDER BY {_ORDER} LIMIT 50")
def page_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages start at 1 and have 50 rows at most."""
    ix = text_index(spark, sf_dir)
    return shown(search.page(search.ranked(ix, TEXT), ix, page=0, page_size=99))


# --- suggestions ------------------------------------------------------------


@query(f"WITH {_INDEX} SELECT term, CAST(cf AS BIGINT) AS cf FROM (SELECT * FROM terms WHERE starts_with(term, 'th') ORDER BY term LIMIT 256) ORDER BY cf DESC, term LIMIT 10")
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest(text_index(spark, sf_dir), "th", 10)


@query(f"""WITH {_INDEX}, pool AS (SELECT * FROM (SELECT * FROM terms ORDER BY term LIMIT 256) ORDER BY cf DESC, term LIMIT 50),
near AS (SELECT term, cf, CAST(levenshtein(term, 'aeaou') AS INT) AS edits FROM pool) SELECT term, edits FROM near WHERE edits <= 2 ORDER BY edits, cf DESC, term LIMIT 1""")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.did_you_mean(text_index(spark, sf_dir), "aeaou")


@query(f"WITH {_INDEX} SELECT term, CAST(least(levenshtein(term, 'thanea'), 3) AS INT) AS edits FROM terms")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances in bytes."""
    return text_index(spark, sf_dir).terms.select("term", T.bounded_levenshtein(F.col("term"), F.lit("thanea"), 2).alias("edits"))


@query()
def levenshtein_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances in characters; no SQL here counts these."""
    return text_index(spark, sf_dir).terms.select("term", T.bounded_levenshtein(F.col("term"), F.lit("thanea"), 2, characters=True).alias("edits"))


@query(f"WITH {_INDEX} SELECT term, CAST(cf AS BIGINT) AS cf FROM (SELECT * FROM terms WHERE starts_with(term, 're') ORDER BY term LIMIT 256)")
def suggest_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest(text_index(spark, sf_dir), "re", -1)


@query(f"WITH {_INDEX}, asked(word) AS (VALUES ('thanea'), ('clown'), ('nowhere')) SELECT word, CAST(coalesce(cf, 0) AS BIGINT) AS cf FROM asked LEFT JOIN terms ON term = word")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = text_index(spark, sf_dir)
    one = lambda w: suggest.word_frequency(ix, w).select(F.lit(w).alias("word"), "cf")
    return one("thanea").union(one("clown")).union(one("nowhere"))


# --- store ------------------------------------------------------------------


@query(f"""WITH {_INDEX} SELECT 'docs' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 'postings', count(*) FROM postings UNION ALL SELECT 'terms', count(*) FROM terms UNION ALL SELECT 'stats', 1""")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored tables as the manifest has them, after a check of all rows."""
    path = index_path(spark, sf_dir, "documents")
    store.load(spark, path, verify=True)
    told = store.manifest(spark, path)["tables"]
    return spark.createDataFrame([(name, told[name]["rows"]) for name in store.TABLES], "name string, n_rows long")


_CHANGED = """changed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zzupdated ' || coalesce(text, '') ELSE text END AS text, source FROM documents
UNION ALL SELECT doc_id + 1000000000, 'zzadded zzadded', source FROM documents WHERE doc_id % 10 = 1)"""


def _updated(spark: SparkSession, sf_dir: str) -> index.Index:
    docs, path = documents(spark, sf_dir), _scratch(spark, "updates")
    store.build(docs, path, keep_fields=False)
    changed = docs.where("doc_id % 3 = 0").withColumn("body_text", F.concat(F.lit("zzupdated "), "body_text"))
    added = docs.where("doc_id % 10 = 1").withColumns({"doc_id": F.col("doc_id") + 1_000_000_000, "body_text": F.lit("zzadded zzadded")})
    for epoch, batch in enumerate((changed, changed, added)):
        updates.apply_batch(batch, max(0, epoch - 1), path)
    return store.load(spark, path)


@query(f"WITH {_CHANGED}, {_tokens('changed')} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tokens WHERE term NOT IN ({_STOP}) GROUP BY term")
def updated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a stored index after two micro-batches, one of them repeated."""
    return _updated(spark, sf_dir).terms


@query(f"WITH {_CHANGED}, {_tokens('changed')} SELECT term, doc_id, count(*) AS tf FROM tokens WHERE term NOT IN ({_STOP}) GROUP BY ALL")
def updated_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).postings.select("term", "doc_id", "tf")


@query(f"WITH {_INDEX} SELECT term, coalesce(count(p.doc_id), 0) AS df, CAST(coalesce(sum(tf), 0) AS BIGINT) AS cf FROM terms LEFT JOIN (SELECT * FROM postings WHERE doc_id % 2 = 1) p USING (term) GROUP BY term")
def removed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms after a removal that leaves documents and terms in place."""
    ix = text_index(spark, sf_dir)
    return ix.without(ix.docs.where("doc_id % 2 = 0")).terms


@query(f"WITH {_INDEX} SELECT count(*) AS n_docs, (SELECT count(DISTINCT term) FROM postings WHERE doc_id % 2 = 1) AS n_terms, round(avg(word_count), 4) AS avgdl FROM lengths WHERE doc_id % 2 = 1")
def purged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = text_index(spark, sf_dir)
    return ix.without(ix.docs.where("doc_id % 2 = 0"), purge=True).stats.select("n_docs", "n_terms", F.round("avgdl", 4).alias("avgdl"))


@query(f"WITH {_DOCS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tokens WHERE term NOT IN ('thanea', 'clown', 'the') GROUP BY term")
def stop_word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with the stop words of a file."""
    path = _scratch(spark, "stop-words")
    spark.createDataFrame([("  thanea\n\nclown\nthe",)], "value string").coalesce(1).write.text(path)
    return index.build(documents(spark, sf_dir), corpus.stop_words(spark, path), keep_fields=False, positions=False).terms


# --- corpus and sinks -------------------------------------------------------


def _html_folder(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "html")
    corpus.write_html_files(table(spark, sf_dir, "pages"), path)
    return path


@query("SELECT page_id, coalesce(html, '') AS html FROM pages")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as files, and scanned again."""
    return corpus.html_files(spark, _html_folder(spark, sf_dir)).select("page_id", "html")


@query("SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id BETWEEN 1 AND 50")
def corpus_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of a rebuild, which takes the ids up to 50."""
    return corpus.html_files(spark, _html_folder(spark, sf_dir), 50).select("page_id", "html")


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, '/page/' || p_partkey AS path, p_name AS title, p_brand AS category, p_type || ' & ' || p_brand AS description, replace(p_type, ' ', '|') AS keywords, p_name || '|Related' AS headings,
'/page/' || p_size || '|/page/' || (p_size + 1) AS links FROM part""")
def generated_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records rendered as pages with meta tags, and parsed again."""
    records = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.replace("p_type", F.lit(" "), F.lit(", ,")).alias("keywords"),
        F.concat("p_type", F.lit(" &amp; "), "p_brand").alias("description"), F.col("p_name").alias("heading"), F.col("p_type").alias("content"), F.col("p_size").alias("link1"), (F.col("p_size") + 1).alias("link2"),
    )
    # a table of short rows is one row group or a few, and its pages take some time
    found = index.parse_pages(corpus.generated_pages(records.repartition(3 * spark.sparkContext.defaultParallelism)))
    return found.select("doc_id", "path", "title", "category", "description", *(F.array_join(c, "|").alias(c) for c in ("keywords", "headings", "links")))


@query("SELECT 'some' AS asked, doc_id FROM documents WHERE contains(lower(source), 'rc7') OR contains(lower(lang), 'rc7') UNION ALL SELECT 'none', doc_id FROM documents")
def mock_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline source: matches, or all rows if there is none."""
    docs = table(spark, sf_dir, "documents")
    one = lambda name, text: corpus.canned_search(docs, text, "source", "lang").select(F.lit(name).alias("asked"), "doc_id")
    return one("some", "RC7").union(one("none", "no such text"))


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END"


@query(f"""SELECT CAST(json_object('timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), 'level', {_LEVEL}, 'event_id', event_id, 'user_id', user_id) AS VARCHAR) AS value FROM events WHERE event_type <> 'click'""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.log_lines(table(spark, sf_dir, "events").select("ts", F.expr(_LEVEL).alias("level"), "event_id", "user_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def bookmark_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks written as JSON and read again."""
    path = _scratch(spark, "bookmarks")
    sinks.export_json(client.bookmarked(table(spark, sf_dir, "documents").select("doc_id", "source"), _bookmarks(spark, sf_dir), "doc_id"), path)
    return spark.read.schema("doc_id long, source string").json(path)


@query("SELECT page_id, url || ' a&b%zz%' AS decoded FROM pages")
def url_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("."), F.lit("%2e")), F.lit("+a%26b%zz%"))
    return table(spark, sf_dir, "pages").select("page_id", T.decode_url(raw).alias("decoded"))


@query("SELECT doc_id, CAST(json_object('text', text) AS VARCHAR) AS json FROM documents")
def json_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("json"))


# --- client and serving -----------------------------------------------------


@query(f"""WITH {_INDEX}, {_scored(_BAG)}, page AS (SELECT * FROM scored ORDER BY {_ORDER} LIMIT 50)
SELECT s.doc_id, category, round(score, 4) AS score FROM page s JOIN lengths l ON l.doc_id = s.doc_id WHERE contains(lower(category), 'src1')""")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter looks at the current page only."""
    ix = text_index(spark, sf_dir)
    shown = search.page(search.ranked(ix, TEXT), ix, page_size=50).join(ix.docs.select("doc_id", "category"), "doc_id")
    return client.in_category(shown, "SRC1").select("doc_id", "category", F.round("score", 4).alias("score"))


def _bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id")).distinct()


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def bookmark_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.bookmarked(table(spark, sf_dir, "documents"), _bookmarks(spark, sf_dir), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def bookmark_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.not_bookmarked(table(spark, sf_dir, "documents"), _bookmarks(spark, sf_dir), "doc_id").select("doc_id", "source")


@query("""WITH a AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'signup')
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def bookmark_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("doc_id")).distinct()
    return client.toggle_bookmark(_bookmarks(spark, sf_dir), rows, "doc_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.newest(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def console_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.at_level(table(spark, sf_dir, "events"), "error", "event_type").select("event_id", "user_id")


@query("SELECT page_id, url FROM pages WHERE page_id BETWEEN 1 AND 5 AND page_id <> 2 ORDER BY page_id LIMIT 3")
def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.related(table(spark, sf_dir, "pages"), 2, "page_id").select("page_id", "url")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(source), 'rc7') OR contains(lower(lang), 'rc7')")
def panel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.panel_search(table(spark, sf_dir, "documents"), "RC7", "source", "lang").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(source), 'e') OR contains(lower(lang), 'e')")
def panel_search_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.panel_search(table(spark, sf_dir, "documents"), "E", "source", "lang").select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_incognito(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.newest(table(spark, sf_dir, "events"), "ts", "event_id", incognito=F.col("user_id") % 3 == 0).select("event_id", "user_id")


@query("SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'purchase' ORDER BY doc_id LIMIT 5")
def bookmarks_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.bookmarks_bar(_bookmarks(spark, sf_dir), "doc_id")


@query("SELECT conv_id, turn, length(trim(coalesce(text, ''), ' ')) >= 2 AS in_search, length(trim(coalesce(text, ''), ' ')) >= 1 AS in_omnibox FROM conversations")
def suggestion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", client.wants_suggestions(F.col("text")).alias("in_search"), client.wants_suggestions(F.col("text"), "omnibox").alias("in_omnibox"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'search' WHEN 2 THEN 'bookmarks' WHEN 3 THEN 'admin' ELSE 'search' END AS kind,
CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'a b' || page_id WHEN 4 THEN 'some words ' || page_id ELSE '' END AS value FROM pages""")
def address_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    typed = F.when(k == 0, F.concat(F.lit("page/"), id_)).when(k == 1, F.concat(F.lit("search?q=a+b"), id_)).when(k == 2, "app://bookmarks").when(k == 3, " admin ").otherwise(F.concat(F.lit(" some words "), id_))
    return table(spark, sf_dir, "pages").select("page_id", client.route(typed).alias("r")).select("page_id", "r.kind", "r.value")


@query("SELECT n_name AS id, CASE n_name WHEN 'PERU' THEN 'changed' ELSE 'tab' END AS title FROM nation WHERE n_name <> 'FRANCE' UNION ALL SELECT 'new', 'tab'")
def tab_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs after one was opened, one changed and one closed."""
    tabs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("tab").alias("title"))
    opened = client.open_tab(tabs, spark.range(1).select(F.lit("new").alias("id"), F.lit("tab").alias("title")))
    return client.close_tab(client.update_tab(opened, "PERU", title="changed"), "FRANCE")


_REPLAY = """WITH e AS (SELECT event_type || (user_id // 300) % 16 AS node, event_id AS request, CAST(user_id AS VARCHAR) AS key, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events),
replayed AS (SELECT a.node, a.request, a.key, a.prev IS NOT NULL AND count(DISTINCT b.key) < 256 AS hit FROM e a LEFT JOIN e b ON a.node = b.node AND b.request > a.prev AND b.request < a.request GROUP BY a.node, a.request, a.key, a.prev)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat("event_type", (F.floor(F.col("user_id") / 300) % 16).cast("string"))
    return serving.replay_cache(table(spark, sf_dir, "events").withColumn("node", node), "node", "user_id", "event_id")


@query(f"{_REPLAY} SELECT * FROM replayed")
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches of many serving nodes, each with its own requests."""
    return _replayed(spark, sf_dir)


@query(f"{_REPLAY} SELECT node, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 4) AS rate FROM replayed GROUP BY node UNION ALL SELECT 'idle', 100.0")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _replayed(spark, sf_dir).groupBy("node").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    idle = spark.range(1).select(F.lit("idle").alias("node"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"))
    return counts.union(idle).select("node", F.round(serving.hit_rate(F.col("hits"), F.col("misses")), 4).alias("rate"))


def _bucket_sql(burst: int, rate: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS request, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
r AS (SELECT key, request, k, s, {burst - 1} AS tokens, true AS allowed FROM e WHERE k = 1
UNION ALL SELECT key, request, k, s, CAST(CASE WHEN a >= 1 THEN a - 1 ELSE a END AS INT), a >= 1 FROM (SELECT e.*, least({burst}, r.tokens + (e.s - r.s) * {rate}) AS a FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
SELECT key, request, allowed FROM r"""


@query(_bucket_sql(serving.BURST, serving.RATE))
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.limit_rate(table(spark, sf_dir, "events"))


@query(_bucket_sql(3, 0))
def token_bucket_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small buckets that nothing refills, so that requests are turned away."""
    return serving.limit_rate(table(spark, sf_dir, "events"), burst=3, rate=0)


_FNV = f"""hashed AS (SELECT term, list_reduce(list_transform(range(1, strlen(term) + 1), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(hex(encode(term)), 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(term)), 2 * i, 1)) - 1 AS HUGEINT)),
  lambda h, b: (xor(h, b) * {serving.FNV_PRIME}) % 18446744073709551616, CAST({serving.FNV_OFFSET} AS HUGEINT)) AS h FROM terms)"""


@query(f"WITH {_INDEX}, {_FNV} SELECT term, CAST(h // 4294967296 AS BIGINT) AS high, CAST(h % 4294967296 AS BIGINT) AS low FROM hashed")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).terms.select("term", serving.fnv1a(F.col("term")).alias("h")).select("term", "h.high", "h.low")


@query(f"""WITH {_INDEX}, {_FNV}, sized AS (SELECT count(*) AS n, CAST(4096 * power(2, ceil(log2(greatest(1, (count(*) - 1) / 0.75 / 4096)))) AS BIGINT) AS buckets FROM terms)
SELECT n AS unique_terms, buckets, n / buckets AS load_factor, n - (SELECT count(DISTINCT h % buckets) FROM hashed) AS hash_collisions FROM sized""")
def fnv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.table_stats(text_index(spark, sf_dir).terms)


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = page_index(spark, sf_dir)
    top = search.page(search.ranked(ix, PAGE_TEXT), ix).join(ix.docs, "doc_id")
    return top.select("doc_id", snippet.snippet_column(F.col("body_text"), PAGE_TEXT).alias("snippet"))


@query(f"""WITH {_PAGE_INDEX}, {_scored('thnd rest stead')} SELECT s.doc_id AS id, title, '/page/' || s.doc_id AS url, 'General' AS category, round(score, 4) AS score, (SELECT count(*) FROM scored) AS total
FROM scored s JOIN titles ON page_id = s.doc_id ORDER BY {_ORDER.replace("doc_id", "s.doc_id")} LIMIT 10""")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the API's answer to a search."""
    told = json.loads(Api(page_index(spark, sf_dir)).handle("GET", f"/search?q={PAGE_TEXT.replace(' ', '+')}")[1])
    rows = [(r["id"], r["title"], r["url"], r["category"], r["score"], told["total"]) for r in told["results"]]
    return spark.createDataFrame(rows, "id long, title string, url string, category string, score double, total long")


@query(f"""WITH {_PAGE_INDEX} SELECT page_id AS id, title, '' AS description, 'General' AS category, body_text, word_count FROM titles JOIN bodies USING (page_id) JOIN lengths ON doc_id = page_id WHERE page_id IN (1, 7)""")
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API's answers to lookups by id."""
    api = Api(page_index(spark, sf_dir))
    told = [json.loads(api.handle("GET", f"/page/{i}")[1]) for i in (1, 7)]
    schema = "id long, title string, description string, category string, body_text string, word_count long"
    return spark.createDataFrame([tuple(t[c.split()[0]] for c in schema.split(", ")) for t in told], schema)


@query(f"""WITH {_INDEX}, {_FNV}, sized AS (SELECT count(*) AS n, CAST(4096 * power(2, ceil(log2(greatest(1, (count(*) - 1) / 0.75 / 4096)))) AS BIGINT) AS buckets FROM terms)
SELECT (SELECT count(*) FROM documents) AS documents_indexed, n AS unique_terms, round(n / buckets, 4) AS load_factor, n - (SELECT count(DISTINCT h % buckets) FROM hashed) AS hash_collisions, 'ok' AS status FROM sized""")
def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API's statistics and health."""
    api = Api(text_index(spark, sf_dir))
    told, health = (json.loads(api.handle("GET", f"/api/v1/{route}")[1]) for route in ("stats", "health"))
    row = (told["documents_indexed"], told["unique_terms"], told["load_factor"], told["hash_collisions"], health["status"])
    return spark.createDataFrame([row], "documents_indexed long, unique_terms long, load_factor double, hash_collisions long, status string")


@query(f"WITH {_INDEX} SELECT term FROM (SELECT * FROM (SELECT * FROM terms WHERE starts_with(term, 'an') ORDER BY term LIMIT 256) ORDER BY cf DESC, term LIMIT 5)")
def suggest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = json.loads(Api(text_index(spark, sf_dir)).handle("GET", "/suggest?q=an")[1])
    return spark.createDataFrame([(t,) for t in told["suggestions"]], "term string")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def requests_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.windowed_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest(table(spark, sf_dir, "documents"), "source", "n_chars", "doc_id").select("doc_id", "source", "n_chars")
