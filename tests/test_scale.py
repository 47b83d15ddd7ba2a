"""Steps of the engine that must not grow faster than their input."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import html as H
from glyphmill.functions import rows as R
from glyphmill.functions import text as T
from glyphmill.functions.scoring import field_weight
from glyphmill.operators import index, search
from glyphmill.queries import QUERIES, dealt
from glyphmill.sources import store
from glyphmill.streaming import updates

ODD = [
    (1, "Running Tests, the tests RAN; buses buzzed é ÉÉing ponies", "Stopped stopping", ["Heads  the Ties", None, ""], ["a,b", "keyed"]),
    (2, "", None, [], []), (3, None, "title only", ["x"], []), (4, "the the the 'em it's " + "w" * 41 + " " + "é" * 20 + "s " + "é" * 21, None, [], []),
    (5, "aing bed ed ied ties passes pass tion station x" * 30, "", [], ["Action"]), (None, "nobody's words", "t", [], []),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, body_text string, title string, headings array<string>, keywords array<string>")
    return rows.withColumns({"description": F.lit("Described"), "category": F.lit("c"), "modified_time": F.lit(0).cast("long")})


def by_tokens(docs, stop_words=None, keep_fields=True):
    """The same postings and word counts from the tokenizer's columns, by a shuffle."""
    toks = index.tokens(docs, keep_fields)
    kept = toks.where(~T.is_stop_word(F.col("term"), stop_words)).groupBy("term", "doc_id")
    found = kept.agg(F.count("*").alias("tf"), F.sum(field_weight(F.col("field"))).alias("wtf"), F.array_sort(F.collect_list("position")).alias("positions"))
    return sorted(map(repr, found.collect())), {r["doc_id"]: r["count"] for r in toks.groupBy("doc_id").count().collect()}


@pytest.mark.parametrize("stop_words,keep_fields", [(None, True), (None, False), (["test"], True)])
def test_postings_are_grouped_without_a_shuffle(odd, stop_words, keep_fields):
    found = index.grouped(odd, stop_words, keep_fields)
    assert "Exchange" not in plan(found) and "Aggregate" not in plan(found)
    rows, counts = by_tokens(odd, stop_words, keep_fields)
    assert sorted(map(repr, found.collect())) == rows
    sized = index.word_counts(odd, keep_fields)
    assert "Exchange" not in plan(sized)
    assert {r["doc_id"]: r["word_count"] for r in sized.collect()} == {i: counts.get(i, 0) if i else 0 for i, *_ in ODD}


def test_repeated_ids_are_summed_up(odd):
    twice = odd.where("doc_id < 5").union(odd.where("doc_id = 1"))
    ix = index.build(twice)
    rows, counts = by_tokens(twice)
    assert sorted(map(repr, ix.postings.collect())) == rows
    assert all(r["word_count"] == counts.get(r["doc_id"], 0) for r in ix.docs.collect()) and ix.docs.count() == 5


def test_update_shuffles_no_postings(spark, odd, tmp_path):
    """Ids of changed documents are broadcast; a batch without repeated ids isn't ranked."""
    docs, path = odd.where("doc_id < 4").withColumns({"path": F.lit(""), "links": F.array().cast("array<string>"), "file_size": F.lit(0).cast("long")}), f"file://{tmp_path}/ix"
    store.build(docs, path)
    for k in (1, 2):
        assert updates.apply_batch(docs.where(F.col("doc_id") == k).withColumn("body_text", F.lit("changed text")), k, path)
    ix = store.load(spark, path)
    with_ids = [line for line in plan(ix.postings).splitlines() if "Join" in line]
    assert len(with_ids) == 2 and all("BroadcastHashJoin" in line for line in with_ids) and "Exchange hash" not in plan(ix.postings)
    whole = docs.withColumn("body_text", F.when(F.col("doc_id") < 3, "changed text").otherwise(F.col("body_text")))
    rows, _ = by_tokens(whole)
    assert sorted(map(repr, ix.postings.select("term", "doc_id", "tf", "wtf", "positions").collect())) == rows
    ids = docs.where("doc_id = 3")
    assert "BroadcastHashJoin" in plan(ix.without(ids).postings) and "SortMergeJoin" not in plan(ix.without(ids).postings)
    assert {r["doc_id"] for r in ix.without(ids).postings.collect()} == {1, 2}


PAGES = [
    None, "", "a < b", "<title>t &amp;</title><TITLE x>u\n</TITLE> b", "<title>t b", "x<SCRIPT>q<b>r</b>s</SCRIPT>y<style>2<script>3</style>4</script>5", "a<!-- <b> <a href=w>-->c<a href = '/x'><a class=q href=/y><abbr href=z>",
    "<meta name='KEYWORDS' content=' a, ,b '><meta name=keywords content=c,><meta name=description content='&lt;d&gt; '><meta name=category><META name=category content=K>", "<h1>a<h2>b</h2></h1><H3>c</h3><h4> </h4><h5 class=x>&amp;lt;\x0b</h5><h12>no</h1>",
    "<p>\x0b é   \n&nbsp;z<br", "<scripty>s</scripty><style/>t<title></title>", "<h1>x<!-- y --></h1><h2><title>t</title>u</h2>", "﻿<Keta><aſ href=q>text",
]


def test_fields_of_pages_are_those_of_the_columns(spark):
    """One walk over a page, which is cut once for all fields."""
    html = F.col("html")
    rows = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").withColumn("url", F.lit("/u"))
    columns = rows.select(
        "page_id", H.title(html).alias("title"), H.meta(html, "description", "").alias("description"), H.meta(html, "category", "General").alias("category"),
        H.keywords(html).alias("keywords"), H.headings(html).alias("headings"), H.links(html).alias("links"), H.body_text(html).alias("body_text"),
    ).orderBy("page_id").drop("page_id")
    found = index.parse_pages(rows)
    assert plan(found).count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan(found)
    assert found.orderBy("doc_id").select(*columns.columns).collect() == columns.collect()


def test_field_restriction_tokenizes_that_field_only(spark, odd, tmp_path):
    odd.write.parquet(f"file://{tmp_path}/docs")
    odd = spark.read.parquet(f"file://{tmp_path}/docs")
    ix = index.build(odd)
    for text, field, term in (("title:test", "title", "stopp"), ("heading:tie", "heading", "tie"), ("keywords:key", "keywords", "key"), ("body:test", "body", "test")):
        expected = {r["doc_id"] for r in index.tokens(odd).where((F.col("field") == field) & (F.col("term") == term)).collect()}
        query = f"{field}:{term}"
        assert {r["doc_id"] for r in search._field(ix, odd, field, term).collect()} == expected, query
    assert "body_text" not in re.search("ReadSchema: .*", plan(search._field(ix, ix.docs, "title", "stopp")))[0]


def test_few_files_are_dealt_to_all_cores(spark, sf):
    n = spark.sparkContext.defaultParallelism
    assert QUERIES["generated_meta"](spark, sf).rdd.getNumPartitions() == 3 * n
    assert dealt(spark.read.parquet(f"{sf}/pages.parquet")).rdd.getNumPartitions() == n


def test_terms_of_a_plan_take_one_shuffle(odd):
    """The terms of an index that isn't stored: postings are not shuffled for them."""
    ix = index.build(odd, ["test"], positions=False)
    assert plan(ix.terms).count("Exchange") == 1
    assert ix.terms.agg(F.sum("cf")).first()[0] == ix.postings.agg(F.sum("tf")).first()[0] > 0


@pytest.mark.parametrize("stop_words,keep_fields", [(None, True), (None, False), (["test", "thi", "é"], True), ([], False)])
def test_terms_of_a_plan_make_no_postings(odd, stop_words, keep_fields):
    """What leaves the documents' tasks for the terms are sums over many documents."""
    control = odd.where("doc_id = 1").withColumns({"doc_id": F.lit(9).cast("long"), "body_text": F.lit("a\x1cbc\x0bde\x00f\x85g\u2003Hi~ss ings ssed ff[eed]égged")})
    docs = odd.union(control)
    ix = index.build(docs, stop_words, keep_fields, positions=False)
    assert not re.search(r"\btf#", plan(ix.terms))
    toks = index.tokens(docs, keep_fields).where(~T.is_stop_word(F.col("term"), stop_words))
    expected = Counter(map(tuple, toks.select("term", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")).collect()))
    df, cf = Counter(t for t, _ in expected), Counter()
    for (term, _), n in expected.items():
        cf[term] += n
    assert sorted(map(tuple, ix.terms.collect())) == sorted((t, n, cf[t]) for t, n in df.items())


@pytest.mark.parametrize("portion", [1, 100, 10_000])
def test_portions_of_documents_count_as_the_whole(monkeypatch, portion):
    monkeypatch.setattr(R, "PORTION", portion)
    texts = [None, "", " ", *(f"word{k % 7} words both ties tied {'x' * (k % 45)}" for k in range(60)), "w" * 500, "last tie"]
    rows = pa.RecordBatch.from_pydict({"body_text": pa.array(texts), "headings": pa.array([None, [], [None, "tie a"], *[["both"]] * (len(texts) - 3)], pa.list_(pa.string()))})
    df, cf = Counter(), Counter()
    for made in R.term_counts(iter([rows.slice(0, 20), rows.slice(20, 0), rows.slice(20)]), ["headings", "body_text"], ["last"]):
        assert len(set(made["term"].to_pylist())) == made.num_rows > 0
        for r in made.to_pylist():
            df[r["term"]] += r["df"]
            cf[r["term"]] += r["cf"]
    terms = R.Terms(["last"])
    docs = [[terms[w] for t in [*(h or []), b] for w in R.words(t and t.encode())] for h, b in zip(rows["headings"].to_pylist(), texts)]
    assert {t.encode(): n for t, n in cf.items()} == Counter(t for d in docs for t in d if t)
    assert {t.encode(): n for t, n in df.items()} == Counter(t for d in docs for t in set(d) if t)
    assert not list(R.term_counts(iter([rows.slice(0, 2)]), ["body_text"], None))


def test_stems_of_an_array_are_those_of_words():
    words = [a + b + c for a in (b"", b"s", b"ab", b"hopp", "é".encode(), b"agre", b"pas") for b in (b"", b"s", b"ss", b"pp", b"ee", b"\x80\x80", "ée".encode()) for c in (b"", b"ing", b"tion", b"ed", b"ies", b"es", b"s", b"ss", b"ied")]
    array = pa.array(words, pa.large_binary())
    assert R.stems(array).to_pylist() == [R.stem(w) for w in words]
    assert R.stems(array.slice(7, 40)).to_pylist() == [R.stem(w) for w in words[7:47]] and len(R.stems(array.slice(0, 0))) == 0


@pytest.mark.parametrize("few", [True, False])
def test_postings_for_terms_are_of_repeated_ids_only(monkeypatch, odd, few):
    """One repeated id doesn't send the words of all documents through a shuffle."""
    if not few:
        monkeypatch.setattr(index, "FEW_IDS", 0)
    docs = odd.union(odd.where("doc_id = 1 or doc_id is null"))
    ix = index.build(docs, ["test"], positions=False)
    expected = sorted(map(tuple, index.term_table(ix.postings).collect()))
    assert sorted(map(tuple, ix.terms.collect())) == expected
    assert len(expected) > 20
    assert "LeftSemi" in plan(ix.terms) and few <= ("BroadcastHashJoin" in plan(ix.terms))
