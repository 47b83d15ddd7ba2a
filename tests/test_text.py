import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import scoring
from glyphmill.functions import text as T
from glyphmill.plans import query as Q

STEMS = {
    "this": "thi", "does": "doe", "having": "hav", "during": "dur", "themselves": "themselv", "it's": "it'", "ours": "our", "owned": "own", "translation": "transla",
    "boutiques": "boutiqu", "oasis": "oasi", "planning": "plan", "lanterns": "lantern", "string": "str", "passes": "pass", "pass": "pass", "cities": "city", "bed": "bed", "éing": "éing",
}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "w string, s string")
    assert df.where(T.stem(F.col("w")) != F.col("s")).count() == 0
    assert all(Q.stem(w) == s for w, s in STEMS.items())


def test_tokens_of_a_title(spark):
    assert one(spark, F.transform(T.raw_tokens(F.col("t")), T.stem), t="Lantern translation boutiques!") == ["lantern", "transla", "boutiqu"]
    assert one(spark, T.raw_tokens(F.col("t")), t="a--b É-É x_y 'q' ÀA") == ["a--b", "É-É", "x_y", "'q'", "Àa"]
    assert one(spark, T.raw_tokens(F.col("t")), t=None) == []


def test_crc_vector(spark):
    assert one(spark, F.crc32("t"), t="123456789") == 0xCBF43926 == zlib.crc32(b"123456789")


@pytest.mark.parametrize("a,b,most,expected", [("lantirn", "lantern", 2, 1), ("lantirn", "landscape", 2, 3), ("same", "same", 2, 0), ("né", "ne", 2, 2), ("né", "nè", 2, 1)])
def test_levenshtein(spark, a, b, most, expected):
    assert one(spark, T.bounded_levenshtein(F.col("a"), F.col("b"), most), a=a, b=b) == expected
    assert one(spark, T.bounded_levenshtein(F.col("a"), F.col("b"), most, characters=True), a=a, b=b) == (1 if a == "né" else expected)


@pytest.mark.parametrize("text,expected", [("a+b%20c", "a b c"), ("100%", "100%"), ("%zz%41", "%zzA"), ("", "")])
def test_decode_url(spark, text, expected):
    assert one(spark, T.decode_url(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text,expected", [("12x", 12), (" -7", -7), ("x", 0), ("", 0)])
def test_leading_integer(spark, text, expected):
    assert one(spark, T.leading_integer(F.col("t")), t=text) == expected


def test_query_parameters(spark):
    assert one(spark, T.query_parameters(F.col("t")), t="q=a+b&page=1&page=2&x") == {"q": "a b", "page": "2", "x": ""}


VECTORS = [((5, 2, 10, 100, 80), 2.536599, 5.999836), ((1, 1, 52, 60, 60), 3.564827, 4.277145), ((12, 7, 52, 75, 66.5), 3.876990, 10.074344), ((4, 10, 10, 50, 80), 0.084190, 2.386294)]


@pytest.mark.parametrize("values,bm25,tfidf", VECTORS)
def test_score_vectors(spark, values, bm25, tfidf):
    args = dict(zip(("wtf", "df", "n", "dl", "avgdl"), map(float, values)))
    assert one(spark, scoring.bm25(*map(F.col, args)), **args) == pytest.approx(bm25, abs=1e-5)
    assert one(spark, scoring.tfidf(*map(F.col, ("wtf", "df", "n"))), **args) == pytest.approx(tfidf, abs=1e-5)


def test_parser_shapes():
    assert Q.parse("(lantern OR wick) AND glass").kind == "and"
    assert Q.parse("a or(b)").kind == "or"
    assert Q.parse("oregon").value == "oregon"
    assert Q.parse("()") is None and Q.parse("NOT") is None and Q.parse("  ") is None
    assert Q.bag(Q.parse("title:Lanterns x")) == ["lantern", "lantern", "x"]
    assert Q.bag(Q.parse("a AND NOT b")) == ["a", "b"] and Q.positive(Q.parse("a AND NOT b")) == ["a"]
    assert Q.bag(Q.parse("lantern,")) == ["lantern,"]
    assert Q.parse('"Planning lanterns"').terms == ["plan", "lantern"]
    assert Q.bag(Q.parse("NOT NOT x")) == ["not", "x"]


@pytest.mark.parametrize("text,message", [("", "Empty"), ("lantern AND (glass", "Unbalanced"), ('"open', "Unterminated"), ("x" * 257, "length"), ("(" * 21 + "a" + ")" * 21, "depth")])
def test_parser_errors(text, message):
    with pytest.raises(Q.QueryError, match=message):
        Q.parse(text)


@given(st.text(alphabet='ab ()"ANDORNOT:', max_size=40))
def test_parser_never_breaks_otherwise(text):
    try:
        Q.bag(Q.parse(text))
    except Q.QueryError:
        pass
