import pytest
from pyspark.sql import functions as F

from glyphmill.functions import html as H

PAGE = (
    '<!DOCTYPE html><html><head><title>Harbour &amp; tide</title><meta name="category" content="Coast"><meta content="Tables of the tides." name="description">'
    '</head><body class="wide"><h2>When to sail</h2><p>Boats leave with the high water.</p><a href="/page/9">Charts</a></body></html>'
)


def get(spark, column, html):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first()["x"]


def test_inline_page(spark):
    h = F.col("html")
    row = spark.createDataFrame([(PAGE,)], "html string").select(
        H.title(h).alias("title"), H.meta(h, "category", "General").alias("category"), H.meta(h, "description", "").alias("description"), H.headings(h).alias("headings"), H.links(h).alias("links"), H.body_text(h).alias("body"),
    ).first()
    assert row["title"] == "Harbour & tide" and row["category"] == "Coast" and row["description"] == "Tables of the tides."
    assert row["headings"] == ["When to sail"] and row["links"] == ["/page/9"]
    assert row["body"] == "When to sailBoats leave with the high water.Charts"


@pytest.mark.parametrize("html,expected", [
    (None, ""), ("", ""), ("a <!-- b", "a"), ("a < b", "a"), ("a<!-- <b> -->c", "ac"), ("x<script>if(a<b){}</script>y", "x"), ("x<script>1</script>y<style>2</style>z", "xyz"),
    ("x<SCRIPT>q<b>r</b>s</SCRIPT>y", "xy"), ("<title>t</title>b", "b"), ("<title>t b", "t b"), ("a&nbsp;&nbsp;b &amp;lt;", "a  b &lt;"), (" \n a\n\n<p> b </p> c ", "a b c"),
])
def test_body_text(spark, html, expected):
    assert get(spark, H.body_text(F.col("html")), html) == expected


def test_defaults_and_attributes(spark):
    h = F.col("html")
    assert get(spark, H.title(h), "<p>x") == "Untitled Document"
    assert get(spark, H.keywords(h), "<meta name='KEYWORDS' content=' a, ,b '><meta name=keywords content=c>") == ["a", "b", "c"]
    assert get(spark, H.links(h), "<a href = '/x'><a class=q href=/y><abbr href=z><!-- <a href=w> -->") == ["/x", "/y"]
    assert get(spark, H.headings(h), "<h1>a<h2>b</h2></h1><H3>c</h3><h4> </h4>") == ["a<h2>b</h2>", "b"]
