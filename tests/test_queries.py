import re
import zlib

import pytest

from glyphmill.queries import ORACLES, PAGE_TEXT, QUERIES, text_index
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    ours, theirs = both(spark, sf, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edits_of_all_terms(spark, sf):
    terms = {r["term"] for r in text_index(spark, sf).terms.select("term").collect()}
    assert any(not t.isascii() for t in terms)
    assert {tuple(r) for r in QUERIES["levenshtein_all_terms"](spark, sf).collect()} == {(t, min(edits(t, "thanea"), 3)) for t in terms}


def test_checksums(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["crc32"] for r in QUERIES["crc32_checksums"](spark, sf).collect()} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}


def test_snippets(spark, sf):
    """Every snippet is a window of the body with as many term starts as any, marked."""
    bodies = {r["doc_id"]: r["body_text"] for r in QUERIES["html_body_text"](spark, sf).collect()}
    rows = QUERIES["snippets"](spark, sf).collect()
    assert rows
    for r in rows:
        body, shown = bodies[r["doc_id"]], r["snippet"]
        plain = re.sub("</?em>", "", shown).removeprefix("..." if shown.startswith("...") else "").removesuffix("...")
        at = body.find(plain)
        assert at >= 0 and len(plain) <= 150 and (at == 0) == (not shown.startswith("...")) and (at + len(plain) == len(body)) == (not shown.endswith("..."))
        count = lambda text: sum(len(re.findall(re.escape(t), text)) for t in PAGE_TEXT.split())
        most = max(count(body[k : k + 150]) for k in range(0, len(body), 20))
        assert count(plain) >= most - 2 and shown.count("<em>") <= count(plain.lower())
        assert all(m.lower() in PAGE_TEXT.split() for m in re.findall("<em>(.*?)</em>", shown))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score", "matched"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
