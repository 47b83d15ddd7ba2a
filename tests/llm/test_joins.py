"""The Jaccard join, its components, and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import components, jaccard, queries, shingles, store
from glyphmill.llm.store import Scratch
from tests.llm import test_array_ops, test_text_ops

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, n=4, percent=85):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    edges = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    parts = roots(edges, {i for i, _ in rows if i is not None})
    return sorted(((i, len(s), parts.get(i)) for i, s in sets), key=repr)


def near_copies(seed, groups=6, members=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    common = [word() for _ in range(55)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([6, 40, 120]))] + (common if rng.random() < 0.5 else [])
        for _ in range(members):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else " \t".join(text))
    rows += [None, "", " \n", "one", "One", "one two three", "ONE two\nthree", "one two three four"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, "one"), (3, rows[3]), (500, "x " * 60_000), (501, "x " * 50_000)]


@pytest.mark.parametrize("seed,few,block", [(1, 32, 512), (2, 3, 7), (3, 2, 5), (4, 1_000, 512)])
def test_components_are_exact(spark, seed, few, block, monkeypatch):
    for name, value in (("FEW", few), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, size int, print string")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_only_blocks_of_different_components_are_dealt(spark, monkeypatch):
    """A bucket of one component is dealt to nobody; one with a few nodes beside its
    largest component is dealt in proportion to its size, not to its square."""
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    docs = spark.createDataFrame([(0, "a b c d e")], "doc_id long, text string")
    join = jaccard.Join(docs, "doc_id", "text", 4, 85)
    dealt = []

    def counted(percent):
        def run(key, table):
            import pyarrow as pa

            return pa.table({"hub": pa.array([table.num_rows], pa.int64()), "node": pa.array([key[2].as_py()], pa.int64())})

        return run

    monkeypatch.setattr(jaccard, "_pairs_of_blocks", counted)
    nodes = spark.range(1_000)
    monkeypatch.setattr(join, "marks", lambda: nodes.select("id", F.lit(b"x").alias("marks"), F.lit(5).alias("size")))
    for others in (0, 7):
        join.scratch = Scratch(spark, "test")
        large = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(False).alias("own"), F.col("id").alias("node"), F.lit(5).cast("long").alias("size"))
        held = nodes.select(F.col("id").alias("node"), F.when(F.col("id") < others, F.col("id")).otherwise(999).alias("component"))
        dealt.append(sum(r["hub"] for r in join.blocked(large, held).collect()))
    assert dealt[0] == 0 and 1_000 <= dealt[1] <= 1_000 + 7 * 102


def test_repeated_rows_are_one_document(spark):
    rows = near_copies(6, groups=2, members=8)
    docs = spark.createDataFrame(rows + [rows[0]] * 50 + [(3, "another text of that id")] * 3, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr) == brute(rows + [rows[0]] * 50 + [(3, "another text of that id")] * 3)


def test_unions_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    rows = near_copies(4, groups=3, members=12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=repr) == brute(rows)
    kept = jaccard.one_of_each(docs)
    expected = {i for i, _, c in brute(rows) if i == c and i is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(expected) and kept.where("doc_id is null").count() == 1
    assert kept.columns == docs.columns and jaccard.near_duplicates(docs.where("false")).count() == 0


def test_op5_on_a_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op5_ngram_jaccard_join(spark, sf).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("texts", [["a b c d e", "", None, "a", "A b  c", "x " * 3, "é ü   y"], ["w " * 10, "word " * 300_000, "tail end"]])
def test_grouped_hashing_is_the_single_one(texts):
    for text, hashes in zip(texts, shingles.shingle_sets(texts, 4)):
        assert hashes.tolist() == shingles.shingle_set(text, 4).tolist() and len(hashes) == len(shingle_set(text, 4))


@pytest.mark.parametrize("at_once", [0, 1000])
@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, 99 - i) for i in range(50)] + [(5, 5), (None, 3), (7, 92)]])
def test_components(spark, edges, at_once, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df, Scratch(spark, "test"), "c").collect()}
    clean = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == roots(clean, {x for e in clean for x in e})


def test_pipeline(spark, sf, monkeypatch):
    import corpus_pipeline

    from glyphmill.llm import decontam, pii, toxicity

    docs = queries.table(spark, sf, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, Scratch(spark, "test").save(stage(spark, kept, sf), name)
        assert kept.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, queries.table(spark, sf, "labels"))
            score = model.scorer()
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in before.collect() if score(r["text"]) < 0.5}
        if name == "ngram_jaccard":
            parts = brute([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in parts if i == c}
        if name == "decontamination":
            assert decontam.find(kept, queries.table(spark, sf, "benchmark")).where("size(items) > 0").count() == 0
            assert {tuple(r) for r in decontam.find(before, queries.table(spark, sf, "benchmark")).where("size(items) < 2").select("id").collect()} == {tuple(r) for r in kept.select("doc_id").collect()}
        if name == "pii":
            monkeypatch.setattr(test_text_ops, "KEY", queries.PSEUDONYM_KEY)
            assert sorted(map(tuple, kept.select("doc_id", "text").collect())) == sorted((r["doc_id"], re.sub(pii.PATTERN, lambda m: test_text_ops.pseudonym(m[0]), r["text"])) for r in before.collect())
    last = corpus_pipeline.run(spark, sf).withColumnRenamed("doc_id", "id").collect()
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted({r["id"] for r in last}) == sorted(i for i, _ in texts)
    used = test_array_ops.check_packing(last, texts, 2048)
    assert used <= 1.02 * sum(r["length"] for r in last) / 2048 + 1


def test_near_copies_of_the_pipeline(spark, sf):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    between = [*base[:30], "x", *base[31:60], "y", *base[61:]]
    rows = [(1, " ".join(base)), (2, " ".join(between)), (3, " ".join(base[:79] + ["z"] * 21)), *((i + 10, t) for i, t in near_copies(5, members=12) if i is not None)]
    assert {i for i, _, c in brute(rows[:2]) if i == c} == {1, 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert kept == sorted({i for i, _, c in brute(rows, n=5, percent=80) if i == c or c is None}) and 2 not in kept


CLASHING = "id int, label int, row int, key int, size int, print int, start int, length int, component int, matches int, seat int, h int"


def odd_documents(spark):
    """Null, empty, very long and repeated texts, null ids, columns of clashing names."""
    words = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (4, None), (5, ""), (6, "long word " * 60_000), (7, "call +1 (017) 555-7713 now"), (7, "call +1 (017) 555-7713 now"), (None, "no id here"), (8, "-- !!")]
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(i, t, None if i == 4 else "en", None if i == 5 else "s", len(t or ""), *range(len(names))) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.mark.parametrize("number", range(5))
def test_stages_take_any_rows(spark, sf, number):
    import corpus_pipeline

    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert stage(spark, docs.where("false"), sf).count() == 0
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    if name == "packing":
        assert sorted(set(ids), key=repr) == sorted({1, 2, 3, 4, 5, 6, 7, 8, None}, key=repr) and {r["length"] for r in rows if r["doc_id"] in (4, 5)} == {1}
        assert sum(r["length"] for r in rows if r["doc_id"] == 6) > 100_000 and sum(r["doc_id"] == 7 for r in rows) == 2
        return
    assert out.columns == docs.columns and out.schema == docs.schema
    assert ids == sorted([1, 4, 5, 6, 7, 8, None] if name == "ngram_jaccard" else [1, 2, 3, 4, 5, 6, 7, 7, 8, None], key=repr)
    before = {(r["doc_id"], r["text"]) for r in docs.collect()}
    changed = {(r["doc_id"], r["text"]) for r in rows} - before
    assert {i for i, _ in changed} == ({7} if name == "pii" else set())
    kept = {r["doc_id"]: tuple(r)[5:] for r in rows}
    assert set(kept.values()) == {tuple(range(12))}


def test_scratch_is_cleared(spark):
    held = Scratch(spark, "test").save(spark.range(3).toDF("id"), "t")
    assert held.count() == 3
    store.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|not exist"):
        spark.read.parquet(held.inputFiles()[0]).count()
