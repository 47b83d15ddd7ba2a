import json

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import client, index, search, serving, snippet, suggest
from glyphmill.plans.api import Api
from glyphmill.sources import corpus, sinks, store
from glyphmill.streaming import limiter, updates

DOCS = [(1, "Lantern Making", "Lantern glass holders keep flames from strong winds.", "Lanterns"), (2, None, "Sailing ship rigging and spare canvas.", "Ships"),
        (3, "Wicks", "A wick feeds the lantern; the wick is short.", "Lanterns"), (4, None, "", "Empty"), (5, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, title string, text string, source string")
    return index.plain_documents(rows).drop("title").join(rows.select("doc_id", "title"), "doc_id")


@pytest.fixture(scope="module")
def ix(docs):
    return index.build(docs).cached()


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_positions_run_over_dropped_tokens(spark):
    rows = index.plain_documents(spark.createDataFrame([(1, "a I xx the yy", "s")], "doc_id long, text string, source string"))
    assert [(r["term"], r["position"]) for r in index.tokens(rows).orderBy("position").collect()] == [("xx", 3), ("the", 4), ("yy", 5)]


def test_weights_and_counts(ix):
    row = ix.postings.where("term = 'lantern' and doc_id = 1").first()
    assert (row["tf"], row["wtf"], row["positions"]) == (2, 5.0, [1, 3])
    assert {r["doc_id"]: r["word_count"] for r in ix.docs.collect()} == {1: 10, 2: 6, 3: 9, 4: 0, 5: 0}


def test_boolean_modes(ix, docs):
    toks = index.tokens(docs)
    find = lambda q: ids(search.boolean(ix, q, toks))
    assert find("lantern wick") == [3] and find("lantern OR rigging") == [1, 2, 3] and find("lantern AND NOT wick") == [1]
    assert find("NOT lantern") == [2, 4, 5] and find('"spare canvas"') == [2] and find('"canvas spare"') == [] and find('"wick feeds the lantern"') == [3]
    assert find("title:wick") == [3] and find("body:making") == [] and find("category:ships") == [2]


def test_ranked_ignores_the_tree(ix):
    assert ids(search.ranked(ix, "lantern AND NOT rigging")) == [1, 2, 3]
    assert ids(search.ranked(ix, "lantern,")) == []


def test_paging(ix):
    found = search.ranked(ix, "lantern rigging")
    assert [r["doc_id"] for r in search.page(found, ix, 1, 2).collect()] + [r["doc_id"] for r in search.page(found, ix, 2, 2).collect()] == [r["doc_id"] for r in search.page(found, ix).collect()]
    assert search.page(found, ix, 9).count() == 0 and search.clamp(0, 99) == (1, 50)


def test_removal(spark, ix):
    gone = spark.createDataFrame([(3,)], "doc_id long")
    left, purged = ix.without(gone), ix.without(gone, purge=True)
    assert left.terms.where("term = 'wick'").first()["df"] == 0 and left.stats.first()["n_docs"] == 5
    assert purged.terms.where("term = 'wick'").count() == 0 and purged.stats.first()["n_docs"] == 4


def test_suggestions(spark):
    terms = spark.createDataFrame([("lantern", 10), ("lantana", 8), ("lance", 5)], "term string, cf long")
    ix = index.Index(None, None, terms, None)
    assert [r["term"] for r in suggest.suggest(ix, "lan", 5).collect()] == ["lantern", "lantana", "lance"]
    assert suggest.did_you_mean(ix, "lantirn").first()["term"] == "lantern" and suggest.did_you_mean(ix, "zzz").first() is None
    assert suggest.word_frequency(ix, "lance").first()["cf"] == 5


def test_snippet():
    text = "word " * 40 + "the lantern is a lantern, here. " + "tail " * 40
    out = snippet.snippet(text, "lanterns")
    assert "<em>lantern</em>" in out and out.startswith("...") and out.endswith("...")
    assert snippet.snippet(None, "x") == "" and snippet.snippet("Lanterns lantern-x lantern", "lantern") == "Lanterns lantern-x <em>lantern</em>"


def test_store(spark, docs, ix, tmp_path):
    path = f"file://{tmp_path}/ix"
    store.save(ix, path)
    back = store.load(spark, path, verify=True)
    assert back.terms.count() == ix.terms.count() and ids(search.ranked(back, "lantern")) == [1, 3]
    built = store.build(docs, f"file://{tmp_path}/built")
    assert sorted(map(repr, built.postings.collect())) == sorted(map(repr, ix.postings.select(*built.postings.columns).collect()))
    assert sorted(map(repr, built.stats.collect())) == sorted(map(repr, ix.stats.collect())) and {r["doc_id"]: r["word_count"] for r in built.docs.collect()} == {r["doc_id"]: r["word_count"] for r in ix.docs.collect()}
    assert store.build(docs.where("false"), f"file://{tmp_path}/none").postings.count() == 0
    spark.createDataFrame([('{"format": "other", "version": 1}',)], "value string").write.mode("overwrite").text(f"{path}/v1/manifest")
    with pytest.raises(store.StoreError):
        store.load(spark, path)


def test_api(ix):
    api = Api(ix, lambda: ix)
    status, body = api.handle("GET", "/api/v1/search?q=lantern+flames&page_size=1")
    found = json.loads(body)
    assert status == 200 and found["total"] == 2 and found["results"][0]["id"] == 1 and found["did_you_mean"] is not None
    assert api.handle("GET", "/search?q=lantern+flames&page_size=1")[1] == body and api.cache.hits == 1
    assert api.handle("GET", "/page/99999")[0] == 404 and api.handle("GET", "/page/0")[0] == 400 and json.loads(api.handle("GET", "/page/1")[1])["word_count"] == 10
    assert api.handle("GET", "/suggest?q=")[0] == 400 and json.loads(api.handle("GET", "/suggest?q=lan")[1])["suggestions"] == ["lantern"]
    assert api.handle("GET", "/search?q=(a")[0] == 400 and api.handle("GET", "/none")[0] == 404 and api.handle("OPTIONS", "/")[0] == 200
    assert json.loads(api.handle("GET", "/stats")[1])["documents_indexed"] == 5 and json.loads(api.handle("GET", "/health")[1])["status"] == "ok"
    assert api.handle("POST", "/index/rebuild")[0] == 202
    with api.building:
        assert api.handle("POST", "/index/rebuild")[0] == 409


def test_server(ix):
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from glyphmill.plans.server import serve

    server = serve(Api(ix), port=0, burst=3, rate=0)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urlopen(f"{base}/api/v1/suggest?q=lan") as answer:
            assert json.load(answer)["suggestions"] == ["lantern"] and answer.headers["X-RateLimit-Remaining"] == "2"
        with pytest.raises(HTTPError) as missing:
            urlopen(f"{base}/page/77")
        assert missing.value.code == 404
        urlopen(f"{base}/health").close()
        with pytest.raises(HTTPError) as limited:
            urlopen(f"{base}/health")
        assert limited.value.code == 429
    finally:
        server.shutdown()
        server.server_close()


def test_sources(spark, tmp_path):
    for i, text in ((1, "<p>one"), (51, "<p>two")):
        (tmp_path / f"page_{i}.html").write_text(text)
    (tmp_path / "other.html").write_text("x")
    assert corpus.html_files(spark, str(tmp_path)).count() == 2 and corpus.html_files(spark, str(tmp_path), 50).count() == 1
    (tmp_path / "stop.txt").write_text("  the\n\nof\n")
    assert corpus.stop_words(spark, str(tmp_path / "stop.txt")) == ["the", "of"]
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, t string")
    assert corpus.canned_search(docs, "ALPHA", "t").count() == 1 and corpus.canned_search(docs, "zzz", "t").count() == 2
    record = spark.createDataFrame([(1, "T", "C", "a, b", "D", "H", "text", 2, 3)], "id long, title string, category string, keywords string, description string, heading string, content string, link1 int, link2 int")
    page = index.parse_pages(corpus.generated_pages(record)).first()
    assert (page["title"], page["keywords"], page["headings"], page["links"]) == ("T", ["a", "b"], ["H", "Related"], ["/page/2", "/page/3"])


def test_log_lines(spark):
    events = spark.sql("SELECT timestamp'2024-01-02 03:04:05' ts, 'INFO' level, 'x' event, cast(null as string) request_id UNION ALL SELECT timestamp'2024-01-02 03:04:05', 'DEBUG', 'y', 'r'")
    assert [r["value"] for r in sinks.log_lines(events).collect()] == ['{"timestamp":"2024-01-02T03:04:05Z","level":"INFO","event":"x"}']


def test_cache_and_bucket(spark):
    cache = serving.LruCache(2)
    for key in "abca":
        if cache.get(key) is None:
            cache.put(key, 1)
    assert (cache.hits, cache.misses) == (0, 4)
    state, allowed = None, []
    for second in [0] * 42 + [1] * 21:
        state, ok = serving.take_token(state, second)
        allowed.append(ok)
    assert allowed == [True] * 40 + [False] * 2 + [True] * 20 + [False]
    hashes = spark.createDataFrame([("",), ("a",)], "t string").select(serving.fnv1a(F.col("t")).alias("h")).collect()
    assert [(r["h"]["high"] << 32) + r["h"]["low"] for r in hashes] == [serving.FNV_OFFSET, 0xAF63DC4C8601EC8C]
    assert [serving.bucket_count(n) for n in (0, 1, 3073, 3074, 6146)] == [4096, 4096, 4096, 8192, 16384]


def test_client(spark):
    tabs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string")
    assert client.close_tab(tabs, "a").count() == 1 and client.close_tab(tabs.where("id = 'a'"), "a").count() == 1
    assert client.update_tab(tabs, "a", title="z").where("title = 'z'").count() == 1
    assert not client.asks_for_suggestions(" a ") and client.asks_for_suggestions("a", "omnibox")
    routes = spark.createDataFrame([("page/7",), ("search?q=a+b",), ("bookmarks",), ("hello",)], "a string").select(client.route(F.col("a")).alias("r"))
    assert [tuple(r["r"]) for r in routes.collect()] == [("page", "7"), ("search", "a b"), ("bookmarks", ""), ("search", "hello")]


def test_streamed_limiter_is_the_batch_one(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = limiter.limit_stream(stream, burst=2, rate=1).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("limited").collect()}
    assert got == {tuple(r) for r in serving.limit_rate(events, burst=2, rate=1).collect()} and len(got) == events.count()


def test_index_updates(spark, docs, ix, tmp_path):
    path = f"file://{tmp_path}/ix"
    store.save(ix, path)
    changed = docs.where("doc_id = 3").withColumn("body_text", F.lit("entirely new words"))
    changed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changed.schema).parquet(str(tmp_path / "in"))
    q = updates.update_index(stream, path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    now = store.load(spark, path, verify=True)
    assert ids(search.ranked(now, "entirely")) == [3] and ids(search.ranked(now, "lantern")) == [1] and now.stats.first()["n_docs"] == 5


def batch_of(docs, *rows):
    spark = docs.sparkSession
    fresh = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, body_text string")
    return index.plain_documents(fresh.select("doc_id", F.col("body_text").alias("text"), F.lit("New").alias("source"))).select(*docs.columns)


def frozen(ix):
    return [sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in (ix.docs, ix.postings, ix.terms, ix.stats.select("n_docs", "n_terms", F.round("avgdl", 6)))]


def test_updates_are_repeatable(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ix"
    first = store.build(docs, path)
    before = first.postings.count()
    one, two = batch_of(docs, (3, "entirely new words"), (9, "words of nine")), batch_of(docs, (1, "lantern again"))
    assert updates.apply_batch(one, 0, path) and not updates.apply_batch(one, 0, path) and updates.apply_batch(two, 1, path)
    now = store.load(spark, path, verify=True)
    whole = updates.upsert(updates.upsert(index.build(docs), one), two)
    assert frozen(now) == frozen(whole) and ids(search.ranked(now, "lantern")) == [1] and ids(search.ranked(now, "words")) == [3, 9]
    # another stream starts at epoch 0 again and is applied; what readers opened stays readable
    assert updates.apply_batch(batch_of(docs, (2, "zero again")), 0, path) and ids(search.ranked(store.load(spark, path), "zero")) == [2]
    assert first.postings.count() == before and ids(search.ranked(now, "lantern")) == [1]
    assert store.manifest(spark, path)["layers"] == [1, 2, 3, 4]


def test_layers_are_merged_and_pruned(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ix"
    store.build(docs, path)
    for epoch in range(3):
        updates.apply_batch(batch_of(docs, (2, f"text number{epoch}"), (20 + epoch, "more text")), epoch, path, most_layers=3)
    told = store.manifest(spark, path)
    assert told["layers"] == [4, 5] and store.versions(spark, path) == [1, 2, 3, 4, 5]
    assert not updates.apply_batch(batch_of(docs, (2, "text number2"), (22, "more text")), 2, path, most_layers=3)
    found = frozen(store.load(spark, path, verify=True))
    assert store.prune(spark, path, keep=1) == [1, 2, 3] and store.versions(spark, path) == [5] and frozen(store.load(spark, path)) == found
    assert ids(search.ranked(store.load(spark, path), "text")) == [2, 20, 21, 22]


def test_publication_has_no_gap(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ix"
    with pytest.raises(store.StoreError):
        store.load(spark, path)
    store.build(docs, path)
    # a version that was written and not published counts for nobody, and its number isn't used again
    index.build(docs).docs.write.parquet(f"{path}/v2/docs")
    assert store.manifest(spark, path)["number"] == 1 and store.save(index.build(docs), path) == 3
    with pytest.raises(store.StoreError):
        store.save(index.build(docs), path, version=3)


def test_the_indexs_own_stop_words(spark, docs, tmp_path):
    toks = index.tokens(docs)
    for ix in (index.build(docs, ["lantern"]), store.build(docs, f"file://{tmp_path}/own", stop_words=["lantern"])):
        find = lambda q: ids(search.boolean(ix, q, toks))
        assert find('"lantern glass holders"') == [1] and find("lantern AND wick") == [3] and find("the wick") == [3] and find("lantern") == [] and find("NOT lantern") == []
        assert find("wick AND NOT lantern") == [3] and find("lantern OR rigging") == [2] and find('"lantern" AND rigging') == [2] and find("(lantern OR lantern) AND NOT wick") == [1, 2, 4, 5]
    assert store.load(spark, f"file://{tmp_path}/own").stop_words == ["lantern"]


def test_fields_over_the_api(ix):
    api = Api(ix)
    told = lambda q, mode="boolean": [r["id"] for r in json.loads(api.handle("GET", f"/search?q={q}&mode={mode}")[1])["results"]]
    assert told("title:wick") == [3] and told("body:making") == [] and told("category:ships") == [2] and told("the+AND+lantern+AND+body:short") == [3]
    assert api.handle("GET", "/search?q=lantern%20wick&page=1")[1] != "" and api.handle("GET", "/search?q=lantern+wick&page=1") and api.cache.hits == 0
    assert api.handle("GET", "/search?q=(")[0] == 400 and len(api.cache.held) == 6


def test_workers_are_bounded():
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor
    from urllib.request import urlopen

    from glyphmill.plans.server import serve

    class Slow:
        most = now = 0
        lock = threading.Lock()

        def handle(self, method, path):
            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
            time.sleep(0.05)
            with self.lock:
                self.now -= 1
            return 200, "{}"

    api = Slow()
    server = serve(api, port=0, burst=1_000, workers=3)
    try:
        with ThreadPoolExecutor(12) as pool:
            assert [r.status for r in pool.map(lambda _: urlopen(f"http://127.0.0.1:{server.server_address[1]}/x"), range(24))] == [200] * 24
        assert 1 < api.most <= 3
    finally:
        server.shutdown()
        server.server_close()


def test_client_tries_once_more():
    import socket
    import threading

    from glyphmill.plans.client import ApiError, fetch_json

    answers = iter([None, b"HTTP/1.0 200 OK\r\n\r\n{\"a\": 1}", b"HTTP/1.0 404 Not Found\r\n\r\n{\"code\": \"X\"}", None, None, "late", "late"])
    listener = socket.create_server(("127.0.0.1", 0))
    held = []

    def answer():
        for raw in answers:
            s, _ = listener.accept()
            s.recv(4_096)
            if raw == "late":
                held.append(s)
                continue
            if raw:
                s.sendall(raw)
            s.close()

    threading.Thread(target=answer, daemon=True).start()
    url = f"http://127.0.0.1:{listener.getsockname()[1]}/x"
    assert fetch_json(url) == {"a": 1}
    with pytest.raises(ApiError) as e:
        fetch_json(url)
    assert e.value.status == 404 and e.value.body == {"code": "X"}
    with pytest.raises(OSError):
        fetch_json(url)
    assert fetch_json(url, timeout=0.2, fallback=lambda: "canned") == "canned"
    listener.close()


def test_windowed_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = updates.windowed_counts(stream).writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
