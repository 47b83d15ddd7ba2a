"""The JSON API as functions: each takes an index and gives one JSON string."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from urllib.parse import unquote_plus

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.index import Index
from ..operators.serving import LruCache, table_stats
from ..operators.snippet import snippet_column
from ..operators.suggest import FEW_RESULTS, did_you_mean, suggest
from . import query as Q

API_VERSION = "1.0.0"


def _bad(code: str, message: str, status: int) -> tuple[int, str]:
    return status, json.dumps({"error": True, "code": code, "message": message, "status": status})


def _integer(text: str, default: int) -> int:
    return int((re.match(r"\s*([+-]?[0-9]+)", text) or [0, "0"])[1]) if text != "" else default


class Api:
    """Routes of the service over a swappable index."""

    def __init__(self, index: Index, rebuild: Callable[[], Index] | None = None):
        self.index, self._rebuild = index, rebuild
        self.cache, self.started, self.building = LruCache(), time.time(), threading.Lock()

    def search(self, q: str, page: int = 1, page_size: int = 10, ranking: str = "bm25", mode: str = "ranked") -> tuple[int, str]:
        page, page_size = S.clamp(page, page_size)
        ranking = "tfidf" if ranking == "tfidf" else "bm25"
        began = time.time()
        try:
            tree = Q.parse(q)
        except Q.QueryError as e:
            code = "QUERY_TOO_LONG" if "length" in str(e) else "INVALID_QUERY_SYNTAX"
            return _bad(code, str(e), 400)
        terms = Q.bag(tree)
        if mode == "boolean":
            # postings hold no fields: the documents' own texts tell where a term stands
            results = S.boolean(self.index, q, self.index.docs if S.has_field(tree) else None, ranking)
        else:
            results = S.ranked(self.index, q, ranking)
        results = results.cache()
        total = results.count()
        top = S.page(results, self.index, page, page_size).join(self.index.docs, "doc_id")
        shown = top.select("doc_id", F.coalesce("title", F.lit("Untitled Document")).alias("title"), "category", F.round("score", 4).alias("score"), "matched", "modified_time", snippet_column(F.col("body_text"), q).alias("snippet"))
        rows = sorted(shown.collect(), key=lambda r: (-r["score"], -r["matched"], -r["modified_time"], r["doc_id"]))
        results.unpersist()
        hint = None
        if total < FEW_RESULTS and terms:
            found = did_you_mean(self.index, terms[0]).first()
            hint = found["term"] if found else None
        body = json.dumps({
            "query": q, "total": total, "page": page, "page_size": page_size, "ranking": ranking, "search_time_ms": round((time.time() - began) * 1000, 2), "did_you_mean": hint,
            "results": [{"id": r["doc_id"], "title": r["title"], "url": f"/page/{r['doc_id']}", "category": r["category"], "score": r["score"], "snippet": r["snippet"]} for r in rows],
        })
        return 200, body

    def suggestions(self, q: str, limit: int = 5) -> tuple[int, str]:
        if not q:
            return _bad("PREFIX_TOO_SHORT", "Query prefix must be at least 1 character", 400)
        return 200, json.dumps({"suggestions": [r["term"] for r in suggest(self.index, q, limit).collect()]})

    def page(self, doc_id: int) -> tuple[int, str]:
        if doc_id <= 0:
            return _bad("INVALID_ID", "Page ID must be a positive integer", 400)
        row = self.index.docs.where(F.col("doc_id") == doc_id).select(F.col("doc_id").alias("id"), "title", "description", "category", "body_text", "word_count").first()
        return (200, json.dumps(row.asDict())) if row else _bad("DOCUMENT_NOT_FOUND", f"Page {doc_id} was not found", 404)

    def health(self) -> tuple[int, str]:
        n = self.index.stats.first()["n_docs"]
        return 200, json.dumps({"status": "ok", "version": API_VERSION, "index_loaded": n > 0, "documents": n, "uptime_seconds": int(time.time() - self.started)})

    def stats(self) -> tuple[int, str]:
        s, t = self.index.stats.first(), table_stats(self.index.terms).first()
        return 200, json.dumps({
            "documents_indexed": s["n_docs"], "unique_terms": s["n_terms"], "load_factor": round(t["load_factor"], 4), "hash_collisions": t["hash_collisions"],
            "cache_hits": self.cache.hits, "cache_misses": self.cache.misses, "uptime_seconds": int(time.time() - self.started),
        })

    def clear_cache(self) -> tuple[int, str]:
        self.cache.clear()
        return 200, json.dumps({"status": "cleared"})

    def rebuild(self) -> tuple[int, str]:
        if self._rebuild is None or not self.building.acquire(blocking=False):
            return _bad("INDEX_BUILD_IN_PROGRESS", "An index build is already in progress", 409)
        try:
            self.index = self._rebuild()
            self.cache.clear()
        finally:
            self.building.release()
        return 202, json.dumps({"status": "completed"})

    def handle(self, method: str, path: str) -> tuple[int, str]:
        """Any request by its method and path with query string."""
        if method == "OPTIONS":
            return 200, ""
        path = path.removeprefix("/api/v1") or "/"
        route, _, raw = path.partition("?")
        given = {k: unquote_plus(v) for k, _, v in (p.partition("=") for p in raw.split("&") if p)}
        if method == "POST":
            return {"/index/rebuild": self.rebuild, "/cache/clear": self.clear_cache}.get(route, lambda: _bad("NOT_FOUND", "Endpoint not found", 404))()
        if route == "/":
            return 200, json.dumps({"service": "search", "version": API_VERSION, "status": "online", "endpoints": ["/health", "/stats", "/search?q=", "/suggest?q=", "/page/:id"]})
        if route == "/search":
            # the key is what was asked, letter by letter; only answers are kept
            if (held := self.cache.get(path)) is not None:
                return 200, str(held)
            status, body = self.search(given.get("q", ""), _integer(given.get("page", ""), 1), _integer(given.get("page_size", ""), 10), given.get("ranking", "bm25"), given.get("mode", "ranked"))
            if status == 200:
                self.cache.put(path, body)
            return status, body
        if route == "/suggest":
            return self.suggestions(given.get("q", ""), _integer(given.get("limit", ""), 5))
        if route.startswith("/page/"):
            return self.page(_integer(route[6:], 0))
        return {"/health": self.health, "/stats": self.stats}.get(route, lambda: _bad("NOT_FOUND", "Endpoint not found", 404))()
