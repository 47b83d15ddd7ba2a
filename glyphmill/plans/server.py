"""A small HTTP server over the API, with a token bucket for every client and a
fixed number of workers."""

from __future__ import annotations

import json
import socket
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, HTTPServer

from ..operators.serving import BURST, RATE, take_token
from .api import Api

#: Buckets that are kept; full ones go first when there are more.
CLIENTS = 10_000
#: Fixed value: requests that are answered at once.
WORKERS = 8


class Limiter:
    """Token buckets by client address."""

    def __init__(self, burst: int = BURST, rate: int = RATE):
        self.burst, self.rate, self.lock = burst, rate, threading.Lock()
        self.buckets: dict[str, tuple[float, int]] = {}

    def take(self, client: str) -> tuple[bool, int]:
        """Whether a request may pass, and the tokens that are left."""
        now = int(time.time())
        with self.lock:
            if len(self.buckets) > CLIENTS:
                self.buckets = {c: b for c, b in self.buckets.items() if b[0] + (now - b[1]) * self.rate < self.burst}
            self.buckets[client], allowed = take_token(self.buckets.get(client), now, self.burst, self.rate)
            return allowed, int(self.buckets[client][0])


class PooledServer(HTTPServer):
    """Requests wait for one of ``workers`` threads."""

    def __init__(self, address: tuple[str, int], handler: type[BaseHTTPRequestHandler], workers: int):
        super().__init__(address, handler)
        self.pool = ThreadPoolExecutor(workers)

    def process_request(self, request: socket.socket, client_address: tuple) -> None:
        self.pool.submit(self._answer, request, client_address)

    def _answer(self, request: socket.socket, client_address: tuple) -> None:
        try:
            self.finish_request(request, client_address)
        except OSError:
            pass  # the client is gone
        finally:
            self.shutdown_request(request)

    def server_close(self) -> None:
        super().server_close()
        self.pool.shutdown(wait=False)


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080, burst: int = BURST, rate: int = RATE, workers: int = WORKERS) -> PooledServer:
    """Starts a server in the background; port 0 takes a free one."""
    limiter = Limiter(burst, rate)

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            allowed, left = limiter.take(self.client_address[0])
            if allowed:
                status, body = api.handle(self.command, self.path)
            else:
                status, body = 429, json.dumps({"error": True, "code": "RATE_LIMITED", "message": "Too many requests. Rate limit exceeded.", "status": 429})
            raw = body.encode()
            self.send_response(status)
            for name, value in {
                "Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(raw)), "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS",
                "X-RateLimit-Limit": str(rate), "X-RateLimit-Remaining": str(left),
            }.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_OPTIONS = answer

        def log_message(self, *_: object) -> None:
            pass

    server = PooledServer((host, port), Handler, workers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
