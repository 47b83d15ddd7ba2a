"""A client of the API: every request with a time limit and one more try."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

#: Seconds that an answer may take, and tries after the first.
TIMEOUT, RETRIES = 4.0, 1


class ApiError(RuntimeError):
    """The service answered with an error; it is not asked again."""

    def __init__(self, status: int, body: Any):
        super().__init__(f"status {status}")
        self.status, self.body = status, body


def fetch_json(url: str, timeout: float = TIMEOUT, retries: int = RETRIES, pause: float = 0.0, fallback: Callable[[], Any] | None = None) -> Any:
    """The JSON at an address. A request that fails on its way, or takes longer than
    ``timeout``, is tried again; after the last try the ``fallback`` answers, if there
    is one. Errors that the service itself reports are raised at once."""
    for left in range(retries, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            raw = e.read()
            raise ApiError(e.code, json.loads(raw) if raw else None) from None
        except OSError:
            if not left:
                if fallback is not None:
                    return fallback()
                raise
            time.sleep(pause)
    raise AssertionError("unreachable")
