"""Sets of word shingles as sorted 64-bit hashes, in numpy.

A word's hash is the polynomial hash of its bytes modulo 2**64, taken from
running sums over the text, then mixed; a shingle's hash combines its words'.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a text that are hashed at once; a cut falls on white space.
_PIECE = 1 << 20
#: Bytes of short texts that are hashed together.
_GROUP = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start, and their hashes."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[a], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, "u8")
    _powers.reach(len(a) + 1)
    sums = np.zeros(len(a) + 1, "u8")
    np.cumsum((a.astype("u8") + np.uint64(1)) * _powers.up[: len(a)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _powers.down[start] + (end - start).astype("u8"))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z folded."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if len(raw) <= _PIECE:
        return _words_at(raw)[1]
    parts, at = [], 0
    while at < len(raw):
        cut = _GAP.search(raw, at + _PIECE)
        to = cut.start() if cut else len(raw)
        parts.append(_words_at(raw[at:to])[1])
        at = to
    return np.concatenate(parts)


def _combine(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles that start at each word."""
    total = np.full(len(w) - k + 1, k, "u8")
    for i in range(k):
        total = total * np.uint64(_BASE) + w[i : len(w) - k + 1 + i]
    return mix(total)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    ordered = np.sort(hashes)
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; of the whole sequence if
    it is shorter; none without words."""
    w = word_hashes(text or "")
    return _distinct(_combine(w, min(n, len(w)))) if len(w) else w


def shingle_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of every text; short texts are hashed many at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(raw) > _GROUP:
            yield from _group_sets(held, n)
            held, size = [], 0
            yield shingle_set(text, n)
            continue
        held.append(raw)
        size += len(raw)
        if size > _GROUP:
            yield from _group_sets(held, n)
            held, size = [], 0
    yield from _group_sets(held, n)


def _group_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    starts, w = _words_at(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = [0, *np.searchsorted(starts, ends).tolist()]
    all_ = _combine(w, n) if len(w) >= n else w
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            yield _distinct(all_[a : b - n + 1])
        else:
            yield _combine(w[a:b], b - a) if b > a else w[:0]


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
