"""Tokens of whole documents in plain Python, for Arrow batches.

The rules are those of ``text``, on bytes: a document's postings are grouped where
its text is, so that no group of one document waits for a shuffle. Every distinct
word is stemmed once. Counts of terms alone are made from whole arrays of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as T
from .scoring import FIELD_WEIGHTS

#: Fields in the order of their positions; those of a document that has a body only.
FIELDS, BODY_ONLY = {"title": "title", "headings": "heading", "keywords": "keywords", "description": "description", "body_text": "body"}, {"body_text": "body"}
#: Words whose stems are remembered, and postings of an Arrow batch.
KNOWN, BATCH = 300_000, 50_000
#: Bytes of documents whose terms are counted at once, if they are more than one.
PORTION = 16_000_000
_VOWELS = b"aeiou"
_ENDS = "".join(c for c in map(chr, range(128)) if re.match(T.DELIMITERS, c))
#: Folds a byte, and makes a space of one that ends a word.
_FOLDED = bytes.maketrans((_ENDS + T.UPPER).encode(), (" " * len(_ENDS) + T.LOWER).encode())


def _undouble(word: bytes) -> bytes:
    return word[:-1] if len(word) >= 3 and word[-1] == word[-2] and word[-1] < 128 and word[-1] not in _VOWELS else word


def stem(word: bytes) -> bytes:
    n = len(word)
    if n <= 3:
        return word
    if n > 5 and word.endswith(b"ing"):
        return _undouble(word[:-3])
    if n > 5 and word.endswith(b"tion"):
        return word[:-4]
    if n > 4 and word.endswith(b"ed"):
        return _undouble(word[:-2])
    if n > 4 and word.endswith(b"ies"):
        return word[:-3] + b"y"
    if n > 4 and word.endswith(b"es"):
        return word[:-2]
    return word[:-1] if word.endswith(b"s") and not word.endswith(b"ss") else word


class Terms(dict):
    """The term of a word: None if its length is not kept, empty for stop words."""

    def __init__(self, stop_words: list[str] | None = None):
        super().__init__()
        self.stop = {w.encode() for w in (T.STOP_WORDS if stop_words is None else stop_words)}

    def __missing__(self, word: bytes) -> bytes | None:
        term = stem(word) if T.MIN_BYTES <= len(word) <= T.MAX_BYTES else b""
        found = None if len(term) < T.MIN_BYTES else b"" if term in self.stop else term
        if len(self) < KNOWN:
            self[word] = found
        return found


def words(text: bytes | None) -> list[bytes]:
    """All words, folded, before any length filter; null has none."""
    return text.translate(_FOLDED).split() if text else []


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.list_(pa.binary()) if pa.types.is_list(column.type) else pa.binary()).to_pylist()


def _texts(columns: Iterable[pa.Array]) -> Iterator[tuple[list[bytes | None], ...]]:
    """For each document the texts of its fields."""
    yield from zip(*([v or [] if isinstance(v, list) else [v] for v in _bytes(c)] for c in columns))


def counts(*columns: pa.Array) -> pa.Array:
    """Words of kept length of each document, in all its fields, stop words too."""
    terms = Terms()
    return pa.array([sum(terms[w] is not None for texts in fields for t in texts for w in words(t)) for fields in _texts(columns)], pa.int64())


def postings(batches: Iterator[pa.RecordBatch], fields: dict[str, str], stop_words: list[str] | None, positions: bool) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, wtf[, positions]) of documents, without stop words."""
    known, weights = Terms(stop_words), [FIELD_WEIGHTS[f] for f in fields.values()]
    terms, ids, tf, wtf, flat = [], [], [], [], []

    def batch() -> pa.RecordBatch:
        columns = {"term": pa.array(terms, pa.binary()).cast(pa.string()), "doc_id": pa.array(ids, pa.int64()), "tf": pa.array(tf, pa.int64()), "wtf": pa.array(wtf, pa.float64())}
        if positions:
            columns["positions"] = pa.ListArray.from_arrays(pa.array([0, *accumulate(tf)], pa.int32()), pa.array(flat, pa.int32()))
        made = pa.RecordBatch.from_pydict(columns)
        for held in (terms, ids, tf, wtf, flat):
            held.clear()
        return made

    for rows in batches:
        of = dict(zip(rows.schema.names, rows.columns))
        for id_, texts in zip(of["doc_id"].to_pylist(), _texts([of[c] for c in fields])):
            places, sums, k = {}, {}, 0
            for weight, field in zip(weights, texts):
                for text in field:
                    for word in words(text):
                        k += 1
                        term = known[word]
                        if term:
                            if term in places:
                                places[term].append(k)
                            else:
                                places[term] = [k]
                            if weight != 1.0:
                                sums[term] = sums.get(term, 0.0) + weight - 1.0
            n = list(map(len, places.values()))
            terms += places
            ids += [id_] * len(places)
            tf += n
            wtf += [x + sums.get(t, 0.0) for t, x in zip(places, n)] if sums else n
            if positions:
                flat += chain.from_iterable(places.values())
            if len(terms) >= BATCH or len(flat) >= 4 * BATCH:
                yield batch()
    if terms:
        yield batch()


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, some PORTION bytes at once."""
    held, size = [], 0
    todo = []
    for batch in batches:
        todo.append(batch)
        while todo:
            rows = todo.pop()
            if rows.nbytes > PORTION and rows.num_rows > 1:
                half = rows.num_rows // 2
                todo += [rows.slice(half), rows.slice(0, half)]
                continue
            if held and size + rows.nbytes > PORTION:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(rows)
            size += rows.nbytes
    if held:
        yield pa.concat_batches(held)


def _split(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of a column of texts or lists of texts, folded, in
    their order; empty ones may be among them."""
    rows = None
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        rows, column = pc.list_parent_indices(column).to_numpy(zero_copy_only=False), column.flatten()
    texts = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.empty(0, np.int64), pa.array([], pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    folded = (texts.buffers()[2] or pa.py_buffer(b""))[at[0] : at[-1]].to_pybytes().translate(_FOLDED)
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(folded)))
    of = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    return of if rows is None else rows[of], words.flatten().cast(pa.large_binary())


def stems(words: pa.Array) -> pa.Array:
    """``stem`` of every word of a large_binary array without nulls."""
    if not len(words):
        return words
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)[at[0] : at[-1]].copy()
    start, n = at[:-1] - at[0], np.diff(at)
    end = start + n

    def byte(k: int | np.ndarray) -> np.ndarray:
        """The k-th byte from the end, of words that have it."""
        return data[np.maximum(end - k, 0)] if len(data) else np.zeros(len(n), np.uint8)

    def ends(suffix: bytes, longer: int) -> np.ndarray:
        hit = n > longer
        for k, c in enumerate(reversed(suffix), 1):
            hit = hit & (byte(k) == c)
        return hit

    rules = [(ends(b"ing", 5), 3), (ends(b"tion", 5), 4), (ends(b"ed", 4), 2), (ends(b"ies", 4), 2), (ends(b"es", 4), 2), (ends(b"s", 3) & ~ends(b"ss", 3), 1)]
    cut = np.select([hit for hit, _ in rules], [k for _, k in rules], 0)
    last = byte(cut + 1)
    doubled = (last == byte(cut + 2)) & (last < 128) & ~np.isin(last, list(_VOWELS))
    cut = cut + (doubled & (rules[0][0] | rules[2][0] & ~rules[1][0]))
    data[end[rules[3][0]] - 3] = ord("y")
    left = n - cut
    kept = data[np.arange(len(data)) - np.repeat(start, n) < np.repeat(left, n)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(left)])), pa.py_buffer(kept)])


def term_counts(batches: Iterator[pa.RecordBatch], fields: Iterable[str], stop_words: list[str] | None) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of documents, each row being one, without stop words; a term
    comes up once for every portion that has it."""
    stop = pa.array([w.encode() for w in (T.STOP_WORDS if stop_words is None else stop_words)], pa.large_binary())
    for rows in _portions(batches):
        docs, words = zip(*(_split(rows.column(c)) for c in fields))
        each = pa.concat_arrays(words).dictionary_encode()
        found = stems(each.dictionary)
        size = pc.binary_length(each.dictionary)
        kept = pc.and_(pc.and_(pc.greater_equal(size, T.MIN_BYTES), pc.less_equal(size, T.MAX_BYTES)), pc.greater_equal(pc.binary_length(found), T.MIN_BYTES))
        kept = pc.and_not(kept, pc.is_in(found, value_set=stop))
        terms = pc.if_else(kept, found, pa.scalar(None, pa.large_binary())).dictionary_encode()
        n = len(terms.dictionary)
        if not n:
            continue
        term = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[each.indices.to_numpy(zero_copy_only=False)]
        pairs = (np.concatenate(docs).astype(np.int64) * n + term)[term >= 0]
        cf = np.bincount(pairs % n, minlength=n)
        pairs.sort()
        df = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % n, minlength=n)
        yield pa.RecordBatch.from_pydict({"term": terms.dictionary.cast(pa.string()), "df": pa.array(df, pa.int64()), "cf": pa.array(cf, pa.int64())})
