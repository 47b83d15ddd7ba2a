"""Text quality by compression with trained dictionaries.

Method: zstandard dictionaries are built from texts labelled good and from texts
labelled bad, a pair of them from each of PAIRS parts of the labelled texts. A text
is compressed piece by piece with either of a pair; the difference of the two sizes,
divided by the size of the text, tells which kind it is more like. The mean
difference of the pairs is the only input of the score: a rising function turns it
into a probability. It is fitted by isotonic regression on the labelled texts, each
measured with the pairs that it didn't build.

The fit uses at most ``rows`` labelled rows and ``most_bytes`` bytes of their texts,
which the driver holds; whole texts are scored. Where a class has too little text
to train a dictionary, the texts themselves are its dictionary, as zstandard
allows.

Defined cases: null and empty texts have the difference 0; without labelled rows
of both kinds the score is the share of label 1 (1 without rows); equal differences
have equal scores; an id counts once in the fit, whatever its rows and labels (see
``labelled``); very long texts are compressed piece by piece; repeated rows are
scored one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample

#: Labelled rows of a fit and bytes of their texts; bytes of a piece and of a
#: dictionary; pieces that a dictionary is trained from at least; pairs.
ROWS, BYTES, PIECE, DICTIONARY, LEAST_PIECES, PAIRS = 8_000, 24 << 20, 256, 65_536, 16, 4
LEVEL = 3


def pieces_of(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def measure(good: bytes, bad: bytes) -> Callable[[bytes], float]:
    """raw text -> how much larger it is with the bad dictionary, as a share of its
    bytes."""
    packers = []
    for content in (good, bad):
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)  # else every piece would digest the dictionary anew
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    with_good, with_bad = packers

    def of(raw: bytes) -> float:
        more = sum(len(with_bad.compress(p)) - len(with_good.compress(p)) for p in pieces_of(raw))
        return more / max(len(raw), 1)

    return of


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@dataclass
class Model:
    """Pairs of dictionaries (good, bad), and the points of the calibration."""

    pairs: list[tuple[bytes, bytes]]
    differences: list[float]
    scores: list[float]

    def scorer(self) -> Callable[[str | None], float]:
        of = [measure(*pair) for pair in self.pairs]

        def score(text: str | None) -> float:
            raw = raw_of(text)
            return float(np.interp(sum(f(raw) for f in of) / max(len(of), 1), self.differences, self.scores))

        return score


def calibrate(differences: list[float], labels: list[int]) -> tuple[list[float], list[float]]:
    """Points of a rising function from difference to probability: isotonic
    regression by pooling neighbours. A pool of n rows counts as n + 1, with one
    of the overall share, so no score is 0 or 1; a small pool that this lifts above
    the next one has the next one's score."""
    share = sum(labels) / len(labels)
    pools: list[list[float]] = []  # sum of the differences, rows of label 1, rows
    rate = lambda p: p[1] / p[2]
    held: dict[float, list[float]] = {}
    for x, y in zip(differences, labels):
        at = held.setdefault(x, [0.0, 0.0, 0.0])
        held[x] = [at[0] + x, at[1] + y, at[2] + 1]
    for x in sorted(held):
        pools.append(held[x])
        while len(pools) > 1 and rate(pools[-2]) >= rate(pools[-1]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    scores = np.minimum.accumulate([(p[1] + share) / (p[2] + 1) for p in reversed(pools)])[::-1]
    return [p[0] / p[2] for p in pools], [float(v) for v in scores]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained from the pieces of the texts."""
    parts = [p for t in texts for p in pieces_of(t)]
    size = min(DICTIONARY, sum(map(len, parts)) // 4)
    if len(parts) >= LEAST_PIECES and size >= 1024:
        try:
            return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # pieces that are all alike
            pass
    return b"".join(parts)[-DICTIONARY:] or b" "


def train(rows: list[tuple[int, str | None]]) -> Model:
    """A model of (label, text) rows; the rows of a label go to the parts by turns."""
    ones = sum(label for label, _ in rows)
    if len(rows) < 4 or not 0 < ones < len(rows):
        return Model([], [0.0], [ones / len(rows) if rows else 1.0])
    seen, parts = [0, 0], []
    for label, _ in rows:
        parts.append(seen[label] % PAIRS)
        seen[label] += 1
    raws = [raw_of(text) for _, text in rows]
    built = [tuple(dictionary([raw for raw, part, (y, _) in zip(raws, parts, rows) if part == k and y == label]) for label in (1, 0)) for k in range(PAIRS)]
    of = [measure(*pair) for pair in built]
    others = lambda raw, part: sum(f(raw) for k, f in enumerate(of) if k != part) / (PAIRS - 1)
    return Model(built, *calibrate([others(raw, part) for raw, part in zip(raws, parts)], [label for label, _ in rows]))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, rows: int = ROWS, most_bytes: int = BYTES
) -> Model:
    """Fits on at most ``rows`` labelled rows with ``most_bytes`` bytes of text,
    outside the held-out part."""
    got = sample(docs, labels, label, rows, most_bytes, id_col, text_col).orderBy(F.xxhash64("id"), "id").select("label", "text").toArrow()
    return train(list(zip(got["label"].to_pylist(), got["text"].to_pylist())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")
