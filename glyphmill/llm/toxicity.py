"""Toxicity by a counterfactual-regularised logistic classifier.

Method: texts become counts of hashed words and word beginnings; a logistic
model is fitted on labelled rows. For every labelled text with identity terms a
counterfactual is made by swapping each term for the next one of its group, and
the fit penalises the squared change of the log-odds. A neutral mention of a
group so moves the score little, while words that are toxic whoever is mentioned
keep their weight.

The fit uses at most ``rows`` labelled rows and ``most_bytes`` bytes of their texts;
the driver gets counts of at most ``kept`` features of each. Scores are made for
every whole text.

Defined cases: null and empty texts score the bias alone; without labelled rows
of both kinds the score is the share of label 1 (0 without rows); an id counts once
in the fit, whatever its rows and labels (see ``labelled``); features that tell
equally much are taken in the order of their numbers; very long texts are scored
whole; repeated rows are scored one by one; an empty table stays empty; extra
columns are ignored by ``score`` and kept by ``remove_toxic``, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .store import release

#: Labelled rows of a fit and bytes of their texts, hashed features, features kept,
#: texts that a kept one is in at least and how much it tells (its G statistic).
ROWS, BYTES, BITS, KEPT, LEAST_TEXTS, LEAST_G = 12_000, 48 << 20, 20, 4_096, 3, 3.0
RIDGE, FAIRNESS, STEPS = 0.2, 1.0, 400
#: Words that a scorer remembers at most.
KNOWN_WORDS = 200_000
#: Identity terms by group, lower case; one group's terms can stand for each other.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["her", "him"], ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslime", "christen", "juden"], ["musulmans", "chrétiens", "juifs"], ["musulmanes", "cristianos", "judíos"],
    ["black", "white", "asian", "latino"], ["africans", "europeans", "asians", "americans"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["old", "young"], ["immigrants", "natives"], ["disabled", "blind", "deaf"],
]
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}
_WORD = re.compile(r"\w+")
_BEGINNINGS = range(4, 9)


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    raw = [f"w:{word}", *(f"p:{word[:k]}" for k in _BEGINNINGS if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in raw]


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def feature_counts(words: Counter) -> dict[int, int]:
    out: dict[int, int] = {}
    for word, n in words.items():
        for f in features_of(word):
            out[f] = out.get(f, 0) + n
    return out


def swapped(words: Counter) -> Counter | None:
    """The counterfactual's words; None without identity terms."""
    if not any(w in SWAP for w in words):
        return None
    out: Counter = Counter()
    for w, n in words.items():
        out[SWAP.get(w, w)] += n
    return out


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self) -> Callable[[str | None], float]:
        """text -> score; words that carry no weight are remembered as such."""
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if len(known) > KNOWN_WORDS:
                known.clear()
            counts: dict[int, int] = {}
            for word, n in words_of(text).items():
                found = known.get(word)
                if found is None:
                    found = known[word] = tuple(f for f in features_of(word) if f in self.weights)
                for f in found:
                    counts[f] = counts.get(f, 0) + n
            z = self.bias + sum(self.weights[f] * float(np.log1p(n)) for f, n in sorted(counts.items()))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


class Sparse:
    """Counts as (row, column, count), taken as log1p of the counts."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, count: np.ndarray):
        self.n, self.row, self.col, self.val = n, row, col, np.log1p(count.astype("f8"))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], minlength=width)


def train(y: np.ndarray, x: Sparse, features: list[int], twins: tuple[Sparse, Sparse] | None = None, ridge: float = RIDGE, fairness: float = FAIRNESS) -> Model:
    """The logistic fit; ``twins`` holds the rows with identity terms and their
    counterfactuals, row for row."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), {})
    width, n1 = len(features), y.sum()
    w, bias = np.zeros(width), float(np.log(n1 / (len(y) - n1)))
    # Adam on the whole batch: the same steps for the same rows, whatever their order
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.clip(x.dot(w) + bias, -30, 30)
        r = 1 / (1 + np.exp(-z)) - y
        grad = x.back(r, width) + ridge * w
        if twins:
            change = twins[0].dot(w) - twins[1].dot(w)
            grad += 2 * fairness * (twins[0].back(change, width) - twins[1].back(change, width))
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return Model(float(bias), {int(f): float(round(w[i], 6)) for i, f in enumerate(features) if abs(w[i]) > 1e-3})


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, pos): in how many texts of the task a feature occurs."""
    n, pos = np.zeros(1 << BITS, "i4"), np.zeros(1 << BITS, "i4")
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1)):
            found = np.unique(np.array([f for w in words_of(text.as_py()) for f in features_of(w)], "i8"))
            n[found] += 1
            if label.as_py() > 0:
                pos[found] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(n[at].astype("i8")), pa.array(pos[at].astype("i8"))], ["feature", "n", "pos"])


def _kept_counts(kept: frozenset[int]) -> Callable:
    """(id, label, twin, feature, count) of the kept features of every text and,
    with ``twin`` 2, of its counterfactual; ``twin`` 1 marks texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, list[int], list[int]]] = []
            for id_, label, text in zip(*batch.columns):
                words = words_of(text.as_py())
                twin = swapped(words)
                for mark, side in ((int(twin is not None), words), (2, twin)):
                    if side is not None:
                        counts = {f: c for f, c in feature_counts(side).items() if f in kept}
                        out.append((id_.as_py(), int(label.as_py() > 0), mark, list(counts), list(counts.values())))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "label", "twin", "features", "counts"])

    return run


def _sparse(rows: pa.Table, features: np.ndarray) -> Sparse:
    sizes = pc.list_value_length(rows["features"]).to_numpy()
    found, counts = (pc.list_flatten(rows[c].combine_chunks()).to_numpy() for c in ("features", "counts"))
    return Sparse(rows.num_rows, np.repeat(np.arange(rows.num_rows), sizes), np.searchsorted(features, found), counts)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, rows: int = ROWS, most_bytes: int = BYTES,
    kept: int = KEPT, least_texts: int = LEAST_TEXTS, least_g: float = LEAST_G, ridge: float = RIDGE, fairness: float = FAIRNESS,
) -> Model:
    """Fits on at most ``rows`` labelled rows with ``most_bytes`` bytes of text,
    outside the held-out part.

    Which of the hashed features tell most about the label is counted on the
    executors; the driver gets the counts of the ``kept`` best ones in every row.
    """
    taken = sample(docs, labels, label, rows, most_bytes, id_col, text_col).select(F.col("id").cast("string").alias("id"), "label", "text")
    size = taken.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, n1 = size["n"], size["pos"]
    if not 0 < n1 < n:
        return train(np.array([1.0] * n1 + [0.0] * (n - n1)), Sparse(n, *[np.zeros(0, "i8")] * 3), [])
    counts = taken.select("label", "text").mapInArrow(_presence, "feature int, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    a, b, share = F.col("pos"), F.col("n") - F.col("pos"), n1 / n
    # how much the presence of a feature tells about the label: the G statistic
    part = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("n") * p))).otherwise(0.0)
    telling = counts.where(F.col("n") >= least_texts).withColumn("g", part(a, share) + part(b, 1 - share)).where(F.col("g") > least_g)
    best = telling.orderBy(F.col("g").desc(), "feature").limit(kept).select("feature").collect()
    features = sorted(r["feature"] for r in best)
    got = taken.mapInArrow(_kept_counts(frozenset(features)), "id string, label int, twin int, features array<int>, counts array<int>").toArrow().sort_by("id")
    twin, columns = got["twin"].to_numpy(), np.array(features, "i8")
    own, marked, others = (got.filter(pa.array(x)) for x in (twin < 2, twin == 1, twin == 2))
    twins = (_sparse(marked, columns), _sparse(others, columns)) if marked.num_rows else None
    return train(own["label"].to_numpy().astype("f8"), _sparse(own, columns), features, twins, ridge, fairness)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double")


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < least for t in batch.column(at)], pa.bool_()))
        del of
        release()

    return docs.mapInArrow(run, docs.schema)
