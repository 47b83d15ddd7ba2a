"""Exact top-k search by inner product, with pivot-table elimination.

Method: the distances of every vector to the pivots are computed once and kept in
a written table, which lies in the order of the nearest pivot and the distance to
it. By the triangle inequality, the largest |d(q, p) - d(v, p)| over the pivots
bounds d(q, v) from below, which bounds the inner product
(|q|^2 + |v|^2 - d^2) / 2 from above. A block of rows whose ranges of distances
keep it below a query's k-th best score is left out as a whole; in the others the
candidates are evaluated in the order of their bounds until the bound falls below
that score: what is left cannot enter the result. The score to beat starts from a
bounded sample of rows and is passed on from block to block.

The queries are a stated subset. They are broadcast in parts of at most
``query_bytes``, one part after another, and every part is one scan of the table;
vectors are never copied for a query. What leaves a task is at most k rows a query.

The origin is a pivot of every length of vectors; the ``LENGTHS`` most frequent
lengths have ``pivots`` more, far apart from each other, chosen from
``PIVOT_SAMPLE`` rows with the smallest hashes. Scores are integer inner products
of floor(scale * x); bounds are floating point and widened by a relative slack, so
elimination never drops a candidate that could tie.

Defined cases: rows with null id, null vector, or null or non-finite components
take no part; only vectors of the same length meet, empty ones with score 0; a
query's own id is no candidate; a repeated row is a candidate each time, and a
repeated query is asked once; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table or no query gives no rows; very long
vectors only make blocks larger; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: Pivots of a length, rows they are chosen from, lengths that have pivots.
PIVOTS, PIVOT_SAMPLE, LENGTHS = 32, 2_000, 16
#: Bytes of queries that are broadcast at once, rows of a block, and candidates
#: and queries that are evaluated at once.
QUERY_BYTES, ROW_BLOCK, STEP, QUERY_STEP = 16 << 20, 4_096, 256, 64
#: Relative error of distances, which are stored in single precision.
SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v: array of long) of the rows that take part."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart vectors: each next one is the farthest from those before."""
    rows = np.unique(sample.astype("f8"), axis=0)
    if not rows.size:
        return rows[:0]
    chosen: list[int] = []
    far = np.full(len(rows), np.inf)
    at = int(np.linalg.norm(rows - rows.mean(axis=0), axis=1).argmax())
    for _ in range(min(count, len(rows))):
        chosen.append(at)
        far = np.minimum(far, np.linalg.norm(rows - rows[at], axis=1))
        at = int(far.argmax())
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One row a vector: its distance to the origin, then to every pivot."""
    values = rows.astype("f8")
    return np.stack([np.linalg.norm(values, axis=1), *(np.linalg.norm(values - p, axis=1) for p in pivots)], axis=1).astype("f4")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows in parts of equal vector length."""
    sizes = pc.list_value_length(batch.column("v")).to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class Queries:
    """Queries of one vector length with the best candidates so far."""

    ids: np.ndarray
    rows: np.ndarray
    far: np.ndarray
    #: No candidate below this score can enter a query's result.
    floor: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.values = self.rows.astype("f8")
        self.square = (self.values**2).sum(axis=1)
        self.scores = [np.empty(0, "i8") for _ in self.ids]
        self.found = [np.empty(0, "i8") for _ in self.ids]
        self.evaluated = self.met = 0

    def search(self, ids: np.ndarray, rows: np.ndarray, far: np.ndarray) -> None:
        """Takes a block of candidates into account."""
        width = max(rows.shape[1], 1)
        # products of floats are exact below 2**53; larger ones are made in integers
        exact = float(max(np.abs(self.rows).max(initial=0), 1)) * float(max(np.abs(rows).max(initial=0), 1)) * width < 2**52
        values = rows.astype("f8")
        square = (values**2).sum(axis=1)
        blur = SLACK * (self.far.max(initial=0) + far.max(initial=0))
        self.met += len(self.ids) * len(ids)
        low, high = far.min(axis=0), far.max(axis=0)
        gap = np.maximum(np.maximum(low - self.far, self.far - high).max(axis=1) - blur, 0)
        most = self._bound(self.square, square.max(initial=0), gap)
        alive = np.flatnonzero(most >= self.floor)
        columns = np.ascontiguousarray(far.T)
        for at in range(0, len(alive), QUERY_STEP):
            part = alive[at : at + QUERY_STEP]
            apart = np.zeros((len(part), len(ids)), "f4")
            for p, column in enumerate(columns):
                np.maximum(apart, np.abs(column - self.far[part, p : p + 1]), out=apart)
            bounds = self._bound(self.square[part, None], square, np.maximum(apart.astype("f8") - blur, 0))
            for n, bound in zip(part, bounds):
                self._evaluate(n, bound, ids, values if exact else rows, self.values[n] if exact else self.rows[n])

    @staticmethod
    def _bound(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return (a + b - apart**2) / 2 + 1e-9 * (a + b) + 0.5

    def _evaluate(self, n: int, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray) -> None:
        order = np.flatnonzero((bound >= self.floor[n]) & (ids != self.ids[n]))
        order = order[np.argsort(-bound[order], kind="stable")]
        for done in range(0, len(order), STEP):
            take = order[done : done + STEP]
            if bound[take[0]] < self.floor[n]:
                break
            self.evaluated += len(take)
            scores = np.concatenate([self.scores[n], (rows[take] @ query).astype("i8")])
            found = np.concatenate([self.found[n], ids[take]])
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[n], self.found[n] = scores[best], found[best]
            if len(best) == self.k:
                self.floor[n] = max(self.floor[n], scores[best[-1]])

    def result(self) -> list[tuple[int, int, int]]:
        """(query, id, score) of what can be in the result."""
        return [(int(q), int(i), int(s)) for q, found, scores, least in zip(self.ids, self.found, self.scores, self.floor) for i, s in zip(found, scores) if s >= least]


def _tabled(chosen: dict[int, np.ndarray]):
    """Rows with their distances, their nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_length(batch):
                rows = _lists(part.column("v"), size)
                far = distances(rows, chosen.get(size, np.empty((0, size))))
                home = far[:, 1:].argmin(axis=1) if far.shape[1] > 1 else np.zeros(len(rows), "i8")
                near = far[np.arange(len(rows)), home + (far.shape[1] > 1)]
                offsets = pa.array(np.arange(len(rows) + 1, dtype="i4") * far.shape[1])
                columns = [part.column("id"), part.column("v"), pa.ListArray.from_arrays(offsets, pa.array(far.ravel())), pa.array(home.astype("i4")), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "far", "home", "near"])

    return run


def _seeded(samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Queries with the k-th best score that the sample gives them, null if none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_length(batch):
                ids, rows = samples.get(size, (np.empty(0, "i8"), np.empty((0, size), "i8")))
                seeds = []
                for own, row in zip(part.column("id").to_numpy(), _lists(part.column("v"), size)):
                    scores = (rows @ row)[ids != own]
                    seeds.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "v", "far")), pa.array(seeds, pa.int64())], ["id", "v", "far", "seed"])

    return run


def _searched(asked, k: int, row_block: int):
    """The best candidates among a task's rows for all queries of the broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {size: Queries(*arrays, k) for size, arrays in asked.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, row_block):
                for size, part in _by_length(batch.slice(at, row_block)):
                    if size in by_length:
                        far = part.column("far")
                        by_length[size].search(part.column("id").to_numpy(), _lists(part.column("v"), size), _lists(far, len(far[0])))
        found = [row for queries in by_length.values() for row in queries.result()]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def _queries(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """The arrays of the queries by vector length."""
    out = {}
    for size, part in _by_length(table.combine_chunks().to_batches()[0]) if table.num_rows else ():
        seeds = np.array([float("-inf") if s is None else float(s) for s in part.column("seed").to_pylist()])
        far = part.column("far")
        out[size] = (part.column("id").to_numpy(), _lists(part.column("v"), size), _lists(far, len(far[0])), seeds)
    return out


def top_k(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: int = 256,
    pivots: int = PIVOTS, query_bytes: int = QUERY_BYTES, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that the condition ``queries``
    on ``id`` picks, against all rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = quantised(vectors, id_col, vector_col, scale)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()
    chosen, samples, hashed = {}, {}, rows.withColumn("h", F.xxhash64("id", "v"))
    for size, n in sizes:
        # a hash picks some more rows than are kept, so that few are sorted; the choice doesn't hang on their order
        few = F.pmod(F.col("h"), F.lit(1 << 20)) <= min(1 << 20, (PIVOT_SAMPLE << 23) // n)
        held = hashed.where((F.size("v") == size) & few).orderBy("h", "id").limit(PIVOT_SAMPLE).select("id", "v").toArrow()
        sample = np.array(held["v"].to_pylist(), "i8").reshape(held.num_rows, size)
        chosen[size], samples[size] = choose_pivots(sample, pivots), (held["id"].to_numpy(), sample)
    made = scratch.save(rows.mapInArrow(_tabled(chosen), "id long, v array<long>, far array<float>, home int, near float"), "distances")
    # the id is part of the range, so a vector that fills a third of the table fills many partitions
    ordered = made.withColumn("size", F.size("v")).repartitionByRange("size", "home", "near", "id").sortWithinPartitions("size", "home", "near").drop("size")
    table = scratch.save(ordered, "pivot-table")
    scratch.drop("distances")
    once = table.where(queries).select("id", "v", "far").dropDuplicates(["id", "v"])
    asked = scratch.save(once.mapInArrow(_seeded(samples, k), "id long, v array<long>, far array<float>, seed long"), "queries")
    total = asked.agg(F.sum(F.size("v") * 8 + F.size("far") * 4 + 64)).first()[0] or 0
    parts = -(-total // query_bytes)
    found = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(_queries(mine.toArrow()))
        some = scratch.save(table.mapInArrow(_searched(held, k, row_block), "query_id long, vec_id long, score long"), f"found-{part}")
        held.destroy()
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
