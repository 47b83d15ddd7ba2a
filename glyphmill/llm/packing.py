"""Best-fit packing of token pieces into sequences of a fixed length.

Method: bounded-space online best-fit. A packer takes pieces one after another
and holds at most ``open_bins`` unfinished sequences. They are kept in a bitset
keyed by free space, so the tightest sequence that takes a piece is one shift and
one lowest-bit search away. When a new sequence would exceed the bound, the
fullest one closes. A piece is placed when it comes and never moved, so a packer's
memory is the bound, however many pieces stream through it.

Every row of pieces gets a number of its own, its seat. A hash of the seat deals
pieces to the packers of about ``bucket_rows`` pieces each and gives their order
there, so neither sorted tables nor repeated rows make unlike packers. The pieces
are a written table: a packing that is computed again is the same. A sequence is
named by the seat of its first piece.

Defined cases: a null or empty text is the end id alone; a repeated row is packed
once per repetition; a null id is an id; very long texts are cut into pieces like
all others; pieces of equal length are taken in the order of their hashes; an
empty table gives an empty result; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .tokens import TokenIds

#: Pieces of a packer and its unfinished sequences.
BUCKET_ROWS, OPEN_BINS = 65_536, 64


class BestFit:
    """Bounded-space best-fit over bins of ``size``; ``add`` gives (bin, offset).
    A bin has the name that came with its first piece, or its number."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0
        self.open = self.made = self.closed = 0

    def add(self, length: int, name: int | None = None) -> tuple[int, int]:
        above = self.mask >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            at = self._take(room)
        else:
            if self.open >= self.limit and length < self.size:
                # the least free space that any bin has: the fullest one closes
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.closed += 1
            at, room = self.made if name is None else name, self.size
            self.made += 1
        if room > length:
            self._put(at, room - length)
        return at, self.size - room

    def _take(self, room: int) -> int:
        bins = self.free[room]
        at = bins.pop()
        if not bins:
            self.mask ^= 1 << room
        self.open -= 1
        return at

    def _put(self, at: int, room: int) -> None:
        bins = self.free[room]
        if not bins:
            self.mask |= 1 << room
        bins.append(at)
        self.open += 1


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """The token pieces of every text: id, piece, start, length, ids_crc32 and,
    with ``keep_ids``, the ids themselves as little-endian 32-bit integers.

    Only texts of over ``size`` tokens are cut; all their pieces but the first
    are full.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TokenIds(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(data) % size or size
                bounds = [0, *range(first, len(data) + 1, size)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    raw = data[a:b].tobytes()
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw))
                    if keep_ids:
                        ids.append(raw)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def _place(size: int, open_bins: int) -> Callable:
    """Adds sequence_id and offset to the pieces of a task, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFit(size, open_bins)
        for batch in batches:
            placed = [packer.add(length, seat) for length, seat in zip(batch.column("length").to_pylist(), batch.column("seat").to_pylist())]
            at, offset = [p[0] for p in placed], [p[1] for p in placed]
            columns = [batch.column(c) for c in batch.schema.names if c != "seat"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int64()), pa.array(offset, pa.int64())], [*(c for c in batch.schema.names if c != "seat"), "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, rows: int, *, size: int = 2048, bucket_rows: int = BUCKET_ROWS, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to the ``rows`` pieces that ``cut`` holds, each
    with its seat."""
    dealt = cut.repartition(max(1, -(-rows // bucket_rows)), "seat").sortWithinPartitions(F.xxhash64("seat"), "seat")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "seat")
    return dealt.mapInArrow(_place(size, open_bins), schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False,
    bucket_rows: int = BUCKET_ROWS, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Pieces of all texts with their place: id, piece, start, length, ids_crc32,
    (ids,) sequence_id, offset. Texts are tokenised once, into a written table."""
    scratch = Scratch(docs.sparkSession, "packing")
    found = pieces(docs, id_col, text_col, vocabulary=vocabulary, size=size, end_id=end_id, keep_ids=keep_ids)
    cut = scratch.save(found.withColumn("seat", F.monotonically_increasing_id()), "pieces")
    return pack(cut, cut.count(), size=size, bucket_rows=bucket_rows, open_bins=open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pieces packed with ``keep_ids``: sequence_id, length, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return joined.select("sequence_id", "length", whole.alias("ids"))
