"""N-gram Jaccard join and its connected components, exact.

Method: grouped prefix join. Under any total order of the shingles, two sets of
Jaccard similarity t or more share a shingle among the first
n - ceil(t * n) + 1 of each. Documents with equal sets are one node; nodes with
equal prefixes and sizes are one group; groups that share a prefix shingle are
filtered by size; what is left is expanded to nodes, ruled out by class counts
where these bound the shared part too low, and verified on whole sets.

The order puts frequent shingles last: a table of counters over hashes of all
shingles of all documents, of fixed size, gives each shingle a level. A passage
that many documents share so stays out of their prefixes unless they consist
of it.

Buckets of few members are joined with themselves. Groups of copies, which fill
larger ones, are never written out in pairs: every node there is verified against
one hub first, the node with the most common shingles, and links become components.
Larger buckets that now lie in one component are done. In the others the nodes
outside the largest component are cut into blocks, which meet each other and the
blocks of the largest component; blocks of that one don't meet. A task compares two
blocks by class counts and gives the pairs of different components that may be
linked. All of these are verified, so no link between different components is lost.

Shingles are 64-bit hashes of words and node prints 128-bit ones; the join is exact
up to their collisions. A side is broadcast only if its counted rows fit the bound
of ``store.BROADCAST_BYTES``, else it is shuffled.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; texts shorter than a shingle are one shingle; very long texts are
hashed piece by piece; rows with the same id are one document, repeated rows count
once and are reported each; rows without id are reported with a null component;
where hubs tie the smaller id is it; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import fingerprint, shingle_sets
from .store import Scratch, release, small_side

#: Counters of the frequency table (2**bits) and the parts they travel in.
BITS, PARTS = 18, 16
#: Members that are verified against a hub in one task's group, classes of the
#: counts that rule pairs out before, and rows that Python holds at once.
CHUNK, CLASSES, SLICE = 64, 256, 500
#: Members of a bucket up to which its pairs are joined, and of a block beyond.
FEW, BLOCK = 32, 512
#: The one column that a removal joins to the documents meanwhile.
GONE = "__gone_by_jaccard__"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The column's texts one after another, never all at once."""
    return (value.as_py() for value in column)


def class_counts(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of CLASSES classes; the shared part of two
    sets is at most the sum of the smaller counts. Counts beyond 16 bits are
    replaced by the largest number everywhere, which keeps that a bound."""
    counts = np.bincount((hashes & np.uint64(CLASSES - 1)).astype("i8"), minlength=CLASSES)
    return (np.full(CLASSES, 0xFFFF) if counts.max() > 0xFFFF else counts).astype("<u2").tobytes()


def _may_link(percent: int) -> Callable:
    """The pairs (hub, node) whose class counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, CLASSES) for c in ("marks_a", "marks_b"))
                most = np.minimum(a, b).sum(axis=1, dtype="i8")
                both = part.column("size_a").to_numpy() + part.column("size_b").to_numpy()
                keep = pa.array(100 * most >= percent * (both - most))
                yield pa.RecordBatch.from_arrays([part.column("hub").filter(keep), part.column("node").filter(keep)], ["hub", "node"])

    return run


def _pairs_of_blocks(percent: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        mine, node, size, part = (table[c].to_numpy() for c in ("mine", "node", "size", "component"))
        marks = np.frombuffer(b"".join(table["marks"].to_pylist()), "<u2").reshape(-1, CLASSES)
        hubs, nodes = [], []
        others = np.flatnonzero(mine == high)
        for i in np.flatnonzero(mine == low):
            j = others[(part[others] != part[i]) & (np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * percent)]
            if low == high:
                j = j[node[j] > node[i]]
            most = np.minimum(marks[j], marks[i]).sum(axis=1, dtype="i8")
            j = j[100 * most >= percent * (size[j] + size[i] - most)]
            hubs.append(np.minimum(node[j], node[i])), nodes.append(np.maximum(node[j], node[i]))
        return pa.table({"hub": pa.array(np.concatenate(hubs) if hubs else [], pa.int64()), "node": pa.array(np.concatenate(nodes) if nodes else [], pa.int64())})

    return run


def _summaries(n: int) -> Callable:
    """(id, size, print) of every row; at the end of a task also its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, "i8")
        for batch in batches:
            sizes, prints = [], []
            for hashes in shingle_sets(texts_of(batch.column(1)), n):
                np.add.at(counts, (hashes >> np.uint64(64 - BITS)).astype("i8"), 1)
                sizes.append(len(hashes)), prints.append(fingerprint(hashes))
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["id", "size", "print", "part", "counts"]
            )
        parts = [x.tobytes() for x in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())],
            ["id", "size", "print", "part", "counts"],
        )
        release()

    return run


def _add_up(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << BITS) // PARTS, "i8")
    for chunk in table["counts"].chunks:
        for value in chunk:
            total += np.frombuffer(value.as_buffer(), "i8")
    return pa.table({"part": table["part"].slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _levels(counters: DataFrame) -> np.ndarray:
    """A level of 0 to 255 for every counter, by the logarithm of its sum."""
    tasks = counters.count() // PARTS
    salts = max(1, int(tasks**0.5))
    partly = counters.select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(salts)).alias("salt")).groupBy("part", "salt").applyInArrow(_add_up, "part int, counts binary")
    whole = partly.groupBy("part").applyInArrow(_add_up, "part int, counts binary").collect()
    if not whole:
        return np.zeros(1 << BITS, "u8")
    sums = np.concatenate([np.frombuffer(r["counts"], "i8") for r in sorted(whole, key=lambda r: r["part"])])
    return np.minimum(np.log2(1 + sums.astype("f8")) * 6, 255).astype("u8")


def _prefixes(n: int, percent: int, levels: np.ndarray) -> Callable:
    """(id, size, print, group, prefix, marks, common) of every row with a set;
    group: a hash of prefix and size; marks: its class counts; common: the mean
    level of its shingles, which is largest in the text that others are copies of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints, groups, prefixes, marks, common = [], [], [], [], [], [], []
            for id_, hashes in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch.column(1)), n)):
                if not len(hashes) or id_ is None:
                    continue
                k = prefix_length(len(hashes), percent)
                level = levels[(hashes >> np.uint64(64 - BITS)).astype("i8")]
                ranks = (level << np.uint64(56)) | (hashes >> np.uint64(8))
                common.append(int(level.sum()) * 1000 // len(hashes))
                prefix = hashes[np.argpartition(ranks, k - 1)[:k]] if k < len(hashes) else hashes
                prefix = np.sort(prefix)
                ids.append(id_), sizes.append(len(hashes)), prints.append(fingerprint(hashes))
                groups.append(fingerprint(np.append(prefix, np.uint64(len(hashes)))))
                prefixes.append(prefix.view("i8")), marks.append(class_counts(hashes))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype("i4")
            values = np.concatenate(prefixes) if prefixes else np.empty(0, "i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(groups, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(marks, pa.binary()), pa.array(common, pa.int64())],
                ["id", "size", "print", "group", "prefix", "marks", "common"],
            )
        release()

    return run


def _sets(n: int) -> Callable:
    """The set of every row whose text is the one the node stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep, sets, prints = [], [], part.column(2).to_pylist()
                for i, hashes in enumerate(shingle_sets(texts_of(part.column(1)), n)):
                    if fingerprint(hashes) == prints[i]:
                        keep.append(i), sets.append(hashes.tobytes())
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in (0, 3, 4)), pa.array(sets, pa.binary())], ["node", "hub", "chunk", "hashes"])

    return run


def _verify(percent: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        hub = key[0].as_py()
        sets = dict(zip(table["node"].to_pylist(), (np.frombuffer(b, "u8") for b in table["hashes"].to_pylist())))
        own, out = sets.pop(hub), []
        for node, other in sets.items():
            shared = len(np.intersect1d(own, other, assume_unique=True))
            if linked(shared, len(own), len(other), percent):
                out.append(node)
        return pa.table({"a": pa.array([hub] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return run


class Join:
    """One run of the join; ``links`` grows by round."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        self.n, self.percent = n, percent
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        seen = self.scratch.save(self.rows.mapInArrow(_summaries(n), "id long, size long, print binary, part int, counts binary"), "summaries")
        self.sets = seen.where("part is null").select("id", "size", "print")
        levels = _levels(seen.where("part is not null").select("part", "counts"))
        self.prefixes = self.scratch.save(self.rows.mapInArrow(_prefixes(n, percent, levels), "id long, size long, print binary, group binary, prefix array<long>, marks binary, common long"), "prefixes")
        pairs = self.prefixes.groupBy("id", "print").agg(F.count("*").alias("n"))
        if not pairs.where("n > 1").isEmpty():
            # rows that are repeated as they are stand for one, everywhere but in the result
            self.prefixes = self.scratch.save(self.prefixes.dropDuplicates(["id", "print"]), "prefixes-once")
            again = small_side(self.scratch.save(pairs.where("n > 1").select(F.col("id").alias(GONE)).distinct(), "repeated"), 8)
            same = self.rows["id"] == F.col(GONE)
            self.rows = self.rows.join(again, same, "left_anti").union(self.rows.join(again, same, "left_semi").dropDuplicates(["id", "text"]))
        nodes = self.prefixes.groupBy("print").agg(F.min("id").alias("node"), F.first("size").alias("size"), F.first("group").alias("group"), F.first("common").alias("common"))
        groups = nodes.groupBy("group").agg(F.min("node").alias("hub"))
        self.members = self.scratch.save(nodes.join(groups, "group").select("node", "size", "print", "common", F.col("hub").alias("group")), "members")
        self.links: DataFrame | None = None
        self.rounds = 0

    def buckets(self) -> DataFrame:
        """(shingle, group, size) of the prefix shingles that two groups share."""
        lead = self.members.where(F.col("node") == F.col("group")).select(F.col("node").alias("id"), "print")
        each = self.prefixes.join(lead, ["id", "print"], "left_semi")
        rows = each.select(F.explode("prefix").alias("shingle"), F.col("id").alias("group"), "size")
        ends = rows.groupBy("shingle").agg(F.min("group").alias("first"), F.max("group").alias("last"), F.count("*").alias("n")).where(F.col("first") != F.col("last"))
        shared = small_side(self.scratch.save(ends.select("shingle", "first", "n"), "shared"), 24)
        made = self.scratch.save(rows.join(shared, "shingle"), "buckets")
        self.scratch.drop("shared")
        return made

    def marks(self) -> DataFrame:
        """(id, marks, size) of the nodes."""
        own = self.members.select(F.col("node").alias("id"), "print", "size")
        return self.prefixes.select("id", "print", "marks").join(own, ["id", "print"]).drop("print")

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs (hub, node) that are linked to ``links``."""
        self.rounds += 1
        name = f"round-{self.rounds}"
        met = self.scratch.save(pairs.where("hub != node").distinct(), f"{name}-met")
        marks = self.marks()
        small = small_side(met, 16)
        one = marks.select(F.col("id").alias("hub"), F.col("marks").alias("marks_a"), F.col("size").alias("size_a")).join(small, "hub")
        two = one.join(marks.select(F.col("id").alias("node"), F.col("marks").alias("marks_b"), F.col("size").alias("size_b")), "node")
        pairs = self.scratch.save(two.mapInArrow(_may_link(self.percent), "hub long, node long").distinct(), f"{name}-pairs")
        if pairs.isEmpty():
            return
        busy = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        dealt = pairs.join(busy, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
        needed = dealt.union(dealt.select("hub", F.col("hub").alias("node"), "chunk").distinct()).join(self.members.select("node", "print"), "node")
        need = small_side(self.scratch.save(needed, f"{name}-needed"), 44)
        texts = self.rows.join(need, self.rows["id"] == need["node"]).select("node", "text", "print", "hub", "chunk")
        sets = texts.mapInArrow(_sets(self.n), "node long, hub long, chunk int, hashes binary")
        found = self.scratch.save(sets.groupBy("hub", "chunk").applyInArrow(_verify(self.percent), "a long, b long"), f"{name}-links")
        for done in ("met", "pairs", "needed"):
            self.scratch.drop(f"{name}-{done}")
        self.links = found if self.links is None else self.links.union(found)

    def classes(self) -> DataFrame:
        """(node, component) for all nodes."""
        if self.links is None:
            return self.members.select("node", F.col("node").alias("component"))
        known = components(self.links, self.scratch, f"components-{self.rounds}")
        both = self.members.select("node").join(known, "node", "left")
        return both.select("node", F.coalesce("component", "node").alias("component"))

    def run(self) -> DataFrame:
        """(node, component) after every link across components was looked at."""
        buckets = self.buckets()
        large = self.scratch.save(self.large(buckets), "large")
        self.verify(self.to_hubs(large))
        held = self.scratch.save(self.members.select("node", "group", "size").join(self.classes(), "node"), "held")
        self.verify(self.few(buckets, held).union(self.blocked(large, held)))
        # links and members are all that is read from here on
        for done in ("buckets", "large", "held", "placed", "blocks", "prefixes"):
            self.scratch.drop(done)
        return self.classes()

    def large(self, buckets: DataFrame) -> DataFrame:
        """(key, own, node, size, common) of buckets and groups of more than FEW."""
        in_buckets = buckets.where(F.col("n") > FEW).select(F.col("shingle").alias("key"), F.lit(False).alias("own"), "group")
        groups = self.members.groupBy("group").count().where(F.col("count") > FEW).select("group")
        keys = in_buckets.union(groups.select(F.col("group").alias("key"), F.lit(True).alias("own"), "group"))
        return keys.join(self.members, "group").select("key", "own", "node", "size", "common")

    def to_hubs(self, large: DataFrame) -> DataFrame:
        """(hub, node): every node of a large bucket with one hub, the node of its
        buckets whose shingles are the most common ones."""
        top = F.max(F.struct("common", (-F.col("node")).alias("minus"), F.col("size").alias("hub_size")))
        hubs = large.groupBy("key", "own").agg(top.alias("hub"))
        near = large.join(hubs, ["key", "own"]).where(self._sizes("size", "hub.hub_size"))
        best = near.groupBy("node").agg(F.max(F.struct("hub.common", "hub.minus")).alias("hub"))
        return best.select((-F.col("hub.minus")).alias("hub"), "node")

    def few(self, buckets: DataFrame, held: DataFrame) -> DataFrame:
        """(hub, node) of different components that meet in buckets and groups of
        at most FEW: group pairs are filtered by size, then expanded."""
        small = buckets.where(F.col("n") <= FEW)
        a, b = (small.select("shingle", F.col("group").alias(f"group_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
        near = a.join(b, (a["shingle"] == b["shingle"]) & (F.col("group_a") < F.col("group_b")) & self._sizes("size_a", "size_b")).select("group_a", "group_b").distinct()
        ends = [held.select(F.col("node").alias(n), F.col("group").alias(f"group_{s}"), F.col("component").alias(f"component_{s}")) for s, n in (("a", "hub"), ("b", "node"))]
        across = near.join(ends[0], "group_a").join(ends[1], "group_b")
        groups = held.groupBy("group").count().where(F.col("count").between(2, FEW)).select("group")
        inner = held.join(groups, "group")
        ends = [inner.select("group", F.col("node").alias(n), F.col("component").alias(f"component_{s}")) for s, n in (("a", "hub"), ("b", "node"))]
        inside = ends[0].join(ends[1], "group").where("hub < node")
        both = across.select("hub", "node", "component_a", "component_b").union(inside.select("hub", "node", "component_a", "component_b"))
        return both.where("component_a != component_b").select("hub", "node")

    def blocked(self, large: DataFrame, held: DataFrame) -> DataFrame:
        """(hub, node) of different components that meet in larger buckets and
        groups, if their class counts allow a link. A task sees two blocks of a
        bucket, at most one of them of its largest component, and gives only the
        pairs that are left."""
        rows = self.scratch.save(large.select("key", "own", "node", "size").join(held.select("node", "component"), "node"), "placed")
        parts = rows.groupBy("key", "own", "component").agg(F.count("*").alias("n"))
        most = F.max(F.struct("n", "component"))
        blocks = parts.groupBy("key", "own").agg(most["component"].alias("main"), F.ceil(most["n"] / BLOCK).cast("int").alias("k_main"), F.ceil((F.sum("n") - most["n"]) / BLOCK).cast("int").alias("k_rest")).where("k_rest > 0")
        open_ = rows.join(small_side(self.scratch.save(blocks, "blocks"), 29), ["key", "own"])
        inside, number = F.col("component") == F.col("main"), F.xxhash64("node")
        # blocks of the largest component have negative numbers
        mine = F.when(inside, -1 - F.pmod(number, F.col("k_main"))).otherwise(F.pmod(number, F.col("k_rest"))).cast("int")
        rest, main = F.sequence(F.lit(0), F.col("k_rest") - 1), F.sequence(-F.col("k_main"), F.lit(-1))
        dealt = open_.withColumn("mine", mine).withColumn("other", F.explode(F.when(inside, rest).otherwise(F.concat(main, rest))))
        dealt = dealt.join(self.marks().select(F.col("id").alias("node"), "marks"), "node")
        dealt = dealt.select("key", "own", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "size", "component", "marks")
        return dealt.groupBy("key", "own", "low", "high").applyInArrow(_pairs_of_blocks(self.percent), "hub long, node long")

    def _sizes(self, a: str, b: str):
        """What the sizes of linked sets must satisfy."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document row: id, size of its set, component: the smallest id
    that links reach, itself included."""
    join = Join(docs, id_col, text_col, n, percent)
    classes = join.run()
    known = join.members.join(classes, "node").select("print", "component")
    with_set = join.sets.where("size > 0 and id is not null").join(known, "print").select("id", "size", "component")
    without = join.sets.where("size = 0 or id is null").select("id", "size", F.col("id").alias("component"))
    return with_set.union(without)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    id. Rows without id stay; of rows with one id one stays."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.save(near_duplicates(docs, id_col, text_col, n=n, percent=percent), "classes")
    gone = small_side(scratch.save(found.where(F.col("id") != F.col("component")).select(F.col("id").alias(GONE)).distinct(), "gone"), 8)
    left = docs.join(gone, docs[id_col].cast("long") == F.col(GONE), "left_anti")
    again = scratch.save(found.where("id is not null and id = component").groupBy("id").count().where("count > 1").select(F.col("id").alias(GONE)), "again")
    if again.isEmpty():
        return left
    same = left[id_col].cast("long") == F.col(GONE)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col]))
