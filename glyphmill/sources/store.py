"""The index store: versions in layers of Parquet tables, each with a manifest.

A version is one layer or several: the first holds a whole index, the others what
changed since. A layer is written once and never touched again. A version becomes
current when an empty file of its number appears in ``published``, which a file
system makes all at once; the largest number counts, so there is no moment without
an index, and readers keep the DataFrames of the version they opened. Two writers of
one number can't both succeed.

Postings are range-partitioned and sorted by (term, doc_id): a lookup reads the row
groups whose range holds the term, and a frequent term fills as many partitions as
it needs; that takes the one shuffle of a build. Stop words have no postings, and
count in the documents' word counts only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, corpus_stats, few_ids, grouped, repeated_ids, term_table, word_counts
from .shared import Folder

FORMAT, VERSION = "glyphmill-index", 1
TABLES = ("docs", "postings", "terms", "stats")


class StoreError(ValueError):
    """What is at the path is no index that this version reads."""


def summary(df: DataFrame) -> dict[str, int]:
    """Rows, and a checksum of them that doesn't hang on their order: one pass."""
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum")).first()
    return {"rows": row["rows"], "checksum": row["checksum"]}


def _sorted(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    return (df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)).sortWithinPartitions(*columns)


def _path(root: str, name: str) -> str:
    """Postings lie in a folder that says that stop words have none."""
    return f"{root}/postings/stop=false" if name == "postings" else f"{root}/{name}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first."""
    return sorted(int(n) for n in Folder(spark, f"{path}/published").names() if n.isdigit())


def _next(spark: SparkSession, path: str) -> int:
    """A number that no version had, published or not."""
    known = [int(n[1:]) for n in Folder(spark, path).names() if n[:1] == "v" and n[1:].isdigit()]
    return max([0, *known, *versions(spark, path)]) + 1


def _publish(spark: SparkSession, path: str, version: int, layers: list[int], **told: object) -> None:
    """Writes the manifest of a version and makes it current."""
    tables = {name: summary(spark.read.parquet(_path(f"{path}/v{version}", name))) for name in TABLES}
    manifest = json.dumps({"format": FORMAT, "version": VERSION, "layers": layers, "tables": tables, **told})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v{version}/manifest")
    if not Folder(spark, f"{path}/published").mark(f"{version:010d}"):
        raise StoreError(f"version {version} of {path} was published by another writer")


def save(index: Index, path: str, version: int | None = None, parts: int | None = None) -> int:
    """Writes any index as a version of its own; gives its number."""
    spark = index.docs.sparkSession
    version = version or _next(spark, path)
    _write(index, f"{path}/v{version}", parts)
    _publish(spark, path, version, [version], stop_words=index.stop_words)
    return version


def _write(index: Index, root: str, parts: int | None = None) -> None:
    for name in TABLES:
        df: DataFrame = getattr(index, name)
        if name in ("postings", "terms"):
            df = _sorted(df, parts, *(("term", "doc_id") if name == "postings" else ("term",)))
        df.write.mode("overwrite").parquet(_path(root, name))


def build(docs: DataFrame, path: str, version: int | None = None, parts: int | None = None, spread: int | None = None, **options: object) -> Index:
    """Builds the index of documents and writes it. Documents are read and parsed
    once; postings come from the written ones, terms and statistics from those.

    ``spread`` deals the documents into so many partitions first, which pays for
    inputs of a few row groups only; others are better left as they are.
    """
    docs = docs.repartition(spread) if spread else docs
    spark = docs.sparkSession
    version = version or _next(spark, path)
    root = f"{path}/v{version}"
    keep_fields = bool(options.pop("keep_fields", True))
    _write_documents(docs, root, parts, keep_fields, **options)
    _sorted(term_table(spark.read.parquet(_path(root, "postings"))), parts, "term").write.mode("overwrite").parquet(f"{root}/terms")
    corpus_stats(spark.read.parquet(f"{root}/docs"), spark.read.parquet(f"{root}/terms")).write.mode("overwrite").parquet(f"{root}/stats")
    _publish(spark, path, version, [version], stop_words=options.get("stop_words"))
    return load(spark, path)


def _write_documents(docs: DataFrame, root: str, parts: int | None, keep_fields: bool, **options: object) -> None:
    """Documents with their word counts, and the postings of the written documents."""
    distinct = not repeated_ids(docs)
    word_counts(docs, keep_fields, distinct).write.mode("overwrite").parquet(f"{root}/docs")
    made = grouped(docs.sparkSession.read.parquet(f"{root}/docs"), keep_fields=keep_fields, distinct=distinct, **options)
    _sorted(made, parts, "term", "doc_id").write.mode("overwrite").parquet(_path(root, "postings"))


def add_layer(spark: SparkSession, path: str, changed: DataFrame, epoch: dict[str, object] | None = None) -> int:
    """Documents replaced or added by id, as a layer on the current version.

    Only the changed documents are tokenized and written. What the older layers
    lose is found by one scan of their ids and counts, and stored as negative
    counts beside the new terms'; no posting is rewritten.
    """
    old, told = load(spark, path), manifest(spark, path)
    version = _next(spark, path)
    root = f"{path}/v{version}"
    _write_documents(changed, root, None, True, stop_words=old.stop_words, positions="positions" in old.postings.columns)
    fresh, ids = term_table(spark.read.parquet(_path(root, "postings"))), few_ids(spark.read.parquet(f"{root}/docs").select("doc_id"))
    lost = term_table(old.postings.select("term", "doc_id", "tf").join(ids, "doc_id", "left_semi"))
    both = fresh.unionByName(lost.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
    _sorted(both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), None, "term").write.parquet(f"{root}/terms")
    layers = [*told["layers"], version]
    merged = _merged(spark, path, layers)
    corpus_stats(merged.docs, merged.terms).write.parquet(f"{root}/stats")
    _publish(spark, path, version, layers, stop_words=told.get("stop_words"), epoch=epoch)
    return version


def merge(spark: SparkSession, path: str, **told: object) -> int:
    """Writes the current version as one layer."""
    now = load(spark, path)
    version = _next(spark, path)
    _write(now, f"{path}/v{version}")
    _publish(spark, path, version, [version], stop_words=now.stop_words, **told)
    return version


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes what none of the last ``keep`` published versions reads, also what
    was never published; gives the numbers of the deleted layers."""
    last = versions(spark, path)[-keep:]
    used = {n for v in last for n in manifest(spark, path, v)["layers"]} | set(last)
    folder, marks = Folder(spark, path), Folder(spark, f"{path}/published")
    gone = [n for n in (int(x[1:]) for x in folder.names() if x[:1] == "v" and x[1:].isdigit()) if n not in used and n <= max(last, default=0)]
    for n in versions(spark, path):
        if n not in last:
            marks.delete(f"{n:010d}")
    for n in gone:
        folder.delete(f"v{n}")
    return sorted(gone)


def _layer(spark: SparkSession, path: str, version: int, name: str) -> DataFrame:
    return spark.read.parquet(_path(f"{path}/v{version}", name))


def _merged(spark: SparkSession, path: str, layers: list[int]) -> Index:
    """The index of several layers: of a document the newest one counts. Rows of a
    layer meet the ids of all newer layers at once."""
    made: dict[str, DataFrame] = {}
    newer: DataFrame | None = None
    n = 0
    for layer in reversed(layers):
        own = {name: _layer(spark, path, layer, name) for name in ("docs", "postings", "terms")}
        ids = own["docs"].select("doc_id")
        if newer is not None:
            marked = few_ids(newer, n)
            own |= {name: own[name].join(marked, "doc_id", "left_anti") for name in ("docs", "postings")}
        made = {name: df.unionByName(made[name], allowMissingColumns=True) if made else df for name, df in own.items()}
        if layer != layers[0]:
            newer, n = newer.union(ids) if newer is not None else ids, n + ids.count()
    docs, postings, terms = made["docs"], made["postings"], made["terms"]
    if len(layers) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    return Index(docs, postings, terms, _layer(spark, path, layers[-1], "stats") if _has_stats(spark, path, layers[-1]) else corpus_stats(docs, terms))


def _has_stats(spark: SparkSession, path: str, version: int) -> bool:
    return "stats" in Folder(spark, f"{path}/v{version}").names()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the current one by default, after its check."""
    known = versions(spark, path)
    if not known:
        raise StoreError(f"no index at {path}")
    version = version or known[-1]
    try:
        told = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/v{version}/manifest").take(1)))
    except json.JSONDecodeError as e:
        raise StoreError(f"damaged manifest in {path}") from e
    if told.get("format") != FORMAT or not 1 <= told.get("version", 0) <= VERSION:
        raise StoreError(f"{path} is no index of format {FORMAT}, version {VERSION}")
    return told | {"number": version}


def load(spark: SparkSession, path: str, verify: bool = False) -> Index:
    """The current version; ``verify`` reads all rows of its last layer and compares
    checksums."""
    told = manifest(spark, path)
    layers = told["layers"]
    for name in TABLES if verify else ():
        if summary(_layer(spark, path, layers[-1], name)) != told["tables"][name]:
            raise StoreError(f"{name} of {path} isn't what was written")
    index = _merged(spark, path, layers)
    index.stop_words = told.get("stop_words")
    return index
