"""Benchmark decontamination by exact n-gram windows, in DataFrame functions only.

Method: the windows of all benchmark items are normalised, hashed and, below a
checked size, broadcast as a hash table; every token window of every document
probes it by hash, a hit is verified word by word, and the hit spans or the
contaminated documents are removed. Beyond the checked size the same join is
left to the optimiser, which shuffles by the window's hash. The size counts words,
the lists of items that share a window, and what every row and value takes besides.

Defined cases: null and wordless texts have no words and no hits; an item of
fewer than ``n`` words is one window; items without id, text or words are left
out; a window that several items have is a hit of each, and overlapping hits count
a word once; very long texts are scanned whole, one window at a time; repeated
document rows are reported one by one; repeated items count once; an empty
benchmark leaves all documents clean, an empty table has an empty result; extra
columns are kept by the removals and never clash, since internal names live in
structs of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same separators in texts whose case is not folded.
RAW_SEPARATORS, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A benchmark's windows and a list of documents to change are broadcast up to
#: this many bytes in memory; bytes of a row and of a value besides its content.
BROADCAST_BYTES, ROW_BYTES, VALUE_BYTES = 64 << 20, 64, 24
#: The one column that a removal joins to the documents meanwhile.
FOUND = "__found_by_decontamination__"


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    plain = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    return F.when(ascii_only, F.lower(plain)).otherwise(F.translate(plain, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold(text), SEPARATORS), "")


def _hash(array: Column, at: Column | int, length: int) -> Column:
    return F.xxhash64(*(F.get(array, at + k if isinstance(at, Column) else F.lit(at + k)) for k in range(length)))


def _bytes(*lists: str) -> Column:
    """What a row with these lists of values takes in memory."""
    of = lambda c: F.octet_length(F.array_join(F.transform(c, lambda v: v.cast("string")), "")) + F.size(c) * VALUE_BYTES
    return sum((of(c) for c in lists), F.lit(ROW_BYTES).cast("long"))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 8) -> DataFrame:
    """Distinct windows: length, key, words, items (ids of the items that have it)."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    length = F.least(F.size("w"), F.lit(n))
    cut = items.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    each = cut.select("item", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("words"))
    sets = each.groupBy("words").agg(F.first("length").alias("length"), F.collect_set("item").alias("items"))
    key = F.coalesce(*(F.when(F.col("length") == k, _hash(F.col("words"), 0, k)) for k in range(1, n + 1)))
    return sets.select("length", key.alias("key"), "words", "items")


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", n: int = 8
) -> DataFrame:
    """One row per document row: id, text_key (a hash of the text), n_words,
    spans (array of word positions [start, length] that windows occupy), items
    (ids of the items with an occurring window)."""
    grams = windows(benchmark, item_id, item_text, n)
    size = grams.agg(F.sum(_bytes("words", "items")).alias("b"), F.collect_set("length").alias("l")).first()
    lengths = sorted(size["l"])
    small = (size["b"] or 0) <= BROADCAST_BYTES
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), words(F.col(text_col)).alias("w")
    )
    # position -1 stands for the document itself, so that all come out of one scan
    spots = rows.select("row", "id", "text_key", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    at = F.col("at")

    def key(length: int) -> Column:
        return F.when((at >= 0) & (at + length <= F.size("w")), _hash(F.col("w"), at, length))

    if len(lengths) > 1:
        probes = F.array(*(F.struct(F.lit(k).alias("length"), key(k).alias("key")) for k in lengths))
        spots = spots.select("row", "id", "text_key", "w", "at", F.inline(probes))
    else:
        k = lengths[0] if lengths else n
        spots = spots.select("row", "id", "text_key", "w", "at", F.lit(k).alias("length"), key(k).alias("key"))
    here = F.slice("w", F.greatest(at + 1, F.lit(1)), F.col("length"))
    grams = grams.select(F.struct("length", "words").alias("gram"), F.col("key").alias("gram_key"), "items")
    sized = ["row", "id", "text_key", F.when(at == -1, F.size("w")).alias("n_words"), "at", "length", "key"]
    if small:
        # the words of a text are only referred to here: nothing is copied per position
        spots, grams = spots.select(*sized, "w"), F.broadcast(grams)
    else:
        # rows are shuffled, each with the words of its own window
        spots = spots.select(*sized, F.when(at >= 0, here).alias("here"))
        here = F.col("here")
    same = (F.col("key") == F.col("gram_key")) & (F.col("length") == F.col("gram.length")) & (here == F.col("gram.words"))
    hits = spots.join(grams, same, "left").where((at == -1) | F.col("gram").isNotNull())
    hits = hits.select("row", "id", "text_key", "n_words", F.when(at >= 0, F.struct(at.alias("start"), "length")).alias("span"), "items")
    found = hits.groupBy("row").agg(
        F.first("id").alias("id"), F.first("text_key").alias("text_key"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")
    )
    return found.select("id", "text_key", "n_words", "spans", F.array_distinct(F.flatten("items")).alias("items"))


def hit_positions(spans: Column) -> Column:
    """Distinct positions of words inside any span."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))


def _hit_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, n: int, least_items: int) -> tuple[DataFrame, Column]:
    """The documents with hits, written and ready to join with ``docs``, and the
    condition; the list is broadcast below a checked size."""
    found = find(docs, benchmark, id_col, text_col, n=n).where(F.size("items") >= least_items)
    side = Scratch(docs.sparkSession, "decontam").save(found.select(F.struct("id", "text_key", "spans", "items").alias(FOUND)).dropDuplicates([FOUND]), "hits")
    size = side.agg(F.sum(_bytes(f"{FOUND}.spans", f"{FOUND}.items"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return side, docs[id_col].eqNullSafe(F.col(f"{FOUND}.id")) & (F.xxhash64(docs[text_col]) == F.col(f"{FOUND}.text_key"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 8, least_items: int = 2) -> DataFrame:
    """``docs`` without the rows in which windows of ``least_items`` items occur."""
    side, same = _hit_rows(docs, benchmark, id_col, text_col, n, least_items)
    return docs.join(side, same, "left_anti")


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 8, drop_items: int | None = None
) -> DataFrame:
    """``docs`` with every hit word, and the separators after it, cut from the
    text; rows with windows of ``drop_items`` items or more are removed whole."""
    side, same = _hit_rows(docs, benchmark, id_col, text_col, n, 1)
    text, spans = docs[text_col], F.col(f"{FOUND}.spans")
    lead = F.regexp_extract(text, f"^{RAW_SEPARATORS}+", 0)
    parts = F.regexp_extract_all(text, F.lit(f"{RAW_WORD}+{RAW_SEPARATORS}*"), F.lit(0))

    def without_hits(p: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), hit_positions(spans))
        return F.array_join(F.transform(kept, lambda i: F.get(p, i)), "")

    # the array is bound once: inside the inner lambda it would be cut anew for every word
    cut = F.concat(lead, F.array_join(F.transform(F.array(parts), without_hits), ""))
    changed = F.when(spans.isNotNull(), cut).otherwise(text)
    joined = docs.join(side, same, "left")
    if drop_items is not None:
        joined = joined.where(F.coalesce(F.size(F.col(f"{FOUND}.items")) < drop_items, F.lit(True)))
    return joined.select(*(changed.alias(c) if c == text_col else docs[c] for c in docs.columns))
