"""Serving state as queries: cache replay, rate limiting, hash-table statistics."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bytes_as_characters

#: Entries of the cache; tokens of a bucket and tokens a second.
CACHE_ENTRIES, BURST, RATE = 256, 40, 20
#: 64-bit FNV-1a, buckets at first, and the load that doubles them.
FNV_OFFSET, FNV_PRIME, FIRST_BUCKETS, MAX_LOAD = 14695981039346656037, 1099511628211, 4096, 0.75


class LruCache:
    """A bounded cache; counters outlive ``clear``."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.hits, self.misses = entries, 0, 0
        self.held: OrderedDict[str, object] = OrderedDict()

    def get(self, key: str) -> object | None:
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        return None

    def put(self, key: str, value: object) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.entries:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


def replay_cache(requests: DataFrame, node_col: str, key_col: str, order_col: str, entries: int = CACHE_ENTRIES) -> DataFrame:
    """(node, request, key, hit): what an LRU cache on every serving node does
    with its requests in order.

    A node's requests are sorted and streamed through one task, which holds the
    cache only; nodes run side by side.
    """
    rows = requests.select(F.col(node_col).cast("string").alias("node"), F.col(order_col).cast("long").alias("request"), F.col(key_col).cast("string").alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caches: dict[str, LruCache] = {}
        node = None
        for batch in batches:
            hits = []
            for n, k in zip(batch["node"], batch["key"]):
                if n != node:
                    caches, node = {n: LruCache(entries)}, n
                hit = caches[n].get(k) is not None
                if not hit:
                    caches[n].put(k, True)
                hits.append(hit)
            yield batch.assign(hit=hits)

    dealt = rows.repartition("node").sortWithinPartitions("node", "request")
    return dealt.mapInPandas(run, "node string, request long, key string, hit boolean")


def hit_rate(hits: Column, misses: Column) -> Column:
    """Percent of requests that hit; 100 without requests."""
    total = hits + misses
    return F.when(total > 0, hits / total * 100).otherwise(100.0)


def take_token(state: tuple[float, int] | None, second: int, burst: int = BURST, rate: int = RATE) -> tuple[tuple[float, int], bool]:
    """One request against a bucket (tokens, second of the last refill)."""
    tokens, last = state if state else (float(burst), second)
    if second > last:
        tokens, last = min(float(burst), tokens + (second - last) * rate), second
    if tokens >= 1:
        return (tokens - 1, last), True
    return (tokens, last), False


def limit_rate(events: DataFrame, key_col: str = "user_id", time_col: str = "ts", order_col: str = "event_id", burst: int = BURST, rate: int = RATE) -> DataFrame:
    """(key, request, allowed): a token bucket for every key, in order of time.

    Rows are dealt by key, sorted, and streamed; the state is one bucket.
    """
    rows = events.select(F.col(key_col).cast("string").alias("key"), F.col(order_col).cast("long").alias("request"), F.unix_timestamp(time_col).alias("second"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, s in zip(batch["key"], batch["second"]):
                if k != key:
                    key, state = k, None
                state, allowed = take_token(state, int(s), burst, rate)
                out.append(allowed)
            yield batch[["key", "request"]].assign(allowed=out)

    dealt = rows.repartition("key").sortWithinPartitions("key", "second", "request")
    return dealt.mapInPandas(run, "key string, request long, allowed boolean")


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a string's bytes as a struct (high, low) of its
    halves, so that no product overflows."""
    chars = F.filter(F.split(bytes_as_characters(text), ""), lambda c: c != "")
    number = lambda n: F.lit(n).cast("long")
    start = F.struct(number(FNV_OFFSET >> 32).alias("high"), number(FNV_OFFSET & 0xFFFFFFFF).alias("low"))
    word, small = 1 << 32, FNV_PRIME & 0xFFFFFFFF  # the prime is 2**40 and a small number

    def step(h: Column, c: Column) -> Column:
        low = h["low"].bitwiseXOR(F.ascii(c).cast("long"))
        product = low * small
        carried = h["high"] * small + F.shiftright(product, 32) + low * (FNV_PRIME >> 32)
        return F.struct((carried % word).alias("high"), (product % word).alias("low"))

    return F.aggregate(chars, start, step)


def fnv1a_bucket(text: Column, buckets: int) -> Column:
    """The bucket of a string in a table of so many buckets, a power of two of at
    most 2**32."""
    return fnv1a(text)["low"] % buckets


def bucket_count(n: int) -> int:
    """Buckets of a table that grew to n entries."""
    least = max(1.0, (n - 1) / MAX_LOAD / FIRST_BUCKETS)
    return FIRST_BUCKETS << math.ceil(math.log2(least))


def table_stats(terms: DataFrame) -> DataFrame:
    """(unique_terms, buckets, load_factor, hash_collisions) of the term table."""
    n = terms.count()
    buckets = bucket_count(n)
    used = terms.select(fnv1a_bucket(F.col("term"), buckets).alias("b")).agg(F.countDistinct("b").alias("used"))
    return used.select(F.lit(n).cast("long").alias("unique_terms"), F.lit(buckets).cast("long").alias("buckets"), F.lit(n / buckets).alias("load_factor"), (F.lit(n) - F.col("used")).cast("long").alias("hash_collisions"))
