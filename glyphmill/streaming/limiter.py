"""The token bucket as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.serving import BURST, RATE, take_token


def limit_stream(events: DataFrame, key_col: str = "user_id", time_col: str = "ts", order_col: str = "event_id", burst: int = BURST, rate: int = RATE, late: str = "1 minute") -> DataFrame:
    """(key, request, allowed) of a stream, in event time.

    A key's state is one bucket. It is dropped when the watermark has passed the
    time at which it is full again, so idle keys cost nothing; requests later than
    ``late`` are dropped.
    """
    timed = events.select(F.col(key_col).cast("string").alias("key"), F.col(order_col).cast("long").alias("request"), F.col(time_col).cast("timestamp").alias("ts"), F.unix_timestamp(time_col).alias("second"))
    rows = timed.withWatermark("ts", late)
    refill = -(-burst // rate) + 1

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["second", "request"])
        out = []
        for s in rows["second"]:
            bucket, allowed = take_token(bucket, int(s), burst, rate)
            out.append(allowed)
        state.update(bucket)
        state.setTimeoutTimestamp(max((bucket[1] + refill) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[["key", "request"]].assign(allowed=out)

    return rows.groupBy("key").applyInPandasWithState(run, "key string, request long, allowed boolean", "tokens double, second long", "append", GroupStateTimeout.EventTimeTimeout)
