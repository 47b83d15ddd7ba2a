"""JSON-lines log and export sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]


def log_lines(events: DataFrame, least: str = "INFO", level_col: str = "level", time_col: str = "ts") -> DataFrame:
    """(value): a JSON line for every event of the level or above; time in
    ISO 8601, UTC; null fields are left out."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col(level_col))
    others = [c for c in events.columns if c not in (level_col, time_col)]
    stamp = F.date_format(F.col(time_col), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    return events.where(rank >= LEVELS.index(least) + 1).select(F.to_json(F.struct(stamp, F.col(level_col).alias("level"), *others)).alias("value"))


def write_log(events: DataFrame, path: str, least: str = "INFO") -> None:
    log_lines(events, least).write.mode("append").text(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
