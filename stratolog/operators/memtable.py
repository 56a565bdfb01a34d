"""The unflushed tail as a relation: its content, size and flush threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolog.operators.resolve import newest_wins
from stratolog.schema import payload_bytes


def state(tail: DataFrame) -> DataFrame:
    return newest_wins(tail)


def size(resolved: DataFrame, *by: str) -> DataFrame:
    """Payload bytes and keys, tombstones counted with an empty value."""
    return resolved.groupBy(*by).agg(F.sum(payload_bytes()).cast("long").alias("size_bytes"), F.count(F.lit(1)).alias("n_keys"))


def is_full(resolved: DataFrame, limit: int, *by: str) -> DataFrame:
    """The limit is inclusive: a memtable of exactly limit bytes is full."""
    return size(resolved, *by).select(*by, (F.col("size_bytes") >= limit).alias("is_full"))
