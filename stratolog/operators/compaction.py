"""Full compaction as a relation, and its accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolog.operators.resolve import live, newest_wins
from stratolog.schema import FRAME_BYTES, OP_DELETE, OP_PUT, payload_bytes


def compact(records: DataFrame, order=("seq",)) -> DataFrame:
    """Newest record per key without tombstones: right only over all segments down to the oldest."""
    return live(newest_wins(records, order))


def dropped(seglog: DataFrame, order=("seg",)) -> DataFrame:
    """Records read, records kept and tombstones dropped by a full compaction, in one pass."""
    n = seglog.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("op", F.struct(*order)).alias("op"))
    gone = F.col("op") == OP_DELETE
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.agg(count(F.col("n")).alias("records_in"), count((~gone).cast("long")).alias("records_out"), count(gone.cast("long")).alias("tombstones_dropped"))


def should_compact(inventory: DataFrame, trigger: int, segment: str = "seg") -> DataFrame:
    if trigger < 2:
        raise ValueError("trigger must be at least 2: a lone segment would be compacted for ever")
    n = F.countDistinct(segment)
    return inventory.agg((n >= trigger).alias("should_compact"), n.alias("n_segments"))


def write_amplification(log: DataFrame, segment: str = "seg", order: str = "seq") -> DataFrame:
    """Bytes written by log, flush and one full compaction over the live payload bytes, in one pass."""
    size, framed = payload_bytes().cast("long"), F.col("n") + FRAME_BYTES
    by_segment = log.groupBy(segment, "key").agg(F.sum(size + FRAME_BYTES).alias("logged"), F.max_by(F.struct("op", size.alias("n")), order).alias("newest"))
    by_key = by_segment.groupBy("key").agg(F.sum("logged").alias("logged"), F.sum(F.col("newest.n") + FRAME_BYTES).alias("flushed"), F.max_by("newest", segment).alias("newest"))
    last = by_key.select("logged", "flushed", "newest.op", "newest.n")
    put = F.col("op") == OP_PUT
    total = F.col("log_bytes") + F.col("flush_bytes") + F.col("compact_bytes")
    return last.agg(
        F.sum("logged").alias("log_bytes"), F.sum("flushed").alias("flush_bytes"), F.sum(F.when(put, framed)).alias("compact_bytes"), F.sum(F.when(put, F.col("n"))).alias("user_bytes")
    ).withColumn("amplification", total.cast("double") / F.col("user_bytes"))
