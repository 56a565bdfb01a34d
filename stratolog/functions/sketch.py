"""Sparse index and Bloom filter, in their logical forms.

Segments get the physical forms from Parquet: row-group statistics, the page index and the column
Bloom filter. These functions size, inspect and test them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratolog.schema import FRAME_BYTES, payload_bytes

INDEX_INTERVAL = 16
TARGET_FPR = 0.01


def sparse_index(segments: DataFrame, segment: str = "seg", interval: int = INDEX_INTERVAL) -> DataFrame:
    """Every interval-th key of each segment in key order, with its byte offset in the framed file."""
    w = Window.partitionBy(segment).orderBy("key")
    offset = F.coalesce(F.sum(FRAME_BYTES + payload_bytes()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        segments.select(segment, "key", (F.row_number().over(w) - 1).alias("_pos"), offset.cast("long").alias("byte_offset"))
        .filter(F.col("_pos") % interval == 0)
        .drop("_pos")
    )


def sparse_seek(index: DataFrame, key, segment: str = "seg") -> DataFrame:
    """Floor lookup: where a forward scan for key starts; 0 if every indexed key is larger."""
    return index.groupBy(segment).agg(F.coalesce(F.max(F.when(F.col("key") <= F.lit(key), F.col("byte_offset"))), F.lit(0).cast("long")).alias("seek_start"))


def bloom_size(n: int, p: float = TARGET_FPR) -> tuple[int, int]:
    """(bits, hashes) for n keys at false-positive rate p."""
    n = max(n, 1)
    bits = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def bloom_sizing(counts: DataFrame, n: str = "n", p: float = TARGET_FPR) -> DataFrame:
    """bloom_size as columns; halves round to even, as in Python."""
    k = F.greatest(F.col(n), F.lit(1))
    bits = F.greatest(F.lit(8), F.ceil(-(k * math.log(p)) / (math.log(2) ** 2)))
    return counts.withColumn("num_bits", bits.cast("long")).withColumn("num_hashes", F.greatest(F.lit(1), F.bround(F.col("num_bits") / k * math.log(2))).cast("long"))


def bit_positions(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)])


def bloom_build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The filter as a table of its words of 64 bits: as many rows as bits / 64 at most."""
    at = keys.select(F.explode(bit_positions(F.col("key"), bits, hashes)).alias("bit"))
    return at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_bit("bit")).alias("set"))


def _bit(column: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(column) % 64).cast("int"))


def bloom_might_contain(probes: DataFrame, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, might_contain): true iff all positions are set, so never false for a key that was added."""
    asked = probes.select("key").distinct().withColumn("bit", F.explode(bit_positions(F.col("key"), bits, hashes)))
    hit = asked.withColumn("word", F.shiftright("bit", 6)).join(bloom, "word", "left")
    missed = F.coalesce(F.col("set").bitwiseAND(_bit("bit")), F.lit(0)) == 0
    return hit.groupBy("key").agg((~F.bool_or(missed)).alias("might_contain"))


def nearest_rank(df: DataFrame, column: str, p: float) -> DataFrame:
    """Nearest-rank percentile, sorted[min(n-1, int(n*p))], exact and without a global sort.

    Distinct values and counts are aggregated first. Values fall into some thousand steps of their logarithm;
    only the step that holds the rank is put in order.
    """
    v = F.col("value")
    step = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 64).cast("long")
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("step", step)
    upto = F.sum("n").over(Window.orderBy("step"))
    steps = counts.groupBy("step").agg(F.sum("n").alias("n")).select("step", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.least(F.col("total") - 1, F.floor(F.col("total") * p))
    chosen = steps.select("step", "before", "upto", rank.alias("rank")).filter("before <= rank and rank < upto").drop("upto")
    own = counts.join(F.broadcast(chosen), "step")  # one row
    own = own.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("step").orderBy("value")))
    return own.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("value")
