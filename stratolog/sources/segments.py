"""Immutable key-sorted segments as Parquet, and their inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.schema import CHANGELOG_SCHEMA, OP_DELETE


def write_segment(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Range-partition by key, sort each file, and add a column Bloom filter on key.

    Sorted files give tight row-group and page statistics, so a key or range predicate reads a few
    pages; plain encoding of key makes the writer keep the Bloom filter for absent keys.
    """
    dealt = df.repartitionByRange(partitions, "key") if partitions else df.repartitionByRange("key")
    (
        dealt.sortWithinPartitions("key")
        .write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.enable.dictionary#key", "false")
        .mode("errorifexists")
        .parquet(path)
    )


def read_segment(spark: SparkSession, *paths: str, use_bloom: bool = True) -> DataFrame:
    """All records of the segments, tombstones included; empty if there are no paths."""
    if not paths:
        return spark.createDataFrame([], CHANGELOG_SCHEMA)
    return spark.read.schema(CHANGELOG_SCHEMA).option("parquet.filter.bloom.enabled", str(use_bloom).lower()).parquet(*paths)


def inventory(seglog: DataFrame, *by: str) -> DataFrame:
    """Per segment: records, tombstones, smallest and largest key."""
    return seglog.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum((F.col("op") == OP_DELETE).cast("long")), F.lit(0).cast("long")).alias("n_tomb"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )
