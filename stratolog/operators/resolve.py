"""Newest-wins resolution: the operator that every read goes through.

Key predicates commute with resolution and Catalyst pushes them through it to the scan; predicates on
op or value don't, and are applied only to its output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratolog.schema import OP_DELETE, OP_PUT


def newest_wins(df: DataFrame, order=("seq",), key: str = "key") -> DataFrame:
    """One row per key, the last in the given order; tombstones pass through.

    max_by has a partial aggregate, so each map task sends at most one row per key and a hot key
    reaches its reducer as one row per task.
    """
    rest = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return df.groupBy(key).agg(picked.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def newest_within(df: DataFrame, group: str, order: str = "seq", key: str = "key") -> DataFrame:
    """The newest row per (group, key): what each segment holds after its flush."""
    rest = [c for c in df.columns if c not in (key, group)]
    picked = F.max_by(F.struct(*rest), F.col(order))
    return df.groupBy(group, key).agg(picked.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], group)


def live(resolved: DataFrame) -> DataFrame:
    """Keys whose newest record is a put; an empty value is live."""
    return resolved.filter(F.col("op") == OP_PUT)


def tombstones(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("op") == OP_DELETE)


def merge_segments(segments: list[DataFrame]) -> DataFrame:
    """Merge sources given oldest first: position decides, then seq inside a source; tombstones kept."""
    tagged = [s.withColumn("segment_ord", F.lit(i)) for i, s in enumerate(segments)]
    return newest_wins(reduce(DataFrame.unionByName, tagged), ("segment_ord", "seq")).drop("segment_ord")


def shadowed_versions(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("shadowed"))


def version_history(df: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Each record's version number and the seq that ended its validity."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, F.row_number().over(w).cast("long").alias("version"), F.lead(order).over(w).alias("valid_to"))
