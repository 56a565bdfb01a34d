"""Point, batch and range reads over a changelog or over one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratolog.operators.resolve import live, newest_wins
from stratolog.schema import OP_DELETE, OP_PUT

STATES = ("LIVE", "TOMBSTONE", "ABSENT")


def in_range(df: DataFrame, start=None, end=None, key: str = "key") -> DataFrame:
    """Both bounds inclusive, either optional; a reversed range is empty and reads nothing."""
    if start is not None and end is not None and start > end:
        return df.limit(0)
    if start is not None:
        df = df.filter(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(key) <= F.lit(end))
    return df


def point_get(df: DataFrame, key, order=("seq",)) -> DataFrame:
    """(key, value) of one key, or no row if it is absent or deleted."""
    return live(newest_wins(df.filter(F.col("key") == F.lit(key)), order)).select("key", "value")


def naive_get(df: DataFrame, key, order=("seq",)) -> DataFrame:
    """point_get by reading the whole log: the key is compared inside the aggregate, so nothing is pruned."""
    newest = F.max_by(F.struct("op", "value"), F.when(F.col("key") == F.lit(key), F.struct(*order)))
    return df.agg(newest.alias("_row")).filter(F.col("_row.op") == OP_PUT).select(F.lit(key).alias("key"), F.col("_row.value").alias("value"))


def key_states(df: DataFrame, probes: DataFrame, order=("seq",)) -> DataFrame:
    """For each probe key: LIVE, TOMBSTONE or ABSENT, and the value if live."""
    hit = newest_wins(df, order).select("key", "op", "value")
    state = F.when(F.col("op").isNull(), STATES[2]).when(F.col("op") == OP_DELETE, STATES[1]).otherwise(STATES[0])
    return probes.select("key").join(hit, "key", "left").select("key", state.alias("state"), "value")


def multi_get(df: DataFrame, probes: DataFrame, order=("seq",)) -> DataFrame:
    """(key, value or NULL) for each distinct probe key.

    The probes restrict the log before resolution, so only records of probed keys are aggregated; the
    optimizer picks a broadcast for the semi-join only if the probes' size allows it.
    """
    keys = probes.select("key").distinct()
    hit = live(newest_wins(df.join(keys, "key", "left_semi"), order)).select("key", "value")
    return keys.join(hit, "key", "left")


def scan(df: DataFrame, start=None, end=None, order=("seq",)) -> DataFrame:
    """Live (key, value) rows of an inclusive range; sort by key on top where order matters."""
    return live(newest_wins(in_range(df, start, end), order)).select("key", "value")


def segment_scan(segment: DataFrame, start=None, end=None) -> DataFrame:
    """One segment's records in a range, tombstones included."""
    return in_range(segment, start, end)


def first_hit(seglog: DataFrame, segment: str = "seg") -> DataFrame:
    """The segment that answers each key, and how many newer segments were probed before it."""
    newest = seglog.agg(F.max(segment).alias("_newest"))
    hits = seglog.groupBy("key").agg(F.max(segment).alias("hit_seg"))
    return hits.join(F.broadcast(newest)).select("key", "hit_seg", (F.col("_newest") - F.col("hit_seg")).alias("segments_skipped"))
