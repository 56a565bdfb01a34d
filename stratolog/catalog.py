"""The query catalog over the driver's tables, with the SQL that each query must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.functions import sketch
from stratolog.operators import compaction, lookup, memtable, resolve
from stratolog.schema import FRAME_BYTES, OP_DELETE, OP_PUT, payload_bytes
from stratolog.sources import segments

EVENTS = "event_id long, user_id long, event_type string, props string"
ORDERS = "o_orderkey long, o_custkey long, o_orderpriority string"
SEGMENT_WIDTH = 250
MEMTABLE_LIMIT = 1024
TRIGGER = 4


def _key(column: str):
    return F.lpad(F.col(column).cast("string"), 8, "0")


#: Keys are ids of eight digits; those of more digits or below 0 have keys of their own.
LAST_ID = 99_999_999


def _ids(start: str | None, end: str | None):
    """A filter on user_id that keeps all rows with keys in [start, end], for the scan to prune by."""
    odd, bounds = (F.col("user_id") < 0) | (F.col("user_id") > LAST_ID), F.lit(True)
    for bound, fits in ((start, lambda x: F.col("user_id") >= x), (end, lambda x: F.col("user_id") <= x)):
        if bound is not None and len(bound) == 8 and bound.isdigit():
            bounds = bounds & fits(int(bound))
    return odd | bounds


def changelog(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """events as a changelog: an error deletes the user's key, anything else puts props.

    Bounds on the key, where given, are handed to the scan as bounds on user_id; they don't replace a filter.
    """
    gone = F.col("event_type") == "error"
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    if start is not None or end is not None:
        events = events.filter(_ids(start, end))
    return events.select(
        _key("user_id").alias("key"),
        F.when(gone, OP_DELETE).otherwise(OP_PUT).alias("op"),
        F.when(~gone, F.col("props")).alias("value"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / SEGMENT_WIDTH).cast("long").alias("seg"),
    )


def _scan(spark, sf, start=None, end=None):
    return lookup.scan(changelog(spark, sf, start, end), start, end)


def seglog(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.newest_within(changelog(spark, sf), "seg")


def latest(spark: SparkSession, sf: str) -> DataFrame:
    # seg grows with seq, so the newest record overall is the newest of the newest segment
    return resolve.newest_wins(changelog(spark, sf))


def live(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.live(latest(spark, sf)).select("key", "value")


def _memtable(spark, sf):
    log = changelog(spark, sf)
    last = log.agg(F.max("seg").alias("seg"))
    return resolve.newest_wins(log.join(F.broadcast(last), "seg")).select("key", "op", "value")


def _customers(spark, sf):
    return spark.read.schema(ORDERS).parquet(f"{sf}/orders.parquet").select(_key("o_custkey").alias("key"))


def _probes(spark):
    return spark.createDataFrame([("00000001",), ("00000003",), ("00000006",), ("zzzz",)], "key string")


def _orders_live(spark, sf):
    orders = spark.read.schema(ORDERS).parquet(f"{sf}/orders.parquet").select(_key("o_custkey").alias("key"), "o_orderkey", "o_orderpriority")
    return resolve.newest_wins(orders, ("o_orderkey",))


def _bloom_membership(spark, sf):
    """Every customer key against a filter over the log's keys: keys, probes, those in the log, of these the
    ones that the filter denies, and whether false positives stay below three times the target rate."""
    keys = changelog(spark, sf).select("key").distinct()
    bits, hashes = sketch.bloom_size(keys.count())  # a filter is made for a number of keys
    told = sketch.bloom_might_contain(_customers(spark, sf), sketch.bloom_build(keys, bits, hashes), bits, hashes)
    both = told.join(keys.withColumn("here", F.lit(True)), "key", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    wrong = F.count_if(F.col("might_contain") & ~F.col("here")) <= 3 * sketch.TARGET_FPR * F.count_if(~F.col("here"))
    counts = both.agg(F.count(F.lit(1)).alias("n_probes"), F.count_if("here").alias("n_present"), F.count_if(F.col("here") & ~F.col("might_contain")).alias("false_negatives"), wrong.alias("rate_kept"))
    return keys.agg(F.count(F.lit(1)).alias("n_keys")).join(F.broadcast(counts))  # one row each


def _latency_rank(spark, sf):
    return sketch.nearest_rank(seglog(spark, sf).select(payload_bytes().alias("size")), "size", 0.99).select(F.col("value").cast("long").alias("p99"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "wal_replay_order": lambda s, d: changelog(s, d).select("seq", "key", "op", "value"),
    "memtable_state": _memtable,
    "memtable_size_bytes": lambda s, d: memtable.size(seglog(s, d), "seg"),
    "memtable_is_full": lambda s, d: memtable.is_full(seglog(s, d), MEMTABLE_LIMIT, "seg"),
    "flush_segments": lambda s, d: seglog(s, d).select("seg", "key", "op", "value"),
    "segment_inventory": lambda s, d: segments.inventory(seglog(s, d), "seg"),
    "kway_merge_newest_wins": lambda s, d: latest(s, d).select("key", "op", "value"),
    "live_view": live,
    "point_get": lambda s, d: lookup.point_get(changelog(s, d, "00000001", "00000001"), "00000001"),
    "point_get_tombstone_state": lambda s, d: lookup.key_states(changelog(s, d), _probes(s)),
    "multi_get": lambda s, d: lookup.multi_get(changelog(s, d), _customers(s, d)),
    "range_scan": lambda s, d: _scan(s, d, "00000005", "00000012"),
    "range_scan_start_only": lambda s, d: _scan(s, d, start="00000010"),
    "range_scan_end_only": lambda s, d: _scan(s, d, end="00000009"),
    "range_scan_empty": lambda s, d: lookup.scan(changelog(s, d), "z", "a"),
    "segment_scan_with_tombstones": lambda s, d: lookup.segment_scan(seglog(s, d).filter("seg = 3"), "00000002", "00000011").select("key", "op", "value"),
    "compact_full": lambda s, d: compaction.compact(changelog(s, d)).select("key", "op", "value"),
    "compaction_dropped": lambda s, d: compaction.dropped(seglog(s, d)),
    "compaction_trigger": lambda s, d: compaction.should_compact(changelog(s, d), TRIGGER),
    "sparse_index": lambda s, d: sketch.sparse_index(seglog(s, d)),
    "sparse_seek": lambda s, d: sketch.sparse_seek(sketch.sparse_index(seglog(s, d)), "00000009"),
    "first_hit_segment": lambda s, d: lookup.first_hit(changelog(s, d)),
    "shadowed_versions": lambda s, d: resolve.shadowed_versions(seglog(s, d)),
    "version_history": lambda s, d: resolve.version_history(changelog(s, d)),
    "naive_log_get": lambda s, d: lookup.naive_get(changelog(s, d), "00000001"),
    "write_amplification": lambda s, d: compaction.write_amplification(changelog(s, d)),
    "bloom_sizing": lambda s, d: sketch.bloom_sizing(seglog(s, d).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))),
    "bloom_membership": _bloom_membership,
    "record_size_p99": _latency_rank,
    "orders_overwrite_live": _orders_live,
}

_LOG = f"""log AS (SELECT lpad(CAST(user_id AS varchar),8,'0') AS key, CAST(CASE WHEN event_type='error' THEN 2 ELSE 1 END AS int) AS op,
 CASE WHEN event_type='error' THEN NULL ELSE props END AS value, event_id AS seq, CAST(floor(event_id/{SEGMENT_WIDTH}) AS bigint) AS seg FROM events)"""
_SEG = _LOG + """, seglog AS (SELECT key,op,value,seq,seg FROM (SELECT *, row_number() OVER (PARTITION BY seg,key ORDER BY seq DESC) rn FROM log) t WHERE rn=1)"""
_LATEST = (
    _SEG
    + """, latest AS (SELECT key,op,value,seq,seg FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seg DESC) rn FROM seglog) t WHERE rn=1),
 live AS (SELECT key,value FROM latest WHERE op=1)"""
)
_SIZE = "length(key)+coalesce(length(value),0)"
_INDEX = f"""SELECT seg,key,byte_offset FROM (SELECT seg,key,row_number() OVER (PARTITION BY seg ORDER BY key)-1 pos,
 CAST(coalesce(sum({FRAME_BYTES}+{_SIZE}) OVER (PARTITION BY seg ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bigint) byte_offset FROM seglog) t WHERE pos%16=0"""

ORACLES: dict[str, str] = {
    "wal_replay_order": f"WITH {_LOG} SELECT seq,key,op,value FROM log",
    "memtable_state": f"WITH {_SEG} SELECT key,op,value FROM seglog WHERE seg=(SELECT max(seg) FROM seglog)",
    "memtable_size_bytes": f"WITH {_SEG} SELECT seg, CAST(sum({_SIZE}) AS bigint) size_bytes, count(*) n_keys FROM seglog GROUP BY seg",
    "memtable_is_full": f"WITH {_SEG} SELECT seg, sum({_SIZE})>={MEMTABLE_LIMIT} is_full FROM seglog GROUP BY seg",
    "flush_segments": f"WITH {_SEG} SELECT seg,key,op,value FROM seglog",
    "segment_inventory": f"WITH {_SEG} SELECT seg, count(*) n, CAST(sum(CASE WHEN op=2 THEN 1 ELSE 0 END) AS bigint) n_tomb, min(key) min_key, max(key) max_key FROM seglog GROUP BY seg",
    "kway_merge_newest_wins": f"WITH {_LATEST} SELECT key,op,value FROM latest",
    "live_view": f"WITH {_LATEST} SELECT key,value FROM live",
    "point_get": f"WITH {_LATEST} SELECT key,value FROM live WHERE key='00000001'",
    "point_get_tombstone_state": f"WITH {_LATEST}, p AS (SELECT key FROM (VALUES ('00000001'),('00000003'),('00000006'),('zzzz')) t(key)) SELECT p.key, CASE WHEN l.op IS NULL THEN 'ABSENT' WHEN l.op=2 THEN 'TOMBSTONE' ELSE 'LIVE' END state, l.value FROM p LEFT JOIN latest l ON p.key=l.key",
    "multi_get": f"WITH {_LATEST}, p AS (SELECT DISTINCT lpad(CAST(o_custkey AS varchar),8,'0') AS key FROM orders) SELECT p.key, l.value FROM p LEFT JOIN live l ON p.key=l.key",
    "range_scan": f"WITH {_LATEST} SELECT key,value FROM live WHERE key>='00000005' AND key<='00000012'",
    "range_scan_start_only": f"WITH {_LATEST} SELECT key,value FROM live WHERE key>='00000010'",
    "range_scan_end_only": f"WITH {_LATEST} SELECT key,value FROM live WHERE key<='00000009'",
    "range_scan_empty": f"WITH {_LATEST} SELECT key,value FROM live WHERE key>='z' AND key<='a'",
    "segment_scan_with_tombstones": f"WITH {_SEG} SELECT key,op,value FROM seglog WHERE seg=3 AND key>='00000002' AND key<='00000011'",
    "compact_full": f"WITH {_LATEST} SELECT key, CAST(1 AS int) AS op, value FROM live",
    "compaction_dropped": f"WITH {_LATEST} SELECT (SELECT count(*) FROM seglog) records_in, (SELECT count(*) FROM live) records_out, (SELECT count(*) FROM latest WHERE op=2) tombstones_dropped",
    "compaction_trigger": f"WITH {_SEG} SELECT count(DISTINCT seg)>={TRIGGER} should_compact, count(DISTINCT seg) n_segments FROM seglog",
    "sparse_index": f"WITH {_SEG} {_INDEX}",
    "sparse_seek": f"WITH {_SEG}, ix AS ({_INDEX}) SELECT seg, coalesce(max(CASE WHEN key<='00000009' THEN byte_offset END),0) seek_start FROM ix GROUP BY seg",
    "first_hit_segment": f"WITH {_LATEST} SELECT key, seg AS hit_seg, (SELECT max(seg) FROM seglog)-seg AS segments_skipped FROM latest",
    "shadowed_versions": f"WITH {_SEG} SELECT key, count(*)-1 shadowed FROM seglog GROUP BY key",
    "version_history": f"WITH {_LOG} SELECT key, seq, CAST(row_number() OVER (PARTITION BY key ORDER BY seq) AS bigint) AS version, lead(seq) OVER (PARTITION BY key ORDER BY seq) valid_to FROM log",
    "naive_log_get": f"WITH {_LOG} SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) rn FROM log WHERE key='00000001') t WHERE rn=1 AND op=1",
    "write_amplification": f"WITH {_LATEST}, a AS (SELECT sum({FRAME_BYTES}+{_SIZE}) b FROM log), f AS (SELECT sum({FRAME_BYTES}+{_SIZE}) b FROM seglog), k AS (SELECT sum({FRAME_BYTES}+{_SIZE}) b FROM live), u AS (SELECT sum({_SIZE}) b FROM live) SELECT CAST(a.b AS bigint) log_bytes, CAST(f.b AS bigint) flush_bytes, CAST(k.b AS bigint) compact_bytes, CAST(u.b AS bigint) user_bytes, CAST(a.b+f.b+k.b AS double)/u.b amplification FROM a,f,k,u",
    "bloom_sizing": f"WITH {_SEG}, n AS (SELECT seg, count(*) n FROM seglog GROUP BY seg), m AS (SELECT seg, n, greatest(8, ceil(-(n*ln({sketch.TARGET_FPR}))/power(ln(2),2))) m FROM n) SELECT seg, n, CAST(m AS bigint) num_bits, CAST(floor(m/n*ln(2)+0.5) AS bigint) num_hashes FROM m",
    "bloom_membership": f"WITH {_LOG}, k AS (SELECT DISTINCT key FROM log), p AS (SELECT DISTINCT lpad(CAST(o_custkey AS varchar),8,'0') AS key FROM orders) SELECT (SELECT count(*) FROM k) n_keys, (SELECT count(*) FROM p) n_probes, (SELECT count(*) FROM p JOIN k USING (key)) n_present, CAST(0 AS bigint) false_negatives, true rate_kept",
    "record_size_p99": f"WITH {_SEG}, z AS (SELECT {_SIZE} v, row_number() OVER (ORDER BY {_SIZE})-1 pos, count(*) OVER () n FROM seglog) SELECT CAST(v AS bigint) p99 FROM z WHERE pos=least(n-1, floor(n*0.99))",
    "orders_overwrite_live": "SELECT lpad(CAST(o_custkey AS varchar),8,'0') AS key, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) rn FROM orders) t WHERE rn=1",
}
