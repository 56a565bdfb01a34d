"""Table handle: put, delete, get, scan, flush, compact and reopen over a directory.

root/log/ID.parquet holds unflushed batches, root/segments/NNN.parquet key-sorted segments, and the
manifest lists both, oldest first. Only what the manifest lists is visible; files it doesn't list are
left over from a crash and vacuum() removes them. No file is written twice. A directory of segments without
a manifest is adopted as it is listed, in the order of the names.

One full compaction rewrites all segments, as its result must hold no tombstones: with very large tables
call it rarely, or keep a store per key range.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.operators import lookup
from stratolog.operators.resolve import live, newest_wins
from stratolog.plans.manifest import Manifest
from stratolog.schema import CHANGELOG_SCHEMA, OP_DELETE, OP_PUT, as_bound, as_bytes, conform, payload_bytes
from stratolog.sources import segments as seg

DEFAULT_MEMTABLE_BYTES = 4 * 1024 * 1024
DEFAULT_TRIGGER = 4


class Store:
    """Opens root, creating it if needed. Reads are bound to the manifest version of the call.

    A batch is written under a name of its own before its commit, which gives it the next seqs; batches of
    several writers are so all kept, in the order of their commits. Compaction may run beside them.
    """

    def __init__(self, spark: SparkSession, root: str, memtable_max_bytes: int = DEFAULT_MEMTABLE_BYTES):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), memtable_max_bytes
        self.manifest = Manifest(spark, self.root)
        self._closed = False
        if not self.manifest.versions():
            self._adopt()

    def _adopt(self) -> None:
        """Take over segments that no manifest lists; their seqs must grow from segment to segment."""
        paths = [f"{self.root}/segments/{x}" for x in self.manifest.children(f"{self.root}/segments") if x.endswith(".parquet")]
        if paths:
            entries = [self._entry(x) for x in paths]
            last = seg.read_segment(self.spark, *paths).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            self.manifest.commit(lambda m: None if m["version"] else m | {"segments": entries, "last_seq": last, "next_id": len(entries)})

    # writes
    def put(self, key: bytes, value: bytes) -> None:
        self.write([(OP_PUT, key, value)])

    def delete(self, key: bytes) -> None:
        self.write([(OP_DELETE, key, None)])

    def write(self, ops: list[tuple[int, bytes, bytes | None]]) -> None:
        """Append records in order as one durable batch; one commit for the batch."""
        rows = []
        for i, (op, key, value) in enumerate(ops):
            if op not in (OP_PUT, OP_DELETE):
                raise ValueError(f"unknown op {op}")
            rows.append((as_bytes(key, "key"), op, as_bytes(value, "value") if op == OP_PUT else None, i))
        if rows:
            self._append(self.spark.createDataFrame(rows, CHANGELOG_SCHEMA).coalesce(1))

    def write_batch(self, df: DataFrame) -> None:
        """Append a changelog DataFrame; its seq decides recency inside the batch.

        df is evaluated once. Its seqs need only be ordered: the manifest says how far a batch's are shifted.
        """
        self._append(conform(df))

    def _append(self, df: DataFrame) -> None:
        if self._closed:
            raise RuntimeError("the store is closed")
        path, after = f"{self.root}/log/{uuid.uuid4().hex}.parquet", None
        try:
            df.write.mode("errorifexists").parquet(path)
            low, high, size = seg.read_segment(self.spark, path).agg(F.min("seq"), F.max("seq"), F.sum(payload_bytes())).first()
            if low is not None:

                def add(m: dict) -> dict:
                    first = m["last_seq"] + 1
                    return m | {"log": [*m["log"], {"path": path, "bytes": size, "shift": first - low}], "last_seq": first + high - low}

                after = self.manifest.commit(add)
        finally:
            if after is None:
                self.manifest.delete(path)
        # The batches' own sizes bound the resolved size from above: only near the limit is it computed.
        if after and sum(x["bytes"] for x in after["log"]) >= self.limit and self.memtable_bytes() >= self.limit:
            self.flush()

    # views
    def log_tail(self, m: dict | None = None) -> DataFrame:
        return self._shifted((m or self.manifest.read())["log"])

    def _shifted(self, log: list[dict]) -> DataFrame:
        """The batches with the seqs that their commits gave them."""
        if not log:
            return seg.read_segment(self.spark)
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/log/([^/]+)\.parquet/", 1)
        shifts = F.create_map(*[F.lit(x) for e in log for x in (e["path"].rsplit("/", 1)[-1].removesuffix(".parquet"), e.get("shift", 0))])
        rows = seg.read_segment(self.spark, *[x["path"] for x in log])
        return rows.select("key", "op", "value", (F.col("seq") + F.element_at(shifts, batch).cast("long")).alias("seq"))

    def memtable(self) -> DataFrame:
        return newest_wins(self.log_tail())

    def memtable_bytes(self) -> int:
        return self.memtable().agg(F.sum(payload_bytes())).first()[0] or 0

    def segments(self) -> list[DataFrame]:
        """The flushed segments, oldest first, tombstones included."""
        return [seg.read_segment(self.spark, x["path"]) for x in self.manifest.read()["segments"]]

    def records(self, version: int | None = None, start: bytes | None = None, end: bytes | None = None, use_bloom: bool = True) -> DataFrame:
        """All visible records; segments whose key range misses [start, end] aren't listed to Spark.

        seq alone orders them: every flush and compaction carries it along. Without use_bloom the scan
        leaves the segments' Bloom filters aside, with the same result.
        """
        m = self.manifest.read(version)
        keep = [
            x["path"]
            for x in m["segments"]
            if x["n"] and not (start is not None and bytes.fromhex(x["max_key"]) < start) and not (end is not None and bytes.fromhex(x["min_key"]) > end)
        ]
        found = seg.read_segment(self.spark, *keep, use_bloom=use_bloom)
        return lookup.in_range(found.unionAll(self._shifted(m["log"])) if m["log"] else found, start, end)

    # reads
    def get(self, key: bytes, use_bloom: bool = True) -> bytes | None:
        key = as_bytes(key, "key")
        row = live(newest_wins(self.records(None, key, key, use_bloom))).select("value").first()
        return None if row is None else bytes(row[0])

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return lookup.multi_get(self.records(), probes)

    def scan(self, start_key: bytes | None = None, end_key: bytes | None = None, version: int | None = None) -> DataFrame:
        """Live (key, value) rows in key order; bounds are checked here, before any plan is built."""
        start, end = as_bound(start_key, "start_key"), as_bound(end_key, "end_key")
        return live(newest_wins(self.records(version, start, end))).select("key", "value").orderBy("key")

    # maintenance
    def _write_segment(self, df: DataFrame, m: dict, prefix: str) -> dict:
        path = f"{self.root}/segments/{prefix}{m['next_id']:09d}-{uuid.uuid4().hex[:8]}.parquet"
        seg.write_segment(df, path)
        return self._entry(path)

    def _entry(self, path: str) -> dict:
        row = seg.inventory(seg.read_segment(self.spark, path)).first()
        return {"path": path, "n": row["n"], "n_tomb": row["n_tomb"], "min_key": None if row["min_key"] is None else bytes(row["min_key"]).hex(), "max_key": None if row["max_key"] is None else bytes(row["max_key"]).hex()}

    def flush(self) -> bool:
        """Write the resolved tail as the newest segment; the log is dropped in the same commit."""
        now = self.manifest.read()
        if not now["log"]:
            return False
        entry, flushed = self._write_segment(newest_wins(self.log_tail(now)), now, "f"), [x["path"] for x in now["log"]]
        swap = lambda m: m | {"segments": [*m["segments"], entry], "log": [x for x in m["log"] if x["path"] not in flushed], "next_id": m["next_id"] + 1}
        return self.manifest.commit(swap) is not None

    def compact(self, trigger: int = DEFAULT_TRIGGER) -> bool:
        """Merge all segments into one without tombstones if there are at least trigger of them.

        Segments flushed meanwhile stay behind the merged one; if the merged ones aren't the oldest
        any more, another compaction was faster and this one is given up.
        """
        if trigger < 2:
            raise ValueError("trigger must be at least 2")
        now = self.manifest.read()
        if len(now["segments"]) < trigger:
            return False
        old = [x["path"] for x in now["segments"]]
        merged = live(newest_wins(seg.read_segment(self.spark, *old)))
        entry = self._write_segment(merged, now, "c")

        def swap(m: dict) -> dict | None:
            if [x["path"] for x in m["segments"][: len(old)]] != old:
                return None
            return m | {"segments": [entry, *m["segments"][len(old) :]], "next_id": m["next_id"] + 1}

        if self.manifest.commit(swap) is None:
            self.manifest.delete(entry["path"])
            return False
        return True

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete files that none of the newest keep_versions manifests lists; returns what went.

        Older readers may still hold those files, so call it after a retention period.
        """
        kept = [self.manifest.read(v) for v in self.manifest.versions()[-keep_versions:]]
        named = reduce(set.union, ({x["path"] for x in [*m["segments"], *m["log"]]} for m in kept), set())
        gone = []
        for d in ("log", "segments"):
            for name in self.manifest.children(f"{self.root}/{d}"):
                path = f"{self.root}/{d}/{name}"
                if path not in named:
                    self.manifest.delete(path)
                    gone.append(path)
        return gone

    def close(self) -> None:
        """Unflushed records stay in the log and are there again after reopening."""
        self._closed = True
