import os
import random
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from stratolog import OP_DELETE, OP_PUT, Store
from stratolog.plans.manifest import Manifest
from stratolog.schema import CHANGELOG_SCHEMA
from stratolog.streaming.ingest import BackgroundCompactor, upsert_stream


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_get_tells_empty_deleted_and_absent_apart(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write([(OP_PUT, b"a", b"1"), (OP_PUT, b"b", b""), (OP_PUT, b"c", b"x"), (OP_DELETE, b"c", None), (OP_PUT, b"a", b"2")])
    assert s.get(b"a") == b"2" and s.get(b"b") == b"" and s.get(b"c") is None and s.get(b"d") is None
    with pytest.raises(TypeError):
        s.put("a", b"1")
    with pytest.raises(TypeError):
        s.scan("a")
    s.put(bytearray(b"e"), b"5")
    assert s.get(b"e") == b"5"


def test_scan_is_inclusive_and_in_unsigned_order(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    keys = [b"", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff"]
    s.write([(OP_PUT, k, b"v") for k in reversed(keys)])
    assert [k for k, _ in pairs(s.scan())] == keys
    assert [k for k, _ in pairs(s.scan(b"a", b"\x80"))] == keys[1:5]
    assert pairs(s.scan(b"z", b"a")) == []


def test_random_log_equals_a_dict_over_flush_compact_and_reopen(spark, tmp_path):
    rnd, model, s = random.Random(7), {}, Store(spark, str(tmp_path), memtable_max_bytes=600)
    for step in range(8):
        ops = []
        for _ in range(30):
            k = b"key%03d" % rnd.randrange(40)
            if rnd.random() < 0.75:
                v = b"v%d" % rnd.randrange(10**6)
                ops.append((OP_PUT, k, v))
                model[k] = v
            else:
                ops.append((OP_DELETE, k, None))
                model.pop(k, None)
        s.write(ops)
        if step % 3 == 2:
            s.compact(2)
        if step % 4 == 3:
            s.close()
            s = Store(spark, str(tmp_path), memtable_max_bytes=600)
    assert pairs(s.scan()) == sorted(model.items())
    old = s.scan()
    before = sorted(model.items())
    for k in (b"y", b"z"):
        s.put(k, b"1")
        model[k] = b"1"
        s.flush()
    assert s.compact(2)
    assert pairs(s.scan()) == sorted(model.items()) and pairs(old) == before
    assert len(s.segments()) == 1 and all(r.op == OP_PUT for r in s.segments()[0].collect())
    assert s.vacuum() and pairs(s.scan()) == sorted(model.items())


def test_all_deleted_compacts_to_an_empty_segment(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put(b"a", b"1")
    s.flush()
    s.delete(b"a")
    s.flush()
    assert not s.compact(3)
    assert s.compact(2) and pairs(s.scan()) == [] and s.segments()[0].count() == 0
    with pytest.raises(ValueError):
        s.compact(1)


def test_corrupt_manifest_is_an_error(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    m.commit(lambda x: x | {"last_seq": 5})
    assert m.read()["version"] == 1
    assert m.commit(lambda x: None) is None
    (tmp_path / "manifest-v000000000001.json").write_text('{"segm')
    for f in tmp_path.glob(".*.crc"):
        f.unlink()
    with pytest.raises(RuntimeError):
        m.read()


def test_stream_upserts_and_background_compaction(spark, tmp_path):
    rows = [(b"k%d" % (i % 5), OP_PUT if i % 7 else OP_DELETE, b"v%d" % i if i % 7 else None, i) for i in range(40)]
    spark.createDataFrame(rows, CHANGELOG_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "store"))
    q = upsert_stream(spark.readStream.schema(CHANGELOG_SCHEMA).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp"))
    q.awaitTermination(60)
    model = {}
    for k, op, v, _ in rows:
        model.pop(k, None)
        if op == OP_PUT:
            model[k] = v
    assert pairs(s.scan()) == sorted(model.items())
    s.flush()
    s.put(b"new", b"1")
    s.flush()
    c = BackgroundCompactor(s, trigger=2, poll_interval=0.05)
    c.start()
    c.start()
    for _ in range(200):
        if len(s.segments()) == 1:
            break
        c._stop.wait(0.05)
    c.stop(30)
    assert len(s.segments()) == 1 and s.get(b"new") == b"1"


def test_writers_with_a_stale_view_lose_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.put(b"k", b"1")
    b.put(b"z", b"2")
    a.put(b"k", b"3")
    b.put(b"k", b"4")
    for s in (a, b, Store(spark, str(tmp_path))):
        assert pairs(s.scan()) == [(b"k", b"4"), (b"z", b"2")]
    errors, threads = [], []
    for w in range(4):

        def work(w=w):
            try:
                Store(spark, str(tmp_path)).write([(OP_PUT, b"w%d-%d" % (w, i), b"x") for i in range(5)])
            except Exception as e:  # noqa: BLE001
                errors.append(e)

        threads.append(threading.Thread(target=work))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and a.scan(b"w", b"x").count() == 20
    seqs = [r.seq for r in a.log_tail().collect()]
    assert len(seqs) == len(set(seqs)) == 24


def test_refused_batches_leave_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    s.put(b"a", b"1")
    monkeypatch.setattr(s.manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        s.put(b"a", b"2")
    assert len(os.listdir(tmp_path / "log")) == 1 and s.get(b"a") == b"1"


def test_a_batch_is_evaluated_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.range(50).selectExpr("CAST(id % 5 AS STRING) AS k", "id").select(F.col("k").cast("binary").alias("key"), F.lit(OP_PUT).alias("op"), F.col("k").cast("binary").alias("value"), (F.col("id") - 20).alias("seq"))
    s = Store(spark, str(tmp_path))
    s.write_batch(df.coalesce(1).mapInArrow(seen, CHANGELOG_SCHEMA))
    assert calls.value == 50 and s.scan().count() == 5 and s.manifest.read()["last_seq"] == 50
    s.write_batch(df.limit(0))
    assert len(os.listdir(tmp_path / "log")) == 1


def test_killed_writer_loses_no_acknowledged_record(spark, tmp_path):
    """A process is killed between a batch's file and its commit."""
    code = f"""
import os, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from stratolog import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s = Store(spark, {str(tmp_path)!r})
for i in range(3):
    s.put(b"key%d" % i, b"value%d" % i)
s.manifest.commit = lambda *_: os._exit(1)
s.put(b"torn-key", b"torn")
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 1
    s = Store(spark, str(tmp_path))
    assert pairs(s.scan()) == [(b"key%d" % i, b"value%d" % i) for i in range(3)]
    assert s.get(b"torn-key") is None
    s.put(b"later", b"1")
    s.flush()
    assert s.vacuum() and s.get(b"later") == b"1" and s.scan().count() == 4


def test_writes_beside_compaction_equal_a_dict(spark, tmp_path):
    rnd, model = random.Random(42), {}
    s = Store(spark, str(tmp_path), memtable_max_bytes=400)
    c = BackgroundCompactor(Store(spark, str(tmp_path)), trigger=3, poll_interval=0.05)
    c.start()
    try:
        for _ in range(14):
            ops = []
            for _ in range(25):
                k = b"key%04d" % rnd.randrange(60)
                put = rnd.random() < 0.8
                v = b"v%d" % rnd.randrange(10**6) if put else None
                ops.append((OP_PUT if put else OP_DELETE, k, v))
                model[k] = v
            s.write(ops)
    finally:
        c.stop(60)
    live = sorted((k, v) for k, v in model.items() if v is not None)
    assert pairs(s.scan()) == live and pairs(Store(spark, str(tmp_path)).scan()) == live
    s.flush()
    s.put(b"x", b"1")
    s.flush()
    assert s.compact(2) and len(s.segments()) == 1


def test_losing_compaction_is_given_up(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for k in (b"a", b"b"):
        s.put(k, b"1")
        s.flush()
    late, write = Store(spark, str(tmp_path)), Store._write_segment

    def slow(self, *args):
        entry = write(self, *args)
        assert s.compact(2)  # another one is faster
        return entry

    late._write_segment = slow.__get__(late)
    assert not late.compact(2)
    assert len(s.segments()) == 1 and len(os.listdir(tmp_path / "segments")) == 3 and s.scan().count() == 2


def test_segments_without_a_manifest_are_adopted(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for v in (b"1", b"2"):
        s.write([(OP_PUT, b"k", v), (OP_PUT, b"k" + v, v)])
        s.flush()
    for f in tmp_path.glob("*manifest*"):
        f.unlink()
    s = Store(spark, str(tmp_path))
    assert pairs(s.scan()) == [(b"k", b"2"), (b"k1", b"1"), (b"k2", b"2")]
    s.put(b"k", b"3")
    assert s.get(b"k") == b"3" and s.get(b"k", use_bloom=False) == b"3" and s.get(b"no", use_bloom=False) is None
