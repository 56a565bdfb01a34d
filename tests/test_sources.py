from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratolog.functions.sketch import bloom_size, nearest_rank
from stratolog.operators.resolve import merge_segments
from stratolog.schema import CHANGELOG_SCHEMA, OP_DELETE, OP_PUT
from stratolog.sources import framed_log, segments


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([OP_PUT, OP_DELETE]), st.binary(max_size=8), st.binary(max_size=8))), st.integers(0, 40))
def test_frames_stop_at_the_last_whole_record(ops, torn):
    ops = [(o, k, v if o == OP_PUT else b"") for o, k, v in ops]
    data = b"".join(framed_log.frame(*x) for x in ops)
    cut = data[: max(0, len(data) - torn)]
    got = [(o, k, v) for o, k, v, _ in framed_log.frames(cut)]
    assert got == ops[: len(got)]
    good = framed_log.good_length(cut)
    again = cut[:good] + framed_log.frame(OP_PUT, b"after", b"1")
    assert [x[1] for x in framed_log.frames(again)][-1] == b"after"


def test_framed_log_source(spark, tmp_path):
    data = framed_log.frame(OP_PUT, b"a", b"1") + framed_log.frame(OP_DELETE, b"a") + bytes([9, 0, 0, 0, 1, 0, 0, 0, 0, 65])
    (tmp_path / "wal.log").write_bytes(data)
    got = framed_log.read_framed_log(spark, str(tmp_path / "wal.log")).orderBy("pos").collect()
    assert [(r.op, bytes(r.key), r.value and bytes(r.value)) for r in got] == [(1, b"a", b"1"), (2, b"a", None)]


def test_framed_log_appends_behind_a_torn_tail(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    log = framed_log.FramedLog(path)
    log.put(b"good", b"1")
    log.delete(b"gone")
    log.close()
    with open(path, "ab") as f:
        f.write(framed_log.frame(OP_PUT, b"torn-key", b"torn")[:14])
    log = framed_log.FramedLog(path)  # opened again, and once more after an append
    log.append((OP_PUT, b"after", b"2"), (OP_PUT, b"", b""))
    log.close()
    framed_log.FramedLog(path).close()
    got = framed_log.as_changelog(framed_log.read_framed_log(spark, path)).orderBy("seq").collect()
    assert [(bytes(r.key), r.op, r.value and bytes(r.value)) for r in got] == [(b"good", 1, b"1"), (b"gone", 2, None), (b"after", 1, b"2"), (b"", 1, b"")]
    log = framed_log.FramedLog(path)
    log.reset()
    log.put(b"new", b"3")
    log.close()
    assert framed_log.read_framed_log(spark, path).count() == 1


def rows_scanned(df):
    """Rows that the scans of a collected query passed on."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    leaves = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan]
    while leaves:
        x = leaves.pop()
        kids = [x.children().apply(i) for i in range(x.children().size())]
        if x.getClass().getSimpleName().endswith("QueryStageExec"):
            kids.append(x.plan())
        if x.getClass().getSimpleName() == "FileSourceScanExec":
            out += x.metrics().apply("numOutputRows").value()
        leaves += kids
    return out


def test_bloom_filter_skips_absent_keys_only(spark, tmp_path):
    rows = [(b"k%05d" % (2 * i), OP_PUT, b"v%d" % i, i) for i in range(3000)]
    segments.write_segment(spark.createDataFrame(rows, CHANGELOG_SCHEMA), str(tmp_path / "s"), 1)
    for use, most in ((True, 0), (False, 3000)):
        read = segments.read_segment(spark, str(tmp_path / "s"), use_bloom=use)
        absent, present = read.filter(F.col("key") == b"k01001"), read.filter(F.col("key") == b"k01000")
        n = rows_scanned(absent)
        assert n == 0 if use else 0 < n <= most
        assert [bytes(r.value) for r in present.collect()] == [b"v500"]


def test_segment_round_trip_and_point_read(spark, tmp_path):
    rows = [(b"k%04d" % i, OP_PUT, b"v%d" % i, i) for i in range(500)]
    segments.write_segment(spark.createDataFrame(rows, CHANGELOG_SCHEMA), str(tmp_path / "s"), 2)
    back = segments.read_segment(spark, str(tmp_path / "s"))
    assert back.count() == 500
    hit = back.filter(back.key == b"k0123")
    assert "EqualTo(key" in hit._jdf.queryExecution().executedPlan().toString()
    assert [bytes(r.value) for r in hit.collect()] == [b"v123"]
    assert segments.read_segment(spark).count() == 0


def test_merge_is_by_position_then_seq(spark):
    df = lambda *r: spark.createDataFrame(list(r), CHANGELOG_SCHEMA)
    old, new = df((b"a", 1, b"new?", 9), (b"b", 1, b"1", 8)), df((b"a", 1, b"x", 1), (b"a", 1, b"y", 2), (b"b", 2, None, 3))
    got = {bytes(r.key): (r.op, r.value and bytes(r.value)) for r in merge_segments([old, df(), new]).collect()}
    assert got == {b"a": (1, b"y"), b"b": (2, None)}


def test_bloom_size_and_rank(spark):
    assert bloom_size(1) == (10, 7) and bloom_size(74) == (710, 7) and bloom_size(0) == (10, 7)
    v = spark.range(300).selectExpr("id * 7 % 300 AS x")
    assert nearest_rank(v, "x", 0.99).first().value == 297
    for values in ([5], [0, 0, 0], [-7, -1, 0, 2, 2, 10**12], list(range(1, 98)) * 3):
        for p in (0.0, 0.5, 0.99, 1.0):
            df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x long")
            assert nearest_rank(df, "x", p).first().value == sorted(values)[min(len(values) - 1, int(len(values) * p))]
    assert nearest_rank(v.limit(0), "x", 0.5).count() == 0
