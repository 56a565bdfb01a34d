import duckdb
import pytest

import __spark_entry__
from stratolog import catalog
from stratolog.functions import sketch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple((v is None, round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert norm(map(tuple, df.select(*columns).collect())) == norm(want)


def test_bloom_membership_by_key(spark):
    keys, probes = spark.range(0, 4000, 2).selectExpr("CAST(id AS string) AS key"), spark.range(4000).selectExpr("CAST(id AS string) AS key")
    bits, hashes = sketch.bloom_size(2000)
    bloom = sketch.bloom_build(keys, bits, hashes)
    assert bloom.count() <= -(-bits // 64)
    got = {int(r.key): r.might_contain for r in sketch.bloom_might_contain(probes, bloom, bits, hashes).collect()}
    assert all(got[k] for k in range(0, 4000, 2)) and sum(got[k] for k in range(1, 4000, 2)) < 60
    assert not any(r.might_contain for r in sketch.bloom_might_contain(probes, sketch.bloom_build(keys.limit(0), bits, hashes), bits, hashes).collect())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["point_get", "range_scan", "range_scan_start_only", "range_scan_end_only"])
def test_key_bounds_reach_the_scan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThan(user_id,99999999))," in pushed, pushed
    assert "PushedFilters: []" in catalog.QUERIES["naive_log_get"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_ids_beyond_eight_digits_keep_their_keys(spark, tmp_path):
    ids = [1, 12, 99_999_999, 123_456_789, 1_234_567_890]
    rows = [(k, u, "view", "p%d" % u) for k, u in enumerate(ids)]
    spark.createDataFrame(rows, catalog.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    for lo, hi in (("00000001", "00000012"), ("12345678", "12345678"), (None, "2"), ("1", None)):
        want = {r.key for r in catalog.live(spark, str(tmp_path)).collect() if (lo is None or r.key >= lo) and (hi is None or r.key <= hi)}
        assert {r.key for r in catalog._scan(spark, str(tmp_path), lo, hi).collect()} == want
