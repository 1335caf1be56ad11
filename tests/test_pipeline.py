"""Pipeline fixtures: TTL anchors (Z2/R7), quotas (Z1), flagship vs DuckDB."""

import datetime as dt

import duckdb

from conftest import SF001
from copyhound.operators.similarity import gram_similarity
from copyhound.streaming import quota as Z1
from copyhound.streaming import ttl as Z2


def test_gram_similarity_bounds(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e x y")], "id long, norm string")
    ref = spark.createDataFrame([(10, "a b c d e f g")], "rid long, norm string")
    rows = {r.id: r for r in gram_similarity(docs, ref, "id", "rid", k=3).collect()}
    assert rows[1].similarity == 1.0
    assert 0 < rows[2].similarity < 1 and rows[2].shared == 3


def test_ttl_anchor_is_last_miss(spark):
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 3599, 3600, 7199, 7300]
    rows = [(i, "k", t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    req = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    got = {r.event_id: r.status for r in Z2.ttl_status(req).collect()}
    # 7300 s is 3700 s after the last miss (3600 s), so it misses again
    assert [got[i] for i in range(5)] == ["miss", "hit", "miss", "hit", "miss"]


def test_quota_windows(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    burst = [("c1", t0 + dt.timedelta(seconds=i)) for i in range(11)]            # 11 in one minute
    edge = [("c2", dt.datetime(2024, 1, 1, 0, 5, 55) + dt.timedelta(seconds=i)) for i in range(10)]  # 10 across an edge
    log = spark.createDataFrame(burst + edge, "client string, ts timestamp")
    v = Z1.quota_violations(log, [("1 minute", 10)]).collect()
    assert [(r.client, r.n) for r in v] == [("c1", 11)]


def test_flagship_matches_duckdb(spark):
    import __spark_entry__ as E
    got = sorted((r.doc_id, r.item_id, r.shared, round(r.similarity, 12)) for r in E.entry(spark).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = sorted((a, b, c, round(d, 12)) for a, b, c, d in con.execute(
        f"SELECT doc_id, item_id, shared, similarity FROM ({E.oracle_sql()['copied_passages']}) x").fetchall())
    assert got == want
