"""Z2 on a stream: the same rows as the batch however the log is cut, across restarts; late requests; expiry."""

import datetime as dt
import random

from copyhound.session import scratch_path
from copyhound.streaming import ttl as Z2
from copyhound.streaming import ttl_stream as Z2S

T0 = dt.datetime(2024, 1, 1)


def land(spark, home, rows):
    made = [(i, k, None if s is None else T0 + dt.timedelta(seconds=s)) for i, k, s in rows]
    spark.createDataFrame(made, Z2S.REQUESTS).coalesce(1).write.mode("append").parquet(f"{home}/landed")


def run(spark, home, **more):
    out = Z2S.run_available(spark.readStream.schema(Z2S.REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{home}/landed"), home, **more)
    return sorted(map(tuple, out.select("event_id", "key", "status").collect()))


def test_equals_the_batch_across_restarts(spark):
    rng = random.Random(5)
    log = sorted(((i, rng.choice("aaab"), rng.randrange(40_000)) for i in range(300)), key=lambda r: (r[2], r[0]))
    log += [(900, "a", 40_000), (901, "a", 40_000), (902, "b", 43_600)]
    want = Z2.ttl_status(spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s)) for i, k, s in log], Z2S.REQUESTS))
    want = sorted(map(tuple, want.select("event_id", "key", "status").collect()))
    home = scratch_path(spark, "ttl-restart")
    land(spark, home, log[:70])
    land(spark, home, log[70:150])
    assert run(spark, home) == [r for r in want if r[0] in {i for i, _, _ in log[:150]}]
    land(spark, home, log[150:])
    assert run(spark, home) == want


def test_late_requests_and_nulls(spark):
    home = scratch_path(spark, "ttl-late")
    land(spark, home, [(1, "k", 5_000), (2, None, 5_000), (3, "k", None)])
    assert run(spark, home) == [(1, "k", "miss")]
    land(spark, home, [(4, "k", 4_000), (5, "k", 8_599), (6, "k", 8_600), (7, "j", 20_000)])  # 4: before the last miss
    assert run(spark, home) == [(1, "k", "miss"), (4, "k", "hit"), (5, "k", "hit"), (6, "k", "miss"), (7, "j", "miss")]
    land(spark, home, [(8, "k", 9_000), (9, "k", 20_001), (10, "j", 23_599)])  # 8: older than the watermark, 16,400
    assert run(spark, home)[5:] == [(9, "k", "miss"), (10, "j", "hit")]
