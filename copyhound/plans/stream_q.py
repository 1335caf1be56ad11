"""Registered streaming / state queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.plans import passages as PS
from copyhound.plans.catalog import register
from copyhound.session import scratch_path
from copyhound.sources.tables import read_request_log
from copyhound.streaming import check_stream as Z3
from copyhound.streaming import quota as Z1
from copyhound.streaming import ttl as Z2
from copyhound.streaming import ttl_stream as Z2S

# The log never reaches the real quotas (C.QUOTAS: 200 a day, 50 an hour, 10 a minute), so the queries pass low ones.
LOW_QUOTAS = [("1 day", 5), ("1 hour", 1)]
register("z1_quota_violations", Z1.quota_sql(LOW_QUOTAS))(lambda s, d: Z1.quota_violations(read_request_log(s, d), LOW_QUOTAS))
register("z1_quota_stream", Z1.quota_sql(LOW_QUOTAS))(lambda s, d: Z1.quota_violations_stream(s, d, LOW_QUOTAS, "400 days"))
register("z1_default_quotas", Z1.quota_sql())(lambda s, d: Z1.quota_violations(read_request_log(s, d)))
register("z2_ttl_hits", Z2.TTL_SQL)(Z2.batch)
register("z2_ttl_stream", Z2.TTL_SQL)(lambda s, d: Z2S.ttl_stream(s, d))


register("z3_check_stream", PS.copied_sql())(lambda s, d: Z3.check_stream(s, d))


@register("s5_read_request_log", "SELECT event_id, user_id AS client, event_type AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def q_s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_request_log(spark, sf_dir)
    return r.select("event_id", "client", "key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("n8_lookup_key", "SELECT event_id, md5(event_type || '_' || CAST(user_id AS VARCHAR)) AS cache_key FROM events")
def q_n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_request_log(spark, sf_dir)
    return e.select("event_id", T.lookup_key(F.col("key"), F.col("client").cast("string")).alias("cache_key"))


# --- S8 / R7: a store of results and its reuse ---------------------------------
def stored_results(log: DataFrame) -> DataFrame:
    """What requests with an even event_id left: (cache_key, written_at, result)."""
    return log.where("event_id % 2 = 0").select(
        T.lookup_key(F.col("key"), F.col("client").cast("string")).alias("cache_key"), F.col("ts").alias("written_at"), F.col("event_id").alias("result"))


def kept_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results written as a table in the shared folder, read back."""
    path = scratch_path(spark, f"store/results_{uuid.uuid4().hex[:8]}")
    stored_results(read_request_log(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


STORE_SQL = """(SELECT md5(event_type || '_' || CAST(user_id AS VARCHAR)) AS cache_key, ts AS written_at, event_id AS result
FROM events WHERE event_id % 2 = 0)"""


@register("s8_write_results", f"""SELECT cache_key, strftime(written_at, '%Y-%m-%d %H:%M:%S.%f') AS written_at, result FROM {STORE_SQL} s""")
def q_s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_store(spark, sf_dir).select("cache_key", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("written_at"), "result")


STORE_TTL = 480 * C.CACHE_TTL_SECONDS  # the log is thin: with the default hour hardly a request is served


@register("r7_reuse_recent", f"""
WITH r AS (SELECT event_id, md5(event_type || '_' || CAST(user_id AS VARCHAR)) AS cache_key, ts FROM events WHERE event_id % 2 = 1),
s AS (SELECT cache_key, written_at, min(result) AS result FROM {STORE_SQL} x GROUP BY ALL)
SELECT r.event_id, r.cache_key, coalesce(r.ts - s.written_at < INTERVAL {STORE_TTL} SECOND, false) AS from_store,
       CASE WHEN r.ts - s.written_at < INTERVAL {STORE_TTL} SECOND THEN s.result ELSE r.event_id END AS result
FROM r ASOF LEFT JOIN s ON r.cache_key = s.cache_key AND r.ts >= s.written_at""")
def q_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an odd event_id: the newest stored result under their key that is younger than the limit, else
    scored anew (the result is then their own)."""
    log = read_request_log(spark, sf_dir).where("event_id % 2 = 1")
    requests = log.select("event_id", T.lookup_key(F.col("key"), F.col("client").cast("string")).alias("cache_key"), "ts")
    found = Z2.newest_stored(requests, kept_store(spark, sf_dir), STORE_TTL)
    return found.select("event_id", "cache_key", F.col("stored").isNotNull().alias("from_store"), F.coalesce("stored", "event_id").alias("result"))
