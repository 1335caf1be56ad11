"""Time-to-live reuse of stored results.

A request is served from the store (a *hit*) when less than ``ttl`` seconds passed
since the last *miss* of the same key (the miss that wrote the entry); otherwise it
is a miss and rewrites the entry. The misses of a key are the chain
first -> next(first) -> ..., with next(e) = the first request at or after ts(e)+ttl.

Computed without gathering a key's requests anywhere:
  * next() is an as-of lookup by minute: requests and probes of a (key, minute) in one
    ordered window, else the first request of the next non-empty minute (a window over
    one row per (key, minute), bounded by the time span, not by the number of requests);
  * the chain is marked by pointer doubling: J_{k+1} = J_k o J_k, then the start
    set is extended from the largest jump down. Every J_k is checkpointed to the
    shared checkpoint folder, so lineage stays flat and lost executors recompute
    at most one round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.session import ensure_checkpoint_dir
from copyhound.sources.tables import read_request_log


def _order(ts: str, i: str):
    return F.struct(F.col(ts).alias("t"), F.col(i).alias("i"))


def _minute(t) -> Column:
    return F.floor(F.unix_micros(t) / F.lit(60_000_000)).cast("long")


def next_after(req: DataFrame, ttl: int) -> DataFrame:
    """(key, event_id, nxt): first request of the key at or after ts + ttl (ties: least event_id)."""
    probe = F.col("ts") + F.expr(f"INTERVAL {ttl} SECONDS")
    events = req.select("key", _minute(F.col("ts")).alias("b"), F.col("ts").alias("t"), "event_id", F.lit(1).alias("is_event"))
    probes = req.select("key", _minute(probe).alias("b"), probe.alias("t"), "event_id", F.lit(0).alias("is_event"))
    rows = events.unionByName(probes)
    # backwards in time; at one time events come first, so a probe sees those of its own instant
    back = Window.partitionBy("key", "b").orderBy(F.col("t").desc(), F.col("is_event").desc(), F.col("event_id").desc())
    seen = F.last(F.when(F.col("is_event") == 1, F.col("event_id")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("nxt_in", seen).where("is_event = 0").select("key", "b", "event_id", "nxt_in")
    minutes = rows.groupBy("key", "b").agg(F.min(F.when(F.col("is_event") == 1, _order("t", "event_id"))).alias("m")).select(
        "key", "b", F.col("m.i").alias("first_id"))
    later = Window.partitionBy("key").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = minutes.select("key", "b", F.last("first_id", ignorenulls=True).over(later).alias("nxt_out"))
    return inside.join(after, ["key", "b"]).select("key", "event_id", F.coalesce("nxt_in", "nxt_out").alias("nxt"))


def ttl_status(req: DataFrame, ttl: int = C.CACHE_TTL_SECONDS) -> DataFrame:
    """(event_id, key, ts, status) with status 'miss' or 'hit'."""
    spark = req.sparkSession
    ensure_checkpoint_dir(spark)
    span = req.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    seconds = 0 if span["a"] is None else (span["z"] - span["a"]).total_seconds()
    rounds = max(1, math.ceil(math.log2(seconds / ttl + 2)))
    jumps = [next_after(req, ttl).select("event_id", "nxt").checkpoint()]
    for _ in range(rounds - 1):
        j = jumps[-1]
        j2 = (j.alias("a").join(j.alias("b"), F.col("a.nxt") == F.col("b.event_id"), "left")
              .select(F.col("a.event_id").alias("event_id"), F.col("b.nxt").alias("nxt")))
        jumps.append(j2.checkpoint())
    starts = (req.groupBy("key").agg(F.min(_order("ts", "event_id")).alias("m"))
              .select(F.col("m.i").alias("event_id")))
    marked = starts
    for j in reversed(jumps):
        step = marked.join(j, "event_id").where(F.col("nxt").isNotNull()).select(F.col("nxt").alias("event_id"))
        marked = marked.unionByName(step).distinct().checkpoint()
    return (req.join(marked.withColumn("miss", F.lit(True)), "event_id", "left")
            .select("event_id", "key", "ts",
                    F.when(F.col("miss"), F.lit("miss")).otherwise(F.lit("hit")).alias("status")))


def newest_stored(requests: DataFrame, store: DataFrame, ttl: int) -> DataFrame:
    """Requests (event_id, cache_key, ts) with ``stored``: the newest result under their key written at or before
    them and less than ``ttl`` seconds ago, else null. Of results of one instant the least counts.

    As-of join by time slices as long as ``ttl``: a result can serve its own slice and the next one, so it is put into
    both, and one ordered window over (key, slice) carries it forward."""
    micros = ttl * 1_000_000
    slice_ = lambda t: F.floor(F.unix_micros(t) / F.lit(micros)).cast("long")
    kept = store.groupBy("cache_key", F.col("written_at").alias("t")).agg(F.min("result").alias("result"))
    kept = kept.select("cache_key", F.explode(F.array(slice_(F.col("t")), slice_(F.col("t")) + 1)).alias("b"), "t",
                       F.lit(0).alias("asks"), F.lit(None).cast("long").alias("event_id"), F.struct("t", "result").alias("kept"))
    asked = requests.select("cache_key", slice_(F.col("ts")).alias("b"), F.col("ts").alias("t"), F.lit(1).alias("asks"), "event_id",
                            F.lit(None).cast(kept.schema["kept"].dataType).alias("kept"))
    past = Window.partitionBy("cache_key", "b").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = kept.unionByName(asked).withColumn("last", F.last("kept", ignorenulls=True).over(past)).where("asks = 1")
    fresh = F.unix_micros("t") - F.unix_micros("last.t") < micros
    return seen.select("event_id", "cache_key", F.col("t").alias("ts"), F.when(fresh, F.col("last.result")).alias("stored"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ttl_status(read_request_log(spark, sf_dir))
    return s.select("event_id", "key", "status")


TTL_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, event_type AS key, ts FROM events),
nx AS (SELECT event_id, nxt FROM (
  SELECT event_id, kind, first_value(CASE WHEN kind = 1 THEN event_id END IGNORE NULLS)
         OVER (PARTITION BY key ORDER BY t, kind, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM (SELECT event_id, key, ts AS t, 1 AS kind FROM e
        UNION ALL SELECT event_id, key, ts + INTERVAL {C.CACHE_TTL_SECONDS} SECOND, 0 FROM e)) WHERE kind = 0),
s AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM e) WHERE rn = 1),
chain AS (SELECT event_id FROM s UNION ALL SELECT nx.nxt FROM chain JOIN nx USING (event_id) WHERE nx.nxt IS NOT NULL)
SELECT e.event_id, e.key, CASE WHEN c.event_id IS NOT NULL THEN 'miss' ELSE 'hit' END AS status
FROM e LEFT JOIN (SELECT DISTINCT event_id FROM chain) c USING (event_id)"""
