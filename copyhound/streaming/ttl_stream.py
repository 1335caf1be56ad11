"""Z2 as a stream: keyed state with the last miss of each key, and a timer that lets it go.

A request is decided in the micro-batch that brings it: the requests of a key are taken by (ts, event_id), one is a hit when
less than ``ttl`` seconds passed since the key's last miss, else it is a miss and becomes the last one. A request from before
the last miss finds that miss's entry, so it is a hit. Requests older than the watermark (the newest ``ts`` of earlier
micro-batches less ``delay``) are dropped. Requests without a key or a time are left out.

The state of a key is one number. Its timer fires once the watermark has passed ttl after the miss: whatever isn't too late
then would miss anyway, so expiry changes no row. Equal to ``ttl_status`` when micro-batches arrive in order of time, however
they are cut. A micro-batch's requests of one key meet in one task, as two numbers each; bound it with maxFilesPerTrigger or
maxBytesPerTrigger of the source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from copyhound import config as C
from copyhound.session import scratch_path
from copyhound.sources.tables import read_request_log

REQUESTS = "event_id long, key string, ts timestamp"
STATUS = "event_id long, key string, status string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def misses(at: np.ndarray, last: int | None, ttl: int) -> np.ndarray:
    """Which of the sorted times are misses, after a last miss at ``last``: a step for each miss, not for each request."""
    out = np.zeros(len(at), bool)
    place = 0 if last is None else int(np.searchsorted(at, last + ttl))
    while place < len(at):
        out[place] = True
        place = int(np.searchsorted(at, at[place] + ttl))
    return out


class LastMiss(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_miss", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ids = (np.concatenate(x) for x in zip(*((r["at"].to_numpy(), r["event_id"].to_numpy()) for r in rows)))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        missed = misses(at, self.last.get()[0] if self.last.exists() else None, self.ttl)
        if missed.any():
            last = int(at[missed][-1])
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        yield pd.DataFrame({"event_id": ids, "key": key[0], "status": np.where(missed, "miss", "hit")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"event_id": np.zeros(0, np.int64), "key": np.zeros(0, object), "status": np.zeros(0, object)})

    def close(self) -> None:
        pass


def run_available(requests: DataFrame, home: str, ttl: int = C.CACHE_TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Decides what a stream of requests (event_id, key, ts) holds now, and returns all statuses so far. `home` keeps the
    state and the statuses; a further run with the same `home` goes on where the last one ended. A micro-batch writes under
    its own number, so one that is run again replaces its rows."""
    spark: SparkSession = requests.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/status/epoch={epoch}")

    rows = requests.where("key is not null and ts is not null").withWatermark("ts", delay).select("key", "event_id", "ts", F.unix_micros("ts").alias("at"))
    decided = rows.groupBy("key").transformWithStateInPandas(LastMiss(ttl), STATUS, outputMode="Update", timeMode="EventTime")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (decided.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{home}/state")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(STATUS).parquet(f"{home}/status/*")


def ttl_stream(spark: SparkSession, sf_dir: str, landings: int = 3) -> DataFrame:
    """The request log landing in order of time; after each landing the stream is started again from its checkpoint."""
    home = scratch_path(spark, f"stream/ttl_{uuid.uuid4().hex[:8]}")
    log = read_request_log(spark, sf_dir).select("event_id", "key", "ts").where("ts is not null")
    cuts = log.agg(F.percentile_approx(F.unix_micros("ts"), [k / landings for k in range(1, landings)])).first()[0] or []
    at, edges = F.unix_micros("ts"), [None, *sorted(set(cuts)), None]
    for after, until in zip(edges, edges[1:]):
        part = log if after is None else log.where(at > after)
        part = part if until is None else part.where(at <= until)
        part.write.mode("append").parquet(f"{home}/landed")
        out = run_available(spark.readStream.schema(REQUESTS).parquet(f"{home}/landed"), home)
    return out
