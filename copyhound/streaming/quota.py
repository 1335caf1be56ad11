"""Request quotas per client over fixed windows, batch and Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound import config as C
from copyhound.session import scratch_path
from copyhound.sources.tables import read_request_log


def window_counts(log: DataFrame, window: str) -> DataFrame:
    """Requests per (client, fixed window); map-side partial counts."""
    return (log.groupBy("client", F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def violations(counts: DataFrame, window: str, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit).select(
        "client", F.lit(window).alias("quota"),
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "n", F.lit(limit).cast("long").alias("quota_limit"), (F.col("n") - limit).alias("over"))


def quota_violations(log: DataFrame, quotas=C.QUOTAS) -> DataFrame:
    """Windows over their limit, one row each."""
    out = None
    for win, lim in quotas:
        v = violations(window_counts(log, win), win, lim)
        out = v if out is None else out.unionByName(v)
    return out


def count_stream(log: DataFrame, window: str, name: str, watermark: str) -> DataFrame:
    """The window counts of a streaming log, as a table in the shared folder.

    Each micro-batch writes the counts it changed under its own number, so a batch that is
    run again replaces its rows. Counts only grow, so a window's count is its largest. The
    watermark lets old windows leave the state; rows that come later than it are dropped."""
    path = scratch_path(log.sparkSession, f"stream/{name}/counts")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (window_counts(log.withWatermark("ts", watermark), window).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", scratch_path(log.sparkSession, f"stream/{name}/state")).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = "client long, w struct<start:timestamp,end:timestamp>, n long, epoch long"
    counts = log.sparkSession.read.schema(schema).parquet(path)
    return counts.groupBy("client", "w").agg(F.max("n").alias("n"))


def quota_violations_stream(spark: SparkSession, sf_dir: str, quotas=C.QUOTAS, watermark: str = "2 days") -> DataFrame:
    """The same violations from a file stream over `events`, several micro-batches."""
    landed = scratch_path(spark, f"stream/events_{uuid.uuid4().hex[:8]}")
    read_request_log(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(landed)
    schema = spark.read.parquet(landed).schema
    out = None
    for win, lim in quotas:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landed).select("client", "ts")
        # file order isn't time order, so the watermark has to span the log
        v = violations(count_stream(stream, win, f"quota_{uuid.uuid4().hex[:8]}", watermark), win, lim)
        out = v if out is None else out.unionByName(v)
    return out


def quota_sql(quotas=C.QUOTAS) -> str:
    parts = []
    for win, lim in quotas:
        unit = win.split()[1]
        parts.append(f"""SELECT user_id AS client, '{win}' AS quota, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       CAST(count(*) AS BIGINT) AS n, CAST({lim} AS BIGINT) AS quota_limit, CAST(count(*) - {lim} AS BIGINT) AS over
FROM events GROUP BY user_id, date_trunc('{unit}', ts) HAVING count(*) > {lim}""")
    return " UNION ALL ".join(parts)
