"""Readers for the given parquet tables and the derived input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.session import SPREAD_CONF


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, always: bool = False) -> DataFrame:
    """Hash-partition on ``key`` when the session asks for it (``spark.copyhound.spread.partitions``).

    Off by default: a cluster's tables are many splittable files. The local session of the
    tests turns it on, because there a table is one file and its text work would run in one task.
    ``always``: over all cores in any session, for short rows that are much work (a megabyte of ``part`` rows is read by
    one task and prints a hundred megabytes of code)."""
    spark = df.sparkSession
    n = int(spark.conf.get(SPREAD_CONF, "0"))
    if always and n <= 0:
        n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key) if n > 0 else df


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: known-source corpus as (item_id, text) — `benchmark` passages."""
    return read_table(spark, sf_dir, "benchmark").select("item_id", "text")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages."""
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def read_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log from `events`: client = user_id, key = event_type, ts as TIMESTAMP."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("client"),
        F.col("event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
