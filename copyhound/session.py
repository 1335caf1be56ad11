"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SPREAD_CONF = "spark.copyhound.spread.partitions"


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "copyhound",
              driver_memory: str = "16g", checkpoint_dir: str | None = None) -> SparkSession:
    """Local session for tests, tools and the bench, which pass a fresh ``checkpoint_dir``.
    On a cluster the session comes from the launcher, which names the shared folder."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the local tables are single files: deal their rows to all threads
        .config(SPREAD_CONF, str(2 * shuffle_partitions))
    )
    if checkpoint_dir:
        spark = spark.config("spark.checkpoint.dir", checkpoint_dir)
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share, as the session names
    it in ``spark.checkpoint.dir``.

    Where it is unset, a one-process local session gets a fresh folder; on a cluster that
    is an error, since a folder on the driver's own disk can't be seen by the executors."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="copyhound-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder (survives executor loss)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


#: Shuffle files go when the statement that wrote them ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Gives back the shuffle files of each statement in it as the statement ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def kept(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, lost executors cost no earlier step, and
    the shuffle files behind the table are given back."""
    path = scratch_path(df.sparkSession, f"{name}_{uuid.uuid4().hex[:8]}")
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join with another table that grows with the input: sort-merged, never broadcast.

    A side's size is guessed from its files. Compressed files, and rows that are printed or exploded from them, can be a hundred
    times larger than the guess, and a broadcast of them passes through the driver."""
    return df.hint("merge")


def env_sf_dir(default: str = "/root/testdata/sf0.01") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
