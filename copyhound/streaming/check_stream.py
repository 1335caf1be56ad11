"""Z3: score newly arriving documents against the static passage set.

A file stream of documents is processed with ``foreachBatch``. The passages' gram profile
is computed once and kept as a table in the shared folder; each micro-batch joins its
documents to it and writes its matches under its own number, so a batch that is run again
replaces its rows. Scoring is per document, so micro-batching can't change any row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from copyhound import config as C
from copyhound.functions import text as T
from copyhound.operators.similarity import gram_profile
from copyhound.plans.passages import copied_from
from copyhound.session import scratch_path
from copyhound.sources.tables import read_table


def check_stream(spark: SparkSession, sf_dir: str, arrivals: int = 4, cfg: C.CheckConfig = C.CheckConfig()) -> DataFrame:
    """`documents` land as files, one for each core and arrival; each trigger takes as many as there are cores, since a
    file of a few megabytes is one task."""
    home = scratch_path(spark, f"stream/check_{uuid.uuid4().hex[:8]}")
    cores = spark.sparkContext.defaultParallelism
    read_table(spark, sf_dir, "documents").select("doc_id", "text").repartition(arrivals * cores, "doc_id").write.parquet(f"{home}/landed")
    passages = read_table(spark, sf_dir, "benchmark").select("item_id", T.normalize_generic("text").alias("norm"))
    gram_profile(passages, "item_id", "norm", cfg.gram_k, "word", "c2", "right_grams").write.parquet(f"{home}/profile")
    profile = spark.read.parquet(f"{home}/profile")

    def score(batch: DataFrame, epoch: int) -> None:
        copied_from(batch, profile, cfg).write.mode("overwrite").parquet(f"{home}/matches/epoch={epoch}")

    schema = spark.read.parquet(f"{home}/landed").schema
    result = copied_from(spark.createDataFrame([], schema), profile, cfg).schema
    query = (spark.readStream.schema(schema).option("maxFilesPerTrigger", cores).parquet(f"{home}/landed")
             .writeStream.foreachBatch(score).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(result).parquet(f"{home}/matches/*")
