"""R1 / M4 as a stored table: postings bucketed and sorted by (term, language), kept up to date by changes.

A lookup joins its terms with the buckets as they lie, so the postings are never moved. Changes of the corpus (new, changed and
deleted files) are added as delta tables of the same buckets, each under a version; a posting counts as long as no later
version has touched its file. `compacted` writes what counts as one table again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.operators.lookup import build_term_index
from copyhound.operators.similarity import checked_broadcast
from copyhound.session import scratch_path

BUCKETS = 64


def stored_buckets(postings: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """The postings as a table in the shared folder, one file for each bucket of (term, language)."""
    spark = postings.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    spread = postings.repartition(buckets, "term", "language")
    spread.write.bucketBy(buckets, "term", "language").sortBy("term", "language").option("path", scratch_path(spark, f"index/{table}")).saveAsTable(table)
    return spark.table(table)


@dataclass
class StoredIndex:
    """postings: one table for each version; touched: (corpus_id, version) of the files that a version replaced or removed."""

    spark: SparkSession
    version: int = 0
    buckets: int = BUCKETS
    postings: list[DataFrame] = field(default_factory=list)
    touched: list[DataFrame] = field(default_factory=list)

    def change(self, files: DataFrame, gone: DataFrame | None = None) -> None:
        """One batch of changes: new or changed corpus files (corpus_id, language, content, indexed_at), and the ids of deleted
        ones. Equal batches give equal postings, so a batch that is run again after a failure replaces nothing else."""
        v = self.version + 1
        rows = build_term_index(files).withColumn("version", F.lit(v))
        self.postings.append(stored_buckets(rows, f"terms_v{v}", self.buckets))
        if self.postings[:-1]:
            ids = files.select("corpus_id")
            ids = ids if gone is None else ids.unionByName(gone.select("corpus_id"))
            path = scratch_path(self.spark, f"index/touched_v{v}_{uuid.uuid4().hex[:8]}")
            ids.distinct().withColumn("touched", F.lit(v)).write.parquet(path)
            self.touched.append(self.spark.read.parquet(path))
        self.version = v

    def live(self) -> DataFrame:
        """(term, language, corpus_id, indexed_at): the postings that count, in the buckets' order where nothing has changed."""
        rows = self.postings[0]
        for more in self.postings[1:]:
            rows = rows.unionByName(more)
        if self.touched:
            last = self.touched[0]
            for more in self.touched[1:]:
                last = last.unionByName(more)
            last = last.groupBy("corpus_id").agg(F.max("touched").alias("touched"))
            rows = rows.join(checked_broadcast(last), "corpus_id", "left").where(F.col("touched").isNull() | (F.col("touched") <= F.col("version")))
        return rows.select("term", "language", "corpus_id", "indexed_at")

    def compacted(self) -> StoredIndex:
        """The same index as one table."""
        out = StoredIndex(self.spark, self.version, self.buckets)
        out.postings = [stored_buckets(self.live().withColumn("version", F.lit(self.version)), f"terms_v{self.version}", self.buckets)]
        return out
