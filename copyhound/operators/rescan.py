"""R7 + S8 around the code check: a store of results, keyed by what they depend on, that a later scan reads first.

A file's results depend on its path (its own corpus entry is left out), its normalized content and the version of the corpus.
A scan looks its files up in the store, checks those that aren't there, and appends their results under its own number; a file
without any match is stored as well, with an empty list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyhound.functions import text as T

RESULT = "file_key string, version string, matches array<struct<url:string,similarity:double,match_rank:int>>"


def file_key(path="path", code="code", language="language"):
    """N8's form over the path and N6's fingerprint."""
    return T.lookup_key(F.concat_ws("_", F.col(path), T.fingerprint(T.normalize(code, language))), F.col(language))


def rescan(files: DataFrame, store: str, version: str, check: Callable[[DataFrame], DataFrame], scan: str) -> DataFrame:
    """(path, url, similarity, match_rank, from_store) of all matches of files (path, language, code, ...), of which only those
    without a stored result are checked. The store is the folder ``store``; ``scan`` names what this scan adds to it, so a scan that
    is run again after a failure replaces its own rows."""
    spark = files.sparkSession
    keyed = files.withColumn("file_key", file_key())
    spark.createDataFrame([], RESULT).write.mode("overwrite").parquet(f"{store}/scan=none")
    have = spark.read.schema(RESULT).parquet(f"{store}/scan=*").where(F.col("version") == version)
    before = have.select("file_key").distinct().join(keyed.select("file_key").distinct(), "file_key", "left_semi")
    path = f"{store}-known-{scan}"
    before.write.mode("overwrite").parquet(path)  # what was there before this scan adds its own
    before = spark.read.schema(before.schema).parquet(path)
    missing = keyed.join(before, "file_key", "left_anti")
    found = check(missing.drop("file_key")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("match_rank", "url", "similarity"))).alias("m"))
    rows = missing.select("path", "file_key").distinct().join(found, "path", "left").select(
        "file_key", F.lit(version).alias("version"),
        F.transform(F.coalesce("m", F.array().cast("array<struct<match_rank:int,url:string,similarity:double>>")),
                    lambda x: F.struct(x["url"].alias("url"), x["similarity"].alias("similarity"), x["match_rank"].cast("int").alias("match_rank"))).alias("matches"))
    rows.write.mode("overwrite").parquet(f"{store}/scan={scan}")
    all_ = spark.read.schema(RESULT).parquet(f"{store}/scan=*").where(F.col("version") == version).dropDuplicates(["file_key"])
    out = keyed.select("path", "file_key").join(all_, "file_key").join(before.withColumn("from_store", F.lit(True)), "file_key", "left")
    return out.select("path", F.explode("matches").alias("x"), F.coalesce("from_store", F.lit(False)).alias("from_store")).select(
        "path", "x.url", "x.similarity", "x.match_rank", "from_store")
