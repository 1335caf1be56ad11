"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, and pieces of equal
length form a bucket, so that no sequence crosses documents and none needs padding.

A document of L tokens gives L // 1024 pieces of 1024 tokens and then one piece for each bit of L % 1024, longest
first. Each piece is a sequence of its own; the sequences of a bucket have consecutive numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents, stored
from copyhound.llm.tokens import encoder, vocabulary_path

SEQUENCE = 1024
END_ID = 0
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, bucket_row long"


def binary_lengths(n: int, most: int = SEQUENCE) -> np.ndarray:
    """`n` as a sum of powers of two up to `most` (itself a power of two), longest first."""
    rest = n % most
    tail = [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]
    return np.concatenate([np.full(n // most, most, np.int64), np.array(tail, np.int64)])


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False, as_loaded: bool = False) -> DataFrame:
    """One row for each piece of each document: (doc_id, start, length, ids_crc32, doc_tokens, part, bucket_row).

    part: the partition that cut the document; bucket_row: the piece's number among that partition's pieces of its
    length. with_ids adds the ids as array<int>. as_loaded: added tokens of the vocabulary keep their ids where a text
    holds one. Null text counts as empty: one piece that holds the end id alone.
    Null doc_ids and repeated rows are documents like any other."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, as_loaded)
        seen = np.zeros(most.bit_length(), np.int64)
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1)):
                ids, bounds = enc.encode(data, off)
                size = np.diff(bounds) + 1
                out = np.zeros(int(size.sum()), np.uint32)
                ends = np.cumsum(size)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                out[~keep] = end_id
                lengths = [binary_lengths(n, most) for n in size.tolist()]
                count = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.concatenate(lengths)
                stop = np.cumsum(length)
                begin = stop - length
                row = np.repeat(np.arange(j - i), count)
                raw = out.astype("<u4", copy=False).tobytes()
                crc = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), stop.tolist())), np.int64, len(length))
                log = np.round(np.log2(length)).astype(np.int64)
                order = np.argsort(log, kind="stable")
                per = np.bincount(log, minlength=len(seen))
                rank = np.zeros(len(length), np.int64)
                rank[order] = B.ranges(seen, per)
                seen += per
                columns = [
                    batch.column(0).slice(i, j - i).cast(pa.int64()).take(pa.array(row)),
                    pa.array(begin - np.repeat(ends - size, count)), pa.array(length.astype(np.int32)),
                    pa.array(crc), pa.array(np.repeat(size, count)), pa.array(rank),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket_row"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(out.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    got = docs.select("doc_id", "text").mapInArrow(cut, _PIECES + ", ids array<int>" * with_ids)
    return got.withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False, as_loaded: bool = False) -> DataFrame:
    """Packs documents (doc_id, text; other columns are left out) into sequences of at most `most` tokens.

    Returns for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0: a piece is a
    sequence). Numbers run on from bucket to bucket, longest first; within one, by partition and place there. Only
    counts by partition and bucket meet in one place. An empty table gives no rows."""
    pieces = stored(cut_documents(docs, vocabulary or vocabulary_path(), end_id, most, with_ids, as_loaded), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("length").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["length", "part"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("bucket_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), as_loaded=True)
