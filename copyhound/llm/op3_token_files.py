"""Token-id files: a concatenated id array whose document boundaries are Elias-Fano encoded.

A file is a table of shards. A shard holds the ids of consecutive documents as a little-endian array (2 bytes an id
where the vocabulary allows it, else 4) and the end positions of its documents as an Elias-Fano sequence: the low
bits of each position packed side by side, the high bits as unary gaps in a bit array, and samples of every 64th set
bit. `select` finds the end of any document from the samples and one short scan; no 64-bit table of offsets exists.
The file's table of contents has a row for each shard (its place in the order and its number of ids), so readers add
up shards, not documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents, scratch
from copyhound.llm.tokens import encoder, vocabulary_path

END_ID = 2
SAMPLE = 64
SHARD_BYTES = 4 << 20
_SHARD = "part int, shard int, n_docs int, n_ids long, id_bytes int, low_bits int, ids binary, low binary, high binary, samples binary, doc_ids binary, null_ids binary"


class EliasFano:
    """A non-decreasing sequence of n integers below `top` in about n * (2 + log2(top / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits)) & 1 if bits else np.zeros((n, 0), np.int64)
        at = (values >> bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").tobytes()
        return cls(n, bits, pack(low.ravel()), pack(high), at[::SAMPLE].astype("<u4").tobytes())

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), np.int64)
        packed = np.frombuffer(self.low, np.uint8)
        bit = k[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((packed[bit >> 3] >> (bit & 7) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, k: int) -> int:
        """The k-th value: from the sampled set bit before it, over whole bytes by their counts, then within one."""
        high = np.frombuffer(self.high, np.uint8)
        at = int(np.frombuffer(self.samples, "<u4")[k // SAMPLE])
        need = k % SAMPLE
        byte = at >> 3
        word = int(high[byte]) & (0xFF << (at & 7)) & 0xFF
        while word.bit_count() <= need:
            need -= word.bit_count()
            byte += 1
            word = int(high[byte])
        for _ in range(need):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - k << self.low_bits) + int(self._low(np.array([k]))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        k = np.arange(self.n)
        return (np.flatnonzero(bits)[:self.n] - k << self.low_bits) + self._low(k)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, as_loaded: bool = False) -> None:
    """Writes the ids of all documents in ascending doc_id order (null first; equal ones by the text's hash).

    Whole texts are range-partitioned by doc_id, so files hold consecutive documents and part numbers follow the
    order. Null text counts as empty: the end id alone. Rows with equal doc_ids each get an entry. as_loaded: added
    tokens of the vocabulary keep their ids where a text holds one."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary, as_loaded)
        width = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        part, number, held, bytes_held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, bytes_held
            size = np.concatenate([x[1] for x in held])
            ends = np.cumsum(size)
            ef = EliasFano.of(ends)
            key = pa.concat_arrays([x[2] for x in held])
            row = [part, number, len(size), int(ends[-1]), int(width[2]), ef.low_bits, b"".join(x[0] for x in held), ef.low, ef.high,
                   ef.samples, np.array(key.fill_null(0), "<i8").tobytes(), np.packbits(np.array(key.is_null())).tobytes() if key.null_count else b""]
            number, held, bytes_held = number + 1, [], 0
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1)):
                ids, bounds = enc.encode(data, off)
                size = np.diff(bounds) + 1
                out = np.full(int(size.sum()), end_id, width)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(size) - 1] = False
                out[keep] = ids
                held.append((out.tobytes(), size, batch.column(0).slice(i, j - i).cast(pa.int64())))
                bytes_held += out.nbytes
                if bytes_held >= shard_bytes:
                    yield flush()
        if held:
            yield flush()

    ordered.mapInArrow(shards, _SHARD).write.option("compression", "zstd").parquet(path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """The table of contents: one row for each shard with the number of ids before it, `base`.

    Only one total for each part (a write task) meets in one place; shards are added up within their part."""
    toc = spark.read.parquet(path).select("part", "shard", "n_docs", "n_ids")
    totals = toc.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = totals.selectExpr("part", "coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0) as part_base")
    within = toc.selectExpr("part", "shard", "coalesce(sum(n_ids) over (partition by part order by shard rows between unbounded preceding and 1 preceding), 0) as before")
    return within.join(base, "part").select("part", "shard", (F.col("part_base") + F.col("before")).alias("base"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 (and its ids as array<int>)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["n_docs"], r["low_bits"], r["low"], r["high"], r["samples"]).values()
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                raw = memoryview(ids.tobytes())
                begin = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[:r["n_docs"]].astype(bool) if r["null_ids"] else None
                key = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null)
                n = len(ends)
                columns = [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["shard"], np.int32)), key, pa.array(begin), pa.array(ends - begin), pa.array(crc, pa.int64())]
                names = ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = spark.read.parquet(path).mapInArrow(read, out)
    return rows.join(contents(spark, path), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, vocabulary_path(), as_loaded=True)
    return read_token_files(spark, path)
