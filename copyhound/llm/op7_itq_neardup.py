"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with original vectors.

A rotation that balances binary codes is learned on a bounded sample (`SAMPLE` vectors, those with the least hash);
every vector is coded and indexed. A code of up to 64 bits is cut into m substrings, one table for each, with m such
that a substring has about log2(vectors) bits. A pair within Hamming distance `RADIUS` agrees in some substring up to
RADIUS // m bits, so probing every substring's neighbours within that finds it for certain, and most pairs a little
beyond. What a probe finds is reranked: cosine of the original vectors in double precision, links at 0.9 and above.

A table's buckets are dealt out by the first bits of the substring, a probe goes to the few parts whose first bits
are near enough, and a part over `PART` vectors is split on both sides (every split of probes meets every split of
members). Within a part the buckets are ranges of a sorted array. A pair is counted only by the first table that finds
it. From a part come sums of links and a spanning forest of its links, so a large group of near copies never becomes
rows for all its pairs. Equal vectors are one point with a number of copies.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm.components import components
from copyhound.llm.shared import stored
from copyhound.sources.tables import read_table

COSINE = 0.9
SAMPLE = 16384
ROUNDS = 40
RADIUS = 11
#: Codes farther apart aren't reranked. At cosine 0.9 a code of 64 bits differs in 8 or 9 bits on average, 16 at most of
#: 8,000 pairs; 24 lies more than five deviations out.
FARTHEST = 24
PART = 8192
_CHUNK = 1 << 18


def _vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, sig, vec): vec holds the doubles of a vector that can link, else sig and vec are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sig, vec = [], []
            for v in batch.column(1):
                x = np.array([], float)
                if v.is_valid and v.values is not None and v.values.null_count == 0:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # -0 becomes 0
                ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool((x != 0).any())
                raw = x.astype("<f8").tobytes() if ok else None
                vec.append(raw)
                sig.append(xxhash.xxh3_128_digest(raw) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sig, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "sig", "vec"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, sig binary, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors, shorter ones padded with zeros."""
    out = np.zeros((len(raw), width))
    for k, r in enumerate(raw):
        v = np.frombuffer(r, "<f8")
        out[k, :len(v)] = v[:width]
    return _unit(out) if len(out) else out


class Rotation:
    """code(x): bit k says on which side of the k-th learned direction x lies, seen from the origin as the cosine is. So the
    distance of two codes follows the angle, also where all vectors share a direction (codes from their mean lose pairs then)."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = ROUNDS, seed: int = 7):
        self.bits = min(bits, sample.shape[1])
        _, _, axes = np.linalg.svd(sample.T @ sample)
        axes = axes[:self.bits].T
        v = sample @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):  # codes for the rotation, then the rotation for the codes
            b = np.where(v @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            turn = right.T @ left.T
        self.axes = axes @ turn

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = (x @ self.axes >= 0).astype(np.uint64)
        return (bits << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Tables:
    """The cut of a code into substrings: (shift, bits) of each, and the first bits that deal out a table."""

    def __init__(self, bits: int, points: int, radius: int = RADIUS, part: int = PART):
        want = min(bits, max(8, round(math.log2(max(2, points)))))
        m = math.ceil(bits / want)
        edges = [round(k * bits / m) for k in range(m + 1)]
        self.cuts = [(a, b - a) for a, b in zip(edges, edges[1:])]
        self.near = radius // m
        self.dealt = min(min(n for _, n in self.cuts), max(0, math.ceil(math.log2(max(1, points) / part))))

    def sub(self, code: np.ndarray, t: int) -> np.ndarray:
        shift, n = self.cuts[t]
        return ((code >> np.uint64(shift)) & np.uint64((1 << n) - 1)).astype(np.int64)

    def flips(self, n: int, most: int) -> list[tuple[int, int]]:
        """(mask, bits set) of all masks over n bits with up to `most` set."""
        return [(sum(1 << k for k in at), size) for size in range(min(most, n) + 1) for at in itertools.combinations(range(n), size)]


def _dealt(points: DataFrame, rotation: Rotation, tables: Tables, width: int) -> DataFrame:
    """(t, part, kind, left, point, copies, code, vec): kind 0 a member, kind 1 a probe with `left` bits to flip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                code = rotation.code(_matrix(own.column("vec").to_pylist(), width))
                for t, (_, n) in enumerate(tables.cuts):
                    first = tables.sub(code, t) >> (n - tables.dealt)
                    for kind, masks in ((0, [(0, 0)]), (1, tables.flips(tables.dealt, tables.near))):
                        for mask, size in masks:
                            same = lambda x, k: pa.array(np.full(len(code), x, k))
                            yield pa.RecordBatch.from_arrays(
                                [same(t, np.int32), pa.array(first ^ mask), same(kind, np.int32), same(tables.near - size, np.int32), own.column("point"),
                                 own.column("copies"), pa.array(code.view(np.int64)), own.column("vec")],
                                names=["t", "part", "kind", "left", "point", "copies", "code", "vec"])

    return points.select("point", "copies", "vec").mapInArrow(run, "t int, part long, kind int, left int, point long, copies long, code long, vec binary")


def _join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A union of the classes of a and b in a forest whose entries all point to their roots."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _part_links(tables: Tables, width: int, cosine: float):
    """The links of one part: rows (point, links, other)."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: np.array(table.column(c)) for c in ("t", "part", "kind", "left", "point", "copies", "code")}
        raw = table.column("vec").to_pylist()
        t, first = int(col["t"][0]), int(col["part"][0])
        _, n = tables.cuts[t]
        low = n - tables.dealt
        code = col["code"].astype(np.int64).view(np.uint64)
        points, index = np.unique(col["point"], return_inverse=True)
        where = np.unique(index, return_index=True)[1]
        unit, size = _matrix([raw[k] for k in where], width), np.array([len(raw[k]) for k in where])
        copies, code = col["copies"][where], code[where]
        sub = tables.sub(code, t) & ((1 << low) - 1)
        members = index[col["kind"] == 0]
        members = members[np.argsort(sub[members], kind="stable")]
        probes, left = index[col["kind"] == 1], col["left"][col["kind"] == 1]
        keys = sub[members]
        links, parent = np.zeros(len(points), np.int64), np.arange(len(points))
        masks = [(np.uint64(((1 << k) - 1) << s)) for s, k in tables.cuts[:t]]
        for mask, bits in tables.flips(low, tables.near):
            own = probes[left >= bits]
            want = sub[own] ^ mask
            begin = np.searchsorted(keys, want, "left")
            count = np.searchsorted(keys, want, "right") - begin
            own, begin, count = own[count > 0], begin[count > 0], count[count > 0]
            stop = np.cumsum(count)
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + _CHUNK, "right")))
                reach = count[at:to]
                a = np.repeat(own[at:to], reach)
                b = members[np.arange(int(reach.sum())) + np.repeat(begin[at:to] - (np.cumsum(reach) - reach), reach)]
                keep = points[a] < points[b]  # the other order is found by the other point's probe
                a, b = a[keep], b[keep]
                differ = code[a] ^ code[b]
                keep = (np.bitwise_count(differ) <= FARTHEST) & (size[a] == size[b])
                for earlier in masks:
                    keep &= np.bitwise_count(differ & earlier) > tables.near
                a, b = a[keep], b[keep]
                for k in range(0, len(a), _CHUNK):
                    x, y = a[k:k + _CHUNK], b[k:k + _CHUNK]
                    hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    x, y = x[hit], y[hit]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    parent = _join_roots(parent, x, y)
                at = to
        out = np.flatnonzero(links)
        other = points[parent[out]]
        return pa.table({"point": pa.array(points[out]), "links": pa.array(links[out]), "other": pa.array(other)})

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of embeddings (vec_id, embedding; other columns are left out): vec_id, n_links,
    component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept; so do
    vectors of different lengths with each other. Repeated vec_ids are rows of their own; component_id is null only if
    all vec_ids of a component are, and kept counts a null vec_id as equal to a null component_id."""
    rows = stored(_vectors(embeddings), "vectors")
    points = rows.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    points = stored(points.withColumn("point", F.monotonically_increasing_id()), "points")
    total, width = points.agg(F.count("*"), F.max(F.length("vec"))).first()
    plain = rows.select("vec_id", "sig")
    if total:
        width //= 8
        learn = points.orderBy(F.xxhash64("sig"), "sig").limit(sample).select("vec").toArrow().column(0).to_pylist()
        rotation = Rotation(_matrix(learn, width))
        tables = Tables(rotation.bits, total, radius)
        dealt = _dealt(points, rotation, tables, width)
        splits = dealt.where("kind = 0").groupBy("t", "part").agg(F.ceil(F.count("*") / (2 * PART)).cast("int").alias("splits"))
        dealt = dealt.join(splits, ["t", "part"]).withColumn("own", F.pmod(F.xxhash64("point"), F.col("splits")).cast("int"))
        dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        dealt = dealt.withColumn("a", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("met")))
        dealt = dealt.withColumn("b", F.when(F.col("kind") == 0, F.col("met")).otherwise(F.col("own"))).drop("own", "met", "splits")
        found = stored(dealt.groupBy("t", "part", "a", "b").applyInArrow(_part_links(tables, width, cosine), "point long, links long, other long"), "links")
        sums = found.groupBy("point").agg(F.sum("links").alias("links"))
        labels = components(found.select(F.col("point").alias("a"), F.col("other").alias("b")))
        named = points.select("point", "sig", "first_id", "copies").join(sums, "point", "left").join(labels.withColumnRenamed("v", "point"), "point", "left")
        named = named.withColumn("label", F.coalesce("label", "point"))
        smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        of = named.join(smallest, "label").select("sig", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        linked = plain.where("sig is not null").join(of, "sig").select("vec_id", "n_links", "component_id")
    else:
        linked = plain.where("false").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(plain.where("sig is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
