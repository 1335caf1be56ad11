"""N-gram Jaccard join in the metric space of shingle sets, exact for every pair of texts.

The distance is 1 - Jaccard; two sets link within `radius`. Equal sets become one point first. A point with so many
shingles of its own that nothing can lie within the radius stays alone (an exact bound). What is left is joined by
regions:

- A text's shingles in one global order, rarest first, give it cells: any two points within the radius meet in a
  cell of one of their first shingles. Each cell elects its most central point as pivot, and a point belongs to the
  Voronoi region of the nearest of its cells' pivots; as a boundary point it is replicated to the regions of the
  others, since a neighbour may live there. A region row carries its distance from the pivot.
- Points within the radius of a pivot link to it and need no more comparison among themselves: they are connected.
- Then regions are joined recursively. In each round the points of a region that aren't connected with its largest
  class elect further pivots, a few at first and more in later rounds. By the triangle inequality such a pivot can
  only link with points whose distance from the region's pivot lies in a window of the radius around its own; those
  in the window and in another class are compared, unless the shingles that either has to itself already put them
  too far apart. A region is finished when its points are connected or have been
  pivots.

So a group of copies costs a star, not all its pairs, and no pair of different texts is dropped: every pair that
shares a cell is linked, or shown too far apart by the window, or connected already. Sets of more than thousands of
points never meet in one task; every step is a join or a grouping with sums taken first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.components import merged
from copyhound.llm.shared import documents, spent, stored

WORDS = 4
PERCENT = 85
FIRST_PIVOTS = 4
MORE_PIVOTS = 16
SALTS = 16
_BLOCK = 1 << 21
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    data = B.LOWER[data]
    start, end, bounds = B.words(data, off)
    w = B.span_hashes(data, start, end)
    h = w.copy()
    n = max(0, len(w) - k + 1)
    for j in range(1, k):
        h[:n] = B.mix(h[:n] * _STEP + w[j:n + j])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(h[a:b - k + 1])
        elif b > a:
            one = w[a:a + 1].copy()
            for j in range(a + 1, b):
                one = B.mix(one * _STEP + w[j:j + 1])
            yield B.mix(one + np.uint64(b - a))
        else:
            yield w[:0]


def _least(n, percent: int):
    """The least intersection that a set of n shingles needs with any partner, and the least partner's size."""
    return (n * percent + 99) // 100


def _extra(n):
    """How many shared shingles the first look asks for: with more, fewer points pass and more shingles are looked at."""
    return n // 10


def _int(c: Column) -> Column:
    return F.floor(c).cast("long")


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, key): set size, 128-bit signature of the set and its 64 low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(2)):
                n, sig, key = [], [], []
                for s in shingles(data, off, k):
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    key.append(_key(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(key, pa.int64())],
                    names=["doc_id", "text_hash", "n", "sig", "key"])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, text_hash long, n long, sig binary, key long")


def _key(s: np.ndarray) -> int:
    """A number of a set, never 0."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[8:], "little", signed=True) or 1


def _held_first(docs: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """(key, held): how many of a set's first shingles, in the order of their hashes, other sets have among theirs; never
    too few. Sets that several blocks hold may get more.

    Shingles meet in 2^bits buckets, packed: 4 bytes of the shingle's hash, 8 of the set's key. What several sets of one
    block hold is counted there and goes out once without a key, so a hot shingle sends a row a block, not one a set."""

    def packed(h: list[np.ndarray], p: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, p = B.mix(np.concatenate(h)), np.concatenate(p)
        order = np.lexsort((p, h))
        h, p = h[order], p[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        pair = new | np.concatenate([[True], p[1:] != p[:-1]])
        h, p, new = h[pair], p[pair], new[pair]
        first = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
        keys, held = np.unique(p[many], return_counts=True)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([int(h[0] & np.uint64((1 << bits) - 1))], pa.int32()), pa.array([held.astype("<u4").tobytes()]), pa.array([keys.tobytes()]), pa.array([True])],
                                             names=["bucket", "h", "p", "counted"])
        p = np.where(many, 0, p)[new | ~many]
        h = h[new | ~many]
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        low = (h >> np.uint64(32 - bits)).astype("<u4")
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[b], edges[b + 1])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([low[at].tobytes()]), pa.array([p[at].tobytes()]), pa.array([False])], names=["bucket", "h", "p", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, p, size = [], [], 0
        for batch in batches:
            for _, _, data, off in B.text_blocks(batch.column(0)):
                for s in shingles(data, off, k):
                    if len(s):
                        first = s[:len(s) - _least(len(s), percent) + max(1, _extra(len(s)))]
                        h.append(first)
                        p.append(np.full(len(first), _key(s)))
                        size += len(first)
                if size >= _BLOCK:
                    yield from packed(h, p)
                    h, p, size = [], [], 0
        if h:
            yield from packed(h, p)

    def met(rows: pa.Table) -> pa.Table:
        counted = rows.column("counted").to_numpy()
        h = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("h")]
        p = [np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("p")]
        keys, held = [p[r] for r in np.flatnonzero(counted)], [h[r].astype(np.int64) for r in np.flatnonzero(counted)]
        rest = np.flatnonzero(~counted)
        if len(rest):
            h, p = np.concatenate([h[r] for r in rest]), np.concatenate([p[r] for r in rest])
            order = np.lexsort((p, h))
            h, p = h[order], p[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            pair = new | np.concatenate([[True], p[1:] != p[:-1]])
            h, p, new = h[pair], p[pair], new[pair]
            n = np.diff(np.append(np.flatnonzero(new), len(h)))
            # without a key: more than one set of a block
            shared = np.repeat((n > 1) | (np.add.reduceat(p == 0, np.flatnonzero(new)) > 0), n) & (p != 0)
            unique, count = np.unique(p[shared], return_counts=True)
            keys.append(unique)
            held.append(count)
        return pa.table({"key": np.concatenate(keys), "held": np.concatenate(held)})

    sent = docs.select("text").mapInArrow(run, "bucket int, h binary, p binary, counted boolean")
    return sent.groupBy("bucket").applyInArrow(met, "key long, held long").groupBy("key").agg(F.sum("held").alias("held"))


def _near_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (doc_id, text_hash, text) of docs that can be wanted by their text's hash, and some others.

    The wanted hashes set bits of one bitmap of 2^23 bits at any size, so what reaches the driver is bounded."""
    place = F.col("first_hash").bitwiseAND((1 << 23) - 1)
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(first_hash & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << 17, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("text_hash").to_numpy().view(np.uint64) & np.uint64((1 << 23) - 1)
            yield batch.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, text string")


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(point, n, tokens) of the wanted points (point, first_id, first_hash), from the texts of their documents. A point
    whose document is there more than once has equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(0)):
                sets = list(shingles(data, off, k))
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["point", "n", "tokens"])

    texts = _near_texts(docs, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    return texts.select("text", "point").mapInArrow(run, "point long, n long, tokens array<long>")


def _compared(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with their distance `d` and whether they link."""
    sets = points.select("point", "n", "tokens")
    left = sets.select(F.col("point").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = sets.select(F.col("point").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    both = F.size(F.array_intersect("at", "bt")).cast("long")
    got = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("an") + F.col("bn")).alias("total"), both.alias("both"))
    return got.select("a", "b", (1 - F.col("both") / (F.col("total") - F.col("both"))).alias("d"),
                      (100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).alias("linked"))


def _region_points(sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The points that may have a neighbour: (point, n, central, held, tokens, cells); tokens: numbers of those of its
    shingles that others have too, held: how many."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, (total >> 24).bit_length())
    need = F.greatest(F.lit(1), _int(F.col("n") / 10))
    some = sets.join(_held_first(docs, k, percent, bits), "key").where(F.col("held") >= need)
    wanted = stored(some.select("point", "first_id", "first_hash"), "wanted")
    whole = stored(_whole_sets(docs, wanted, k), "sets")
    tokens = whole.select("point", F.explode("tokens").alias("h"))
    shared = stored(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").withColumn("place", F.monotonically_increasing_id()), "shared")
    numbered = _numbered(shared)
    least = _int((F.col("n") * percent + 99) / 100)
    held = tokens.join(numbered, "h").groupBy("point").agg(F.sum("df").alias("popularity"), F.sort_array(F.collect_set(F.struct("df", "id"))).alias("held"))
    sizes = whole.select("point", "n").distinct()
    held = held.join(sizes, "point").where(F.size("held") >= least)
    # Shingles that no other point has come first in the order; what they leave of the first ones are the cells.
    cells = F.slice(F.col("held.id"), F.lit(1), (F.size("held") - least + 1).cast("int"))
    points = stored(held.select("point", "n", (F.col("popularity") / F.col("n")).alias("central"), F.size("held").cast("long").alias("held"),
                                F.sort_array("held.id").alias("tokens"), cells.alias("cells")), "points")
    spent(wanted, whole, shared)
    return points


def _numbered(shared: DataFrame) -> DataFrame:
    """(h, df, id) of the stored table (h, df, place): dense numbers, 32 bits wide while these suffice."""
    part, least = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = shared.groupBy(part.alias("part")).count().toPandas().sort_values("part")
    total = int(sizes["count"].sum())
    starts = dict(zip(sizes["part"].tolist(), (sizes["count"].cumsum() - sizes["count"]).tolist()))
    start = shared.sparkSession.createDataFrame(list(starts.items()), "part int, start long")
    numbers = shared.withColumn("part", part.cast("int")).join(F.broadcast(start), "part")
    return numbers.select("h", "df", (F.col("start") + least).cast("int" if total < 1 << 31 else "long").alias("id"))


def _regions(points: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Region rows (pivot, point, d, central, n) with the pivots' own, and the links (a, b) to pivots."""
    cells = points.select("point", "central", F.explode("cells").alias("h"))
    elected = cells.groupBy("h").agg(F.max(F.struct("central", (-F.col("point")).alias("minus"))).alias("best"), F.count("*").alias("size"))
    elected = elected.where("size > 1").select("h", (-F.col("best.minus")).alias("pivot"))
    rows = cells.join(elected, "h").select("point", "pivot").distinct()
    pairs = rows.where("point <> pivot").select(F.col("point").alias("a"), F.col("pivot").alias("b"))
    far = stored(_compared(pairs, points, percent), "distances")
    regions = far.select(F.col("b").alias("pivot"), F.col("a").alias("point"), "d")
    regions = regions.union(far.select(F.col("b").alias("pivot"), F.col("b").alias("point"), F.lit(0.0).alias("d")).distinct())
    regions = stored(regions.join(points.select("point", "central", "n", "held"), "point"), "regions")
    links = stored(far.where("linked").select("a", "b"), "links")
    spent(far)
    return regions, links


def _recursive_join(points: DataFrame, regions: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Labels (v, label) of all points with a link, after all rounds."""
    radius = 1 - percent / 100 + 1e-9
    # two points share at most what either has in common with any other, which bounds their distance from below
    most_shared = F.least("held", "p_held")
    labels = merged(None, links)
    done = regions.select("pivot", "point").where("pivot = point")
    # What is told a region's rows is told to each of its SALTS parts, so a large region is many tasks' work.
    salt, salts = F.pmod(F.xxhash64("point"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    most = FIRST_PIVOTS
    while True:
        rows = regions.join(labels.select(F.col("v").alias("point"), "label"), "point", "left").withColumn("label", F.coalesce("label", "point"))
        rows = rows.join(done.withColumn("probed", F.lit(True)), ["pivot", "point"], "left").withColumn("probed", F.coalesce("probed", F.lit(False)))
        size = rows.groupBy("pivot", "label").agg(F.count("*").alias("size")).groupBy("pivot").agg(
            F.max(F.struct("size", "label")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
        size = size.select("pivot", F.col("largest.label").alias("major"), salts.alias("salt"))
        rows = stored(rows.withColumn("salt", salt).join(size, ["pivot", "salt"]), "rows")
        order = W.partitionBy("pivot").orderBy(F.col("central").desc(), "point")
        probes = rows.where("label <> major and not probed").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        probes = stored(probes.select("pivot", F.col("point").alias("p"), F.col("d").alias("pd"), F.col("n").alias("pn"), F.col("held").alias("p_held"), F.col("label").alias("p_label")), "probes")
        if probes.isEmpty():
            return labels
        near = rows.where("not probed").join(probes.withColumn("salt", salts), ["pivot", "salt"]).where(
            (F.col("label") != F.col("p_label")) & (F.abs(F.col("d") - F.col("pd")) <= radius)
            & (100 * most_shared >= percent * (F.col("n") + F.col("pn") - most_shared)))
        pairs = near.select(F.least("p", "point").alias("a"), F.greatest("p", "point").alias("b")).distinct()
        found = stored(_compared(pairs, points, percent).where("linked").select("a", "b"), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
        done = stored(done.union(probes.select("pivot", F.col("p").alias("point"))), "probed")
        spent(rows, probes)
        most *= MORE_PIVOTS


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are left out): doc_id, n_shingles, component_id,
    group (a number of the component, also where doc_ids repeat; null without words) and text_hash (xxhash64).

    Null or wordless texts have 0 shingles and link with nothing; their component is their own doc_id. Rows with
    equal doc_ids are rows of their own; a null doc_id counts for a component's smallest only if all are null."""
    rows = stored(_profiles(docs, k), "profiles")
    first_hash = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    sets = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), first_hash.alias("first_hash"), F.first("n").alias("n"), F.first("key").alias("key"))
    sets = stored(sets.withColumn("point", F.monotonically_increasing_id()), "distinct-sets")
    points = _region_points(sets, docs, k, percent)
    regions, links = _regions(points, percent)
    labels = _recursive_join(points, regions, links, percent)
    named = sets.select("point", "sig", "first_id").join(labels.withColumnRenamed("v", "point"), "point", "left")
    named = named.withColumn("label", F.coalesce("label", "point"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = named.join(smallest, "label").select("sig", "component_id", F.col("label").alias("group"))
    linked = rows.where("n > 0").join(of, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group", "text_hash")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "text_hash")
    return linked.union(alone)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
