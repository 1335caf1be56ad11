"""The prefix trie of rebuilt conversations, by double-array tries over shards of prefixes.

A conversation c is rebuilt from the first h turns of conversation c - c % 100 and its own turns after its first h. A
turn is known by a 128-bit hash of role and text; a node of the trie (a sequence of first turns) by its depth and the
exclusive or of the hashes of (place, turn) on its path, 128 bits too.

- Turns are numbered inside their conversation by one sort of the whole table by range, so that a conversation of very
  many turns is spread over tasks; only the seams of the ranges meet on the driver, one row for each.
- A rebuilt conversation is cut into bands of BAND turns. A band's path starts with the key of the node above it.
- The bands, sorted by path, are dealt out by range: a shard is a run of neighbours of at most CHUNK turns, so
  neither a hot prefix nor a group of copies is too large for a task. Each shard numbers its turns densely, packs the
  BASE and CHECK arrays of its trie and sends every path through them; what meets in a slot is summed.
- Only nodes on the first or last path of a shard can be in another shard as well: these upper nodes are merged
  globally, all others are complete (the grouping by key costs them a row, no sum).
- Sums over subtrees: a node counts in the shard of its smallest member alone, with what lies below its band. Each
  shard adds up from the leaves, and upper nodes are merged again.

The hash of a node's ends is sequential by nature. It is taken from pieces of sorted ids as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyhound.llm.shared import crc32_sql, stored
from copyhound.sources.tables import read_table

BAND = 512
CHUNK = 1 << 16
MOST_SHARED = 5
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "za", "zb"]
_NODE = ("chunk long, slot long, up long, depth long, za long, zb long, pa long, pb long, chars long, n long, low long, "
         "ends_sha string, ends string, ends_first long")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from another: crc32 of the decimal id, mod 6."""
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(MOST_SHARED + 1)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id: adds each row's place among the task's rows of its conversation, from 1, and the task."""
    from pyspark import TaskContext

    task, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if len(conv) == 0:
            continue
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
        if conv[0] == last:
            place[:first[1] if len(first) > 1 else len(conv)] += seen
        last, seen = conv[-1], place[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[3:], pa.array(place), pa.array(np.full(len(conv), task))],
                                         names=["conv_id", "k1", "k2", "chars", "place", "task"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, task, pos, k1, k2, chars): the turns of each conversation in order of turn (null first), pos from 1. Turns
    with equal numbers are ordered by the SHA-256 of role and text; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), text, role).alias("k2"), F.char_length(text).cast("long").alias("chars"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.mapInArrow(_ranked, "conv_id long, k1 long, k2 long, chars long, place long, task long"), "ranked")
    # one row for each task: a conversation that goes on from the task before starts after the turns there
    seams = rows.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).orderBy("task").collect()
    offsets, conv, carried = [], None, 0
    for s in seams:
        offset = carried if s["first"] == conv else 0
        offsets.append((s["task"], s["first"], offset))
        carried = s["last"]["place"] + (offset if s["last"]["conv_id"] == s["first"] else 0)
        conv = s["last"]["conv_id"]
    offsets = rows.sparkSession.createDataFrame(offsets, "task long, conv_id long, offset long")
    rows = rows.join(F.broadcast(offsets), ["task", "conv_id"], "left")
    return rows.select("conv_id", "task", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("pos"), "k1", "k2", "chars")


def bands(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The rebuilt conversations, a row for each band: (conv_id, seg, sa, sb, path, marks, ends). sa, sb: the key of the
    node above the band; path: its turns; marks: what each adds to the key, and its length; ends: nothing follows."""
    turns = numbered_turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % 100
    spread = turns.select("conv_id", "task").distinct()
    convs = spread.select("conv_id").distinct().select("conv_id", base.alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    heads = turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= MOST_SHARED)).select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "chars")
    taken = convs.join(heads, "base").where("pos <= h")
    given = taken.groupBy("conv_id").agg(F.count("*").alias("given"))
    shift = convs.join(given, "conv_id", "left").select("conv_id", "h", F.coalesce("given", F.lit(0)).alias("given"))
    shift = spread.join(shift, "conv_id")  # by task too: a conversation of very many turns isn't one group
    own = turns.join(shift, ["conv_id", "task"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "k1", "k2", "chars")
    columns = ["conv_id", "pos", "k1", "k2", "chars"]
    turnless = convs.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in columns[1:]])
    all_turns = own.select(columns).unionByName(taken.select(columns)).unionByName(turnless)
    all_turns = all_turns.withColumns({"a": F.xxhash64("pos", "k1", "k2"), "b": F.xxhash64("k2", "pos", "k1"), "seg": F.coalesce(F.floor((F.col("pos") - 1) / band), F.lit(0))})
    there = F.col("pos").isNotNull()
    grouped = all_turns.groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.when(there, F.struct("pos", "k1", "k2", "a", "b", "chars")))).alias("x"),
        F.bit_xor(F.when(there, F.col("a"))).alias("ta"), F.bit_xor(F.when(there, F.col("b"))).alias("tb"))
    by = W.partitionBy("conv_id").orderBy("seg")
    above = by.rowsBetween(W.unboundedPreceding, -1)
    return grouped.select(
        "conv_id", "seg", F.coalesce(F.bit_xor("ta").over(above), F.lit(0)).alias("sa"), F.coalesce(F.bit_xor("tb").over(above), F.lit(0)).alias("sb"),
        F.transform("x", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"))).alias("path"),
        F.transform("x", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars"))).alias("marks"),
        F.lead("seg").over(by).isNull().alias("ends"))


def dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, 2, ... for the distinct rows of columns."""
    order = np.lexsort(columns)
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def edges(labels: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, label) of the nodes 1, 2, ... of the trie of sorted sequences labels[bounds[i]:bounds[i + 1]] (none empty);
    node 0 is the root, and a parent's number is less than its child's."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(labels)) - bounds[row]
    before = np.append([0], size[:-1])[row]
    other = (place >= before) | (row == 0)
    other[~other] = labels[np.flatnonzero(~other)] != labels[(bounds[row - 1] + place)[~other]]
    common = np.minimum.reduceat(np.where(other, place, size[row]), bounds[:-1])
    new = place >= common[row]
    number = np.cumsum(new)
    parent = np.where(place[new] > common[row[new]], number[new] - 1, 0)
    path: list[int] = []  # the nodes of the row before
    first = np.flatnonzero(new & (place == common[row]))
    tail = (size - common)[row[first]]
    for at, n, k in zip(first.tolist(), tail.tolist(), place[first].tolist()):
        node = int(number[at])
        if k:
            parent[node - 1] = path[k - 1]
        path[k:] = range(node, node + n)
    return parent, labels[new]


def packed(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The double array of a trie: (slot of each node, BASE, CHECK), the last two by slot. The child of slot s by label x
    stands at t = BASE[s] + x, where CHECK[t] = s. A node with several children takes the first base at which all their
    slots are free, those with most children first; then single children fill the slots that are left."""
    order = np.lexsort((label, parent))
    parent_of, first = np.unique(parent[order], return_index=True)
    count = np.diff(np.append(first, len(order)))
    used = np.zeros(2 * len(label) + int(label.max(initial=0)) + 2, bool)
    used[0] = True
    base_of, low = np.zeros(len(label) + 1, np.int64), 1
    many = np.flatnonzero(count > 1)
    for g in many[np.argsort(-count[many], kind="stable")].tolist():
        x = label[order[first[g]:first[g] + count[g]]]
        ahead, step, at = x - x[0], max(1, (1 << 18) // len(x)), low
        while True:
            if at + step + ahead[-1] >= len(used):
                used = np.concatenate([used, np.zeros(len(used) + step + int(ahead[-1]), bool)])
            free = at + np.flatnonzero(~used[at:at + step])
            fits = ~used[free[:, None] + ahead].any(1)
            if fits.any():
                break
            at += step
        at = int(free[fits.argmax()])
        used[at + ahead] = True
        base_of[parent_of[g]] = at - x[0]
        while used[low]:
            low += 1
    single = np.flatnonzero(count == 1)
    free = np.flatnonzero(~used[low:]) + low
    while len(free) < len(single):
        used = np.concatenate([used, np.zeros(len(single), bool)])
        free = np.flatnonzero(~used[low:]) + low
    base_of[parent_of[single]] = free[:len(single)] - label[order[first[single]]]
    slot = np.zeros(len(label) + 1, np.int64)
    slot[1:] = base_of[parent] + label
    base, check = np.zeros(int(slot.max()) + 1, np.int64), np.full(int(slot.max()) + 1, -1)
    base[slot] = base_of
    check[slot[1:]] = slot[parent]
    return slot, base, check


class _Shard:
    """Bands in sorted order until there are enough for a trie."""

    def __init__(self, band: int):
        self.band, self.parts, self.turns = band, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.turns += batch.num_rows + len(batch.column(4).flatten())

    def nodes(self, chunk: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts, self.turns = [], 0
        conv, seg, sa, sb = (table.column(c).to_numpy() for c in ("conv_id", "seg", "sa", "sb"))
        ends = table.column("ends").to_numpy(zero_copy_only=False)
        path, marks = (pa.concat_arrays(table.column(c).chunks) for c in ("path", "marks"))
        size = np.diff(path.offsets.to_numpy())
        k1, k2 = (x.to_numpy() for x in path.flatten().flatten())
        a, b, chars = (x.to_numpy() for x in marks.flatten().flatten())
        m = len(conv)
        bounds = np.append(0, np.cumsum(size + 1))
        begin = np.zeros(bounds[-1], bool)
        begin[bounds[:-1]] = True
        labels = np.empty(bounds[-1], np.int64)
        labels[~begin] = dense(k2, k1)
        labels[begin] = dense(sb, sa, seg) + labels[~begin].max(initial=-1) + 1
        slot, base, check = packed(*edges(labels, bounds))
        n, low = np.zeros(len(check), np.int64), np.full(len(check), np.iinfo(np.int64).max)
        depth, za, zb, length = (np.zeros(len(check), np.int64) for _ in range(4))
        state, key_a, key_b = np.zeros(m, np.int64), sa.copy(), sb.copy()
        flat = np.append(0, np.cumsum(size))
        for k in range(int(size.max(initial=0)) + 1):
            rows = np.flatnonzero(size >= k)
            at = base[state[rows]] + labels[bounds[rows] + k]
            if (check[at] != state[rows]).any():
                raise AssertionError("a path isn't in the double array")
            state[rows] = at
            depth[at] = seg[rows] * self.band + k
            if k:
                turn = flat[rows] + k - 1
                key_a[rows] ^= a[turn]
                key_b[rows] ^= b[turn]
                length[at] = chars[turn]
            za[at], zb[at] = key_a[rows], key_b[rows]
            real = rows if k else np.flatnonzero(seg == 0)  # the node above a later band is counted in the band before
            np.add.at(n, state[real], 1)
            np.minimum.at(low, state[real], conv[real])
        outer = set()  # slots that other shards may have too
        for r in (0, m - 1):
            s = 0
            for x in labels[bounds[r]:bounds[r + 1]].tolist():
                s = int(base[s]) + x
                outer.add(s)
        digest, text, first_end = {}, {}, {}
        done = np.flatnonzero(ends)
        done = done[np.lexsort((conv[done], state[done]))]
        cut = np.flatnonzero(np.diff(state[done])) + 1
        for ids in np.split(done, cut) if len(done) else []:
            s, joined = int(state[ids[0]]), ",".join(map(str, conv[ids].tolist()))
            if s in outer:
                text[s], first_end[s] = joined, int(conv[ids[0]])
            else:
                digest[s] = hashlib.sha256(joined.encode()).hexdigest()
        at = np.sort(slot[1:])
        up = check[at]
        top = up == 0
        ghost = n[at] == 0
        of = lambda x: pa.array(np.where(top, 0, x[up]), mask=top)
        listed = at.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), chunk)), pa.array(at), pa.array(np.where(top, -1, up)), pa.array(depth[at]), pa.array(za[at]), pa.array(zb[at]), of(za), of(zb),
             pa.array(length[at]), pa.array(n[at]), pa.array(low[at], mask=ghost), pa.array([digest.get(s) for s in listed], pa.string()),
             pa.array([text.get(s) for s in listed], pa.string()), pa.array([first_end.get(s) for s in listed], pa.int64())],
            names=[c.split()[0] for c in _NODE.split(", ")])


def _tried(chunk_turns: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk = _Shard(band), TaskContext.get().partitionId() << 32
        for batch in batches:
            step = max(1, min(batch.num_rows, chunk_turns // (band + 1)))
            for i in range(0, batch.num_rows, step):
                shard.add(batch.slice(i, step))
                if shard.turns >= chunk_turns:
                    yield shard.nodes(chunk)
                    chunk += 1
        if shard.turns:
            yield shard.nodes(chunk)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and first id: the SHA-256 of each key's texts, joined by commas as they come."""
    now, digest, out = None, None, []
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ends"))):
            if key != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if now is not None:
        out.append((*now, digest.hexdigest()))
    columns = list(zip(*out)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=[*KEY, "joined_sha"])


_SUMS = ["conv", "n", "kids", "sha"]


def _subtrees(table: pa.Table) -> pa.Table:
    """A shard's nodes with their global values: sums over its part of each subtree, and the parent's smallest member."""
    get = lambda c: table.column(c).to_numpy()
    slot, up, depth = get("slot"), get("up"), get("depth")
    order = np.argsort(slot)
    parent = np.where(up < 0, -1, order[np.minimum(np.searchsorted(slot[order], np.maximum(up, 0)), len(order) - 1)])
    leaves, saved = np.where(get("owned"), get("leaf"), 0), np.where(get("owned"), get("save"), 0)
    by_depth = np.argsort(-depth, kind="stable")
    for rows in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        rows = rows[parent[rows] >= 0]
        np.add.at(leaves, parent[rows], leaves[rows])
        np.add.at(saved, parent[rows], saved[rows])
    real = np.flatnonzero(~get("ghost"))
    conv = get("conv")
    return pa.table({**{c: table.column(c).take(pa.array(real)) for c in (*KEY, *_SUMS)}, "leaves": leaves[real], "saved": saved[real],
                     "parent_conv": pa.array(conv[parent[real]], mask=parent[real] < 0)})


def prefix_trie(conversations: DataFrame, chunk_turns: int = CHUNK, band: int = BAND) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (conv_id, turn, role, text; other columns are left out):
    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null role or text counts as empty; rows without conv_id are left out; repeated rows are turns of their own. The
    remainder of a negative conv_id is negative, as in SQL. An empty table has no nodes, not even a root."""
    rows = stored(bands(conversations, band), "bands")
    order = ["seg", "sa", "sb", "path", "conv_id"]
    tried = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "seg", "sa", "sb", "path", "marks", "ends")
    parts = stored(tried.mapInArrow(_tried(chunk_turns, band), _NODE), "shard-nodes")
    merged = parts.groupBy(KEY).agg(F.sum("n").alias("n"), F.min("low").alias("conv"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("ends_sha").alias("ends_sha"))
    merged = stored(merged, "merged")
    kids = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("za"), F.col("pb").alias("zb")).agg(F.count("*").alias("kids"))
    joined = parts.where("ends is not null").select(*KEY, "ends_first", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "ends_first")
    joined = joined.select(*KEY, "ends").mapInArrow(_digests, "depth long, za long, zb long, joined_sha string")
    nodes = merged.join(kids, KEY, "left").join(joined, KEY, "left")
    nodes = stored(nodes.select(*KEY, "n", "conv", F.coalesce("kids", F.lit(0)).alias("kids"), ((F.col("n") - 1) * F.col("chars")).alias("save"), F.coalesce("joined_sha", "ends_sha", F.lit(EMPTY_SHA)).alias("sha")), "nodes")
    # what lies below a band: a node counts with its smallest member, which has it on its path
    seg = F.floor((F.col("depth") - 1) / band)
    counted = nodes.where(F.col("depth") > band).groupBy(F.col("conv").alias("conv_id"), seg.alias("seg")).agg(F.sum((F.col("kids") == 0).cast("long")).alias("leaf"), F.sum("save").alias("save"))
    later = rows.where("seg > 0").select("conv_id", "seg", "sa", "sb").join(counted, ["conv_id", "seg"], "left")
    on = W.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(W.unboundedPreceding, 0)
    later = later.select("seg", "sa", "sb", F.sum(F.coalesce("leaf", F.lit(0))).over(on).alias("leaf"), F.sum(F.coalesce("save", F.lit(0))).over(on).alias("save"))
    below = later.groupBy((F.col("seg") * band).alias("depth"), F.col("sa").alias("za"), F.col("sb").alias("zb")).agg(F.sum("leaf").alias("more_leaf"), F.sum("save").alias("more_save"))
    valued = nodes.join(below, KEY, "left").select(
        *KEY, *_SUMS, ((F.col("kids") == 0).cast("long") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"), (F.col("save") + F.coalesce("more_save", F.lit(0))).alias("save"))
    back = parts.select("chunk", "slot", "up", *KEY, "low").join(valued, KEY)
    back = back.select("*", (F.coalesce("low", F.lit(0)) == F.col("conv")).alias("same"), F.col("low").isNull().alias("ghost"))
    back = back.withColumn("owned", F.col("same") & ~F.col("ghost"))
    sums = back.groupBy("chunk").applyInArrow(_subtrees, "depth long, za long, zb long, conv long, n long, kids long, sha string, leaves long, saved long, parent_conv long")
    out = sums.groupBy(KEY).agg(*[F.max(c).alias(c) for c in (*_SUMS, "parent_conv")], F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c))")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM convs c JOIN own b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
listed AS (
  SELECT c.conv_id, coalesce(t.turns, []) AS turns
  FROM convs c LEFT JOIN (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, pos) AS turns FROM rebuilt GROUP BY conv_id) t ON t.conv_id = c.conv_id),
paths AS (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM listed),
members AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM paths),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS sha
  FROM members GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (
  SELECT n.*, coalesce(k.kids, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.p[n.d].t) ELSE 0 END AS save
  FROM nodes n LEFT JOIN kids k ON k.p = n.p),
up AS (SELECT p, d, kids, save, unnest(generate_series(0, d)) AS a FROM valued),
sums AS (SELECT p[1:a] AS p, sum((kids = 0)::BIGINT) AS leaves, sum(save) AS saved FROM up GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n AS n_convs, v.kids AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.sha AS ends_sha256
FROM valued v JOIN sums s ON s.p = v.p LEFT JOIN nodes q ON v.d > 0 AND q.p = v.p[1:v.d - 1]
"""
