"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, scanning each text once.

Items and documents are normalised to the same words (A-Z lower-cased). A window is WINDOW consecutive words of an item;
an item of fewer is one window. The automaton's symbols are the items' words, numbered; a word that no item has leads
back to the root. Its states, failure links and outputs are arrays:

- `go` of a state and a symbol is a hash table over both numbers; `fail` is the longest proper suffix that is a state;
- `longest` is the longest window that ends in a state, with those on its failure chain; `items` are all of theirs.

A block of texts becomes one row of symbols, cut into lanes that are read in step, a numpy step for each place. A lane
begins WINDOW - 1 words early, which brings it into the very state that reading from the start would have, since no state
is deeper than WINDOW. Hits are ranges of words, and each word knows its place in the original text.

The automaton is broadcast. Its size is that of the items' words, so items are taken in parts of at most `most_words` words
(by counts; usually one part), each with an automaton of its own, in one pass each; a word hit by several counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents
from copyhound.sources.tables import read_table

WINDOW = 10
MOST_WORDS = 200_000
LANE = 1024
#: Bytes of words: digits, lower-case letters (A-Z are lower-cased first) and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words in bytes, and for each text the number of words before it (one more entry)."""
    return B.runs(_WORD[B.LOWER[data]], off)


class Automaton:
    """Over items: a list of (item_id, text). State 0 is the root."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, off = B.flat(pa.array([t for _, t in items], pa.string()))
        data = B.LOWER[data]
        start, end, bounds = item_words(data, off)
        hashes = B.span_hashes(data, start, end)
        distinct, symbol = np.unique(hashes, return_inverse=True)
        self.window, self.symbols = window, B.HashTable()
        self.symbols.add(distinct)
        self.width = np.uint64(len(distinct) + 1)
        count = np.diff(bounds)
        # of each window: its item, first word and length
        n = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), n)
        first = B.ranges(bounds[:-1], n)
        size = np.minimum(count, window)[item]
        state = np.zeros(len(first), np.int64)
        parents, labels, depths, total = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0], 1
        for k in range(window):  # the trie, level by level
            rows = np.flatnonzero(size > k)
            if not len(rows):
                break
            x = symbol[first[rows] + k]
            edge, at = np.unique(state[rows] * len(distinct) + x, return_inverse=True)
            state[rows] = total + at
            parents.append(edge // len(distinct))
            labels.append(edge % len(distinct))
            depths += [k + 1] * len(edge)
            total += len(edge)
        parent, label, depth = np.concatenate(parents), np.concatenate(labels), np.array(depths)
        self.go = B.HashTable()
        self.go.add(self._edge(parent[1:], label[1:]))
        self.fail = np.zeros(total, np.int64)
        level = np.searchsorted(depth, np.arange(2, depth[-1] + 2))
        for a, b in zip(level[:-1], level[1:]):  # from two words on; a word's failure link is the root
            self.fail[a:b] = self.step(self.fail[parent[a:b]], label[a:b])
        self.longest = np.zeros(total, np.int64)
        np.maximum.at(self.longest, state, size)
        self.names = np.array([name for name, _ in items], object)
        self.items: dict[int, np.ndarray] = {}
        pairs = np.unique(state * max(1, len(items)) + item)
        for own in np.split(pairs, np.flatnonzero(np.diff(pairs // max(1, len(items)))) + 1) if len(pairs) else []:
            self.items[int(own[0]) // len(items)] = own % len(items)
        for a, b in zip(level[:-1], level[1:]):  # by depth, so what the failure link has is complete
            inherits = np.flatnonzero(self.longest[self.fail[a:b]] > 0) + a
            self.longest[inherits] = np.maximum(self.longest[inherits], self.longest[self.fail[inherits]])
            for s, f in zip(inherits.tolist(), self.fail[inherits].tolist()):
                self.items[s] = np.union1d(self.items[s], self.items[f]) if s in self.items else self.items[f]

    def _edge(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return B.mix(state.astype(np.uint64) * self.width + symbol.astype(np.uint64) + np.uint64(1))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol; a symbol below 0 leads to the root."""
        out = np.zeros(len(state), np.int64)
        left = np.flatnonzero(symbol >= 0)
        while len(left):
            found = self.go.find(self._edge(state[left], symbol[left])).astype(np.int64) + 1
            out[left] = found
            left = left[(found == 0) & (state[left] > 0)]
            state[left] = self.fail[state[left]]
        return out

    def states(self, symbols: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The state after each symbol of a row, read in lanes."""
        before = self.window - 1
        lanes = max(1, -(-len(symbols) // lane))
        padded = np.full(before + lanes * lane, -1, np.int64)
        padded[before:before + len(symbols)] = symbols
        start = np.arange(lanes) * lane
        state, out = np.zeros(lanes, np.int64), np.zeros((lanes, lane), np.int64)
        for k in range(before + lane):
            state = self.step(state, padded[start + k])
            if k >= before:
                out[:, k - before] = state
        return out.reshape(-1)[:len(symbols)]


_HIT = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_SCANNED = "doc_id long, text string, n_words long, hits array<struct<start:long,stop:long>>, item_ids array<string>"


def _scan(automaton, is_first: bool):
    """Rows (doc_id, text), or those of an earlier pass; hits are ranges of words, joined with those there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Automaton = automaton.value
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1), 2 * B.BLOCK_BYTES):
                data = B.LOWER[data]
                start, end, bounds = item_words(data, off)
                n = j - i
                count = np.diff(bounds)
                text = np.repeat(np.arange(n), count)
                place = np.arange(len(start)) + text  # a separator after each text
                symbols = np.full(len(start) + n, -1, np.int64)
                symbols[place] = t.symbols.find(B.span_hashes(data, start, end))
                state = t.states(symbols)[place]
                size = t.longest[state]
                hit = np.flatnonzero(size)
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, hit - size[hit] + 1, 1)
                np.add.at(edge, hit + 1, -1)
                inside = np.cumsum(edge[:-1]) > 0
                begins, ends = _runs(inside, bounds)
                found = np.unique(text[hit] * len(t.longest) + state[hit])
                names: list[list[str]] = [[] for _ in range(n)]
                hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                for row in np.unique(found // len(t.longest)).tolist() if len(found) else []:
                    at = found[np.searchsorted(found, row * len(t.longest)):np.searchsorted(found, (row + 1) * len(t.longest))] % len(t.longest)
                    names[row] = sorted(set(t.names[np.unique(np.concatenate([t.items[s] for s in at.tolist()]))]))
                for a, b in zip(begins.tolist(), ends.tolist()):
                    row = int(text[a])
                    hits[row].append((a - int(bounds[row]), b - int(bounds[row])))
                if not is_first:
                    for row, (old, more) in enumerate(zip(batch.column(3).slice(i, n).to_pylist(), batch.column(4).slice(i, n).to_pylist())):
                        if more:
                            names[row] = sorted(set(names[row]) | set(more))
                            hits[row] = joined_ranges(hits[row] + [(h["start"], h["stop"]) for h in old])
                values = [{"start": a, "stop": b} for row in hits for a, b in row]
                offsets = np.append(0, np.cumsum([len(row) for row in hits])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n).cast(pa.int64()), batch.column(1).slice(i, n), pa.array(count),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, _HIT)), pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "hits", "item_ids"])

    return run


def _runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of true places, cut at text bounds: first places and those after the last."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    return np.sort(np.concatenate([change[::2], cuts])), np.sort(np.concatenate([change[1::2], cuts]))


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(items: DataFrame, most_words: int) -> DataFrame:
    """(part, item_id, text): the items in parts of about most_words words."""
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    total = items.agg(F.sum(words)).first()[0] or 0
    shards = max(1, -(-4 * total // most_words))
    items = items.withColumn("words", words).withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    sums = items.groupBy("shard").agg(F.sum("words").alias("of_shard"))
    before = F.sum("of_shard").over(W.orderBy("shard")) - F.col("of_shard")
    sums = sums.select("shard", F.floor(before / most_words).alias("part"))
    return items.join(sums, "shard").select("part", "item_id", "text")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are left out): doc_id, text, n_words, hits (array of
    (start, stop) ranges of words, ascending, apart), item_ids (sorted as strings) and spans (the ranges in code
    points of the original text, end exclusive, from the first letter to the last).

    Null text has no words; null doc_ids and repeated rows stay rows. Of items (item_id, text) those without item_id or
    words are left out; rows of one item_id are one item. Without items nothing is hit."""
    spark = docs.sparkSession
    named = _parts(items, most_words)
    parts = [r["part"] for r in named.select("part").distinct().orderBy("part").collect()]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for k, part in enumerate(parts or [0]):
        rows = named.where(F.col("part") == part).select("item_id", "text").collect()
        automaton = spark.sparkContext.broadcast(Automaton(sorted((r["item_id"], r["text"]) for r in rows), window))
        out = out.mapInArrow(_scan(automaton, k == 0), _SCANNED)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, hits in zip(batch.column(1), batch.column(3)):
                spans.append(original(text.as_py(), [(h["start"], h["stop"]) for h in hits.as_py()]) if len(hits) else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[{"start": a, "stop": b} for a, b in row] for row in spans], pa.list_(_HIT))],
                names=["doc_id", "text", "n_words", "hits", "item_ids", "spans"])

    return out.mapInArrow(mapped, "doc_id long, text string, n_words long, hits array<struct<start:long,stop:long>>, item_ids array<string>, spans array<struct<start:long,stop:long>>")


def original(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the text."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = item_words(data, np.array([0, len(data)]))
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return [(int(points[start[a]]), int(points[end[b - 1]])) for a, b in ranges]


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '{WORD_SQL}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER_SQL}, '{WORD_SQL}') AS w FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS x FROM cut),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM docs, sizes WHERE len(w) >= size),
grams AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS x FROM places),
found AS (SELECT g.r, g.k, g.size, m.item_id FROM grams g JOIN windows m ON m.size = g.size AND m.x = g.x),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(k, k + size - 1)) AS p FROM (SELECT DISTINCT r, k, size FROM found)) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
       sha256(coalesce(i.joined, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.r = d.r LEFT JOIN ids i ON i.r = d.r
"""
