"""Spelling variant grouping by a dictionary of trie-node pairs.

Two tries, one over the words and one over the reversed words, number every prefix and every suffix of the vocabulary.
Splitting a word of L code points at i gives pairs of numbers: (prefix of i, suffix after i + 1) skips a position,
(prefix of i, suffix after i) opens a gap for one. Two words that skip the same pair differ by one replacement; a word
whose gap is another's skipped pair is that word with one code point less. A pair says where it is split, so its group
has no more words than there are letters, whatever the corpus: neighbours are exact without candidates to check, and no
group is hot. Rows are 2 * L + 1 pairs of integers for a word, not strings.

The tries are numbered by sorted range: a task walks its words in order and numbers the nodes that the word before doesn't
have. Only the seams between tasks meet on the driver: the paths of a task's first and last word. Numbers rise in order
of the words, so a word's last node is its id and orders it by code points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import crc32_sql, documents, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
ALTERED = 31
_FLUSH = 1 << 20
_LONG_RUN = 256
_GAP, _SKIP, _REPEATED = 0, 1, 2


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


def crc32_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, continued from the checksum `before` it; short ranges in step, byte by byte."""
    table = _crc_table()
    size = end - start
    order = np.argsort(-size, kind="stable")
    long_ = int(np.searchsorted(-size[order], -_LONG_RUN))
    crc = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, left = start[order], size[order]
    for k in range(int(left[long_]) if long_ < len(left) else 0):
        stop = int(np.searchsorted(-left, -k))
        part = slice(long_, stop)
        crc[part] = table[(crc[part] ^ data[at[part] + k]) & np.uint32(255)] ^ (crc[part] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long_):
        crc[i] = zlib.crc32(data[at[i]:at[i] + left[i]].tobytes(), int(before[order[i]]))
    out = np.empty(len(crc), np.uint32)
    out[order] = crc
    return out


def altered(word: str, h: int) -> str:
    """The run that counts: 1 of ALTERED loses a code point."""
    return word if h % ALTERED else word[:h % len(word)] + word[h % len(word) + 1:]


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the words of all texts of docs (doc_id, text) with at least least_length code points. Null text has no
    words; a null doc_id counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1), 2 * B.BLOCK_BYTES):
                data = B.LOWER[data]
                wide = data == 0xC3  # leads all of U+00C0 to U+00FF
                solid = B.LETTER[data] | wide
                solid[1:] |= wide[:-1]
                start, end, bounds = B.runs(solid, off)
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                length = points[end] - points[start]
                text = np.repeat(np.arange(j - i), np.diff(bounds))
                keep = np.flatnonzero(length >= least_length)
                start, end, text, length = start[keep], end[keep], text[keep], length[keep]
                ids = batch.column(0).slice(i, j - i).to_pylist()
                crc = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids], np.uint32)
                h = crc32_runs(data, start, end, crc[text])
                changed = h % ALTERED == 0
                whole = np.flatnonzero(~changed)
                _, first, times = np.unique(B.span_hashes(data, start[whole], end[whole]), return_index=True, return_counts=True)
                raw = data.tobytes()
                for r, n in zip(whole[first].tolist(), times.tolist()):
                    w = raw[start[r]:end[r]]
                    counts[w] = counts.get(w, 0) + n
                for r in np.flatnonzero(changed & (length > least_length)).tolist():
                    w = altered(raw[start[r]:end[r]].decode(), int(h[r])).encode()
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) >= _FLUSH:
                    yield flushed()
        if counts:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column, and the length of each."""
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in order (column 0) with their path: the numbers, from 1 in each task, of the nodes from the root on (0)."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    last, path, count = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        points, size = _points(batch.column(0))
        points, size = np.concatenate([last, points]), np.append(len(last), size)
        bounds = np.append(0, np.cumsum(size))
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(points)) - bounds[row]
        previous = np.append(0, size[:-1])[row]
        differs = (row == 0) | (place >= previous)
        same = np.flatnonzero(~differs)
        differs[same] = points[same] != points[bounds[row[same] - 1] + place[same]]
        stop = np.full(len(size) + 1, np.iinfo(np.int64).max)  # a row's first place that differs from the row before
        np.minimum.at(stop, row[differs], place[differs])
        new = (place >= stop[row]) & (row > 0)
        node = np.zeros(len(points), np.int64)
        node[new] = count + np.arange(1, np.count_nonzero(new) + 1)
        node[:len(last)] = path
        by_place = np.lexsort((row, place))
        cuts = np.flatnonzero(np.diff(place[by_place])) + 1
        for at in np.split(by_place, cuts):  # a node that isn't new is that of the row before
            node[at] = np.maximum.accumulate(node[at])
        count += int(np.count_nonzero(new))
        last, path = points[bounds[-2]:], node[bounds[-2]:]
        size, node = size[1:], node[bounds[1]:]
        offsets = np.append(0, np.cumsum(size + 1))
        flat = np.zeros(offsets[-1], np.int64)
        inside = np.ones(len(flat), bool)
        inside[offsets[:-1]] = False
        flat[inside] = node
        nodes = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task)), nodes], names=[*batch.schema.names, "task", "nodes"])


def numbered(words: DataFrame, name: str) -> DataFrame:
    """words (key, ...; distinct keys) with `nodes`: the numbers of key's prefixes in the trie of all keys, the empty one (0)
    first. The last one rises with the key."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in words.schema]
    order = words.repartitionByRange("key").sortWithinPartitions("key")
    rows = stored(order.mapInArrow(_walked, ", ".join([*kept, "task long", "nodes array<long>"])), name)
    ends = F.struct("key", "nodes")
    seams = rows.groupBy("task").agg(F.min(ends).alias("first"), F.max(ends).alias("last"), F.max(F.array_max("nodes")).alias("count")).orderBy("task").collect()
    moves, offset, key, path = [], 0, "", [0]
    for s in seams:
        first, last = s["first"]["key"], s["last"]["key"]
        common = next((k for k, (a, b) in enumerate(zip(key, first)) if a != b), min(len(key), len(first)))
        taken = path[:common + 1]  # numbers of the nodes that the tasks before have
        moves.append((s["task"], offset, taken))
        key, path = last, [taken[x] if x <= common else offset + x for x in s["last"]["nodes"]]
        offset += s["count"]
    moves = rows.sparkSession.createDataFrame(moves, "task long, offset long, taken array<long>")
    moved = rows.join(F.broadcast(moves), "task")
    return moved.withColumn("nodes", F.transform("nodes", lambda x: F.coalesce(F.get("taken", x.cast("int")), x + F.col("offset")))).drop("task", "offset", "taken")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, s, x, n) of each word: pairs of numbers with one position skipped, and with a gap. x is 4 * id + kind; a skip of
    a letter like the one before is _REPEATED, since the skip before gives the same shorter word."""
    for batch in batches:
        points, size = _points(batch.column(0))
        ids, n = (batch.column(c).to_numpy() for c in (1, 2))
        forward, backward = (batch.column(c).flatten().to_numpy() for c in (3, 4))
        at = np.append(0, np.cumsum(size + 1))[:-1]
        row = np.repeat(np.arange(len(size)), size)
        place = B.ranges(np.zeros(len(size), np.int64), size)
        repeated = np.zeros(len(points), bool)
        repeated[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
        skip = (forward[at[row] + place], backward[at[row] + size[row] - place - 1], 4 * ids[row] + np.where(repeated, _REPEATED, _SKIP), n[row])
        row = np.repeat(np.arange(len(size)), size + 1)
        place = B.ranges(np.zeros(len(size), np.int64), size + 1)
        gap = (forward[at[row] + place], backward[at[row] + size[row] - place], 4 * ids[row] + _GAP, n[row])
        p, s, x, n = (np.concatenate(c) for c in zip(skip, gap))
        for k in range(0, len(p), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k:k + (1 << 16)]) for c in (p, s, x, n)], names=["p", "s", "x", "n"])


def _neighbours(p: np.ndarray, s: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Of whole groups in order of (p, s): for each word of a group its neighbours there, their number and the best."""
    ids, kind = x >> 2, x & 3
    fresh = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))
    group = np.cumsum(fresh) - 1
    total = int(group[-1]) + 1
    none = np.full(total, -1)
    out = [[], [], [], []]

    def best(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each group: the number of the rows, the best and the second row."""
        rows = rows[np.lexsort((ids[rows], -n[rows], group[rows]))]
        first = np.flatnonzero(np.append(True, group[rows[1:]] != group[rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
        count, one, two = np.zeros(total, np.int64), none.copy(), none.copy()
        size = np.diff(np.append(first, len(rows)))
        count[group[rows[first]]] = size
        one[group[rows[first]]] = rows[first]
        more = first[size > 1]
        two[group[rows[more]]] = rows[more + 1]
        return count, one, two

    def emit(rows: np.ndarray, count: np.ndarray, found: np.ndarray) -> None:
        for column, values in zip(out, (ids[rows], count, n[found], ids[found])):
            column.append(values)

    skips = np.flatnonzero(kind != _GAP)
    count, one, two = best(skips)
    several = skips[count[group[skips]] > 1]
    emit(several, count[group[several]] - 1, np.where(one[group[several]] == several, two[group[several]], one[group[several]]))
    gap = none.copy()  # one at most: the pair's word itself
    gaps = np.flatnonzero(kind == _GAP)
    gap[group[gaps]] = gaps
    leads = np.flatnonzero(kind == _SKIP)
    longer = leads[gap[group[leads]] >= 0]
    emit(longer, np.ones(len(longer), np.int64), gap[group[longer]])
    count, one, _ = best(leads)
    shorter = gaps[count[group[gaps]] > 0]
    emit(shorter, count[group[shorter]], one[group[shorter]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["id", "near", "best_n", "best_id"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (p, s); the last group of a batch may go on in the next one."""
    kept = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate([a, b.to_numpy()]) for a, b in zip(kept, batch.columns)]
        p, s = rows[:2]
        if len(p) == 0:
            continue
        cut = int(np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])))[-1])
        kept = [c[cut:] for c in rows]
        if cut:
            yield _neighbours(*(c[:cut] for c in rows))
    if len(kept[0]):
        yield _neighbours(*kept)


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For words (word, n; distinct): (id, word, n), and (id, n_near, best_n, best_id) of the words with a near word; the
    best has the largest n, then the first in code-point order."""
    forward = stored(numbered(words.select(F.col("word").alias("key"), "n"), "walked").select(F.element_at("nodes", -1).alias("id"), F.col("key").alias("word"), "n", "nodes"), "forward")
    backward = numbered(forward.select(F.reverse("word").alias("key"), "id"), "walked-back").select("id", F.col("nodes").alias("back"))
    pairs = forward.join(backward, "id").select("word", "id", "n", "nodes", "back").mapInArrow(_pairs, "p long, s long, x long, n long")
    links = pairs.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(_joined, "id long, near long, best_n long, best_id long")
    best = links.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best_id")).alias("minus"))).alias("best"))
    best = stored(best.select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.minus")).alias("best_id")), "near")
    return forward.select("id", "word", "n"), best


def spelling_forms(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row for each word of docs (doc_id, text; other columns are left out): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least `times` its
    own, else null; root is the last of its forms, or the word itself. Repeated rows count each time; a table without
    words gives no rows."""
    words = stored(corpus_words(docs, least_length).where(F.col("n") >= least_count), "words")
    words, best = near_words(words)
    forms = words.join(best, "id").where(F.col("best_n") >= times * F.col("n")).select("id", F.col("best_id").alias("form"), F.col("best_n").alias("form_n"))
    forms = stored(forms, "forms")
    roots = forms.select("id", F.col("form").alias("root"))
    while True:  # n grows by `times` with each form, so paths are short; each round doubles what is followed
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("id", "root")
        if step.where("moved").isEmpty():
            break
    name = words.select("id", "word")
    named = forms.join(roots, "id").join(name.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form").join(
        name.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form_word", "root_word", "form_n")
    out = words.join(best.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(documents(spark, sf_dir))


_BYTES = "flatten(list_transform(string_split(concat(coalesce(doc_id::VARCHAR, ''), ':', w), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
hashed AS (SELECT w, count(*) AS c, {crc32_sql(_BYTES)} AS h FROM runs WHERE length(w) >= {LEAST_LENGTH} GROUP BY doc_id, w),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % {ALTERED} = 0 THEN concat(left(w, (h % length(w))::INTEGER), substr(w, (h % length(w))::INTEGER + 2)) ELSE w END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(generate_series(0, length(word)::BIGINT - 1)) AS i FROM words),
dels AS (SELECT word, n, i, concat(left(word, i::INTEGER), substr(word, i::INTEGER + 2)) AS d FROM places),
shorter AS (SELECT DISTINCT v.word AS a, u.word AS b, v.n AS an, u.n AS bn FROM dels v JOIN words u ON u.word = v.d),
near AS (
  SELECT x.word AS word, y.word AS other, y.n AS n FROM dels x JOIN dels y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
  UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS cur, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN formed f ON f.word = c.cur WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(cur, steps) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN roots r ON r.word = f.word
"""
