"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features describe it and, through coarse copies, the lines before and after it; two weights matrices make its
score and a 2 x 2 table the transitions. Training sets every line of a labelled document to the document's label and
maximises the conditional likelihood of the chains on a bounded sample of labelled documents (`SAMPLE` documents with
the least hash, none over `MAX_CHARS`, of at most `MAX_LINES` lines together). A document's quality is the mean of its lines' forward-backward marginals, weighted by their length,
then mapped to a probability by a logistic curve that is learned on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents, fold
from copyhound.sources.tables import read_table

SAMPLE = 5000
MAX_CHARS = 20000
MAX_LINES = 500_000
THRESHOLD = 0.3
STEPS = 200
SMOOTH = 1e-3
_OTHER = B.PRINTED & ~B.LETTER
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>{}[]=+_\\^~@")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_BINS = 6
_OWN = 8
#: Each line's own features, one-hot; then coarse ones of the line before and after; then first, last, seen before, bias.
N_FEATURES = _OWN * _BINS + 2 * _OWN * 2 + 4


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of all lines, and for each text the number of lines before it (one more entry). A text has a line
    more than line feeds; an empty text has one empty line."""
    feed = np.flatnonzero(data == 0x0A)
    count = np.searchsorted(feed, off)
    n = np.diff(count) + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start, end = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first = np.zeros(bounds[-1], bool)
    first[bounds[:-1]] = True
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    start[first], end[last] = off[:-1], off[1:]
    inside = feed[count[0]:count[-1]]
    start[~first] = inside + 1
    end[~last] = inside
    assert len(text) == len(start)
    return start, end, bounds


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the active features of each line, N_FEATURES for none; weight of each line; lines before each text)."""
    start, end, bounds = lines(data, off)
    n = len(start)
    size = (end - start).astype(float)
    total = lambda mask: (lambda c: (c[end] - c[start]).astype(float))(np.concatenate([[0], np.cumsum(mask[data])]))
    ws, we, _ = B.words(data, np.unique(np.concatenate([off, start])))
    hashes = B.span_hashes(data, ws, we)
    line = np.searchsorted(start, ws, "right") - 1
    count = np.bincount(line, minlength=n).astype(float)
    key, per = np.unique(np.stack([line.astype(np.uint64), hashes]), axis=1, return_counts=True) if len(ws) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
    key = key[0].astype(np.int64)
    distinct = np.bincount(key, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, key, per)
    repeats = np.zeros(n)
    same = np.flatnonzero((line[1:] == line[:-1]) & (hashes[1:] == hashes[:-1]))
    np.add.at(repeats, line[same], 1)
    some, words = np.maximum(size, 1), np.maximum(count, 1)
    letters = np.maximum(total(B.LETTER), 1)
    values = np.stack([
        np.log2(some) / 12, total(_UPPER) / letters, total(_MARK) / words, total(_DIGIT) / some, total(_SHOUT) / words,
        np.where(count > 3, distinct / words, 1.0), np.where(count > 3, top / words, 0.0), repeats / words])
    edges = np.array([[0.3, 0.45, 0.55, 0.65, 0.8], [0.02, 0.1, 0.3, 0.5, 0.8], [0.02, 0.1, 0.25, 0.5, 0.8], [0.02, 0.05, 0.1, 0.2, 0.5],
                      [0.02, 0.1, 0.25, 0.5, 0.8], [0.15, 0.3, 0.5, 0.7, 0.9], [0.08, 0.15, 0.3, 0.5, 0.8], [0.02, 0.1, 0.2, 0.4, 0.7]])
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    last = np.zeros(n, bool)
    last[bounds[1:] - 1] = True
    active = np.empty((n, 3 * _OWN + 4), np.int16)
    for k in range(_OWN):
        level = np.searchsorted(edges[k], values[k], "right").astype(np.int16)
        active[:, k] = k * _BINS + level
        coarse = _OWN * _BINS + 2 * k + (level >= 3)
        active[:, _OWN + k] = np.where(first, N_FEATURES, np.roll(coarse, 1))
        active[:, 2 * _OWN + k] = np.where(last, N_FEATURES, np.roll(coarse, -1) + 2 * _OWN)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = B.span_hashes(data, start, end)
    order = np.lexsort((np.arange(n), whole, text))
    seen = np.zeros(n, bool)
    seen[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]]) & (size[order[1:]] > 0)
    for k, flag in enumerate((first, last, seen)):
        active[:, 3 * _OWN + k] = np.where(flag, N_FEATURES - 4 + k, N_FEATURES)
    active[:, -1] = N_FEATURES - 1
    return active, size + 1, bounds


def joined_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`features` of a whole column, taken block by block."""
    parts = [features(data, off) for _, _, data, off in B.text_blocks(texts, 1 << 20)]
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(counts)])


def indicator(active: np.ndarray) -> np.ndarray:
    """The 0/1 matrix of lists of active features."""
    out = np.zeros((len(active), N_FEATURES + 1), np.float32)
    out[np.arange(len(active))[:, None], active] = 1
    return out[:, :-1]


class LineChain:
    """emit: N_FEATURES weights for "good" against "bad"; move: scores of (label, next label)."""

    def __init__(self):
        self.emit, self.move = np.zeros(N_FEATURES), np.zeros((2, 2))
        self.slope, self.shift = 4.0, -2.0

    def _chains(self, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each place in a chain, the chains that reach it (longest first, so that they are a prefix)."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        for k in range(int(n.max(initial=0))):
            yield k, order[:np.searchsorted(-n[order], -k, "left")]

    def marginals(self, score: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward; with pairs also log Z's sum and the expected moves."""
        s = np.stack([np.zeros(len(score)), score], axis=1)
        forward, backward = s.copy(), np.zeros_like(s)
        steps = list(self._chains(bounds))
        for k, live in steps[1:]:
            at = bounds[live] + k
            forward[at] += np.logaddexp(forward[at - 1, :1] + self.move[0], forward[at - 1, 1:] + self.move[1])
        for k, live in reversed(steps[1:]):
            at = bounds[live] + k
            ahead = s[at] + backward[at]
            backward[at - 1] = np.logaddexp(ahead[:, :1] + self.move[:, 0], ahead[:, 1:] + self.move[:, 1])
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        if not pairs:
            return good
        inner = np.ones(len(score), bool)
        inner[bounds[:-1]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] + self.move[None] + (s[at] + backward[at])[:, None, :] - z[at][:, None, None]
        return good, z[bounds[:-1]].sum(), np.exp(joint).sum(axis=0)

    def quality(self, active: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' marginals."""
        emit = np.append(self.emit, 0.0)
        score = np.zeros(len(active))
        for k in range(active.shape[1]):
            score += emit[active[:, k]]
        good = self.marginals(score, bounds)
        return B.per_row(good * weight, bounds) / B.per_row(weight, bounds)

    def probability(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * quality + self.shift)))

    def fit(self, active: np.ndarray, weight: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = STEPS, smooth: float = SMOOTH) -> "LineChain":
        """Gradient ascent (Adam) on the chains' mean conditional log-likelihood, a line counting as a share of its chain."""
        x, n = indicator(active), np.diff(bounds)
        y = np.repeat(label, n).astype(float)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (n[label == k] - 1).sum()
        params = np.zeros(N_FEATURES + 4)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            self.emit, self.move = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
            good, _, moves = self.marginals(x @ self.emit, bounds, pairs=True)
            gradient = np.concatenate([x.T @ (y - good), (seen - moves).ravel()]) / len(y) - smooth * params
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
            params = params + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.emit, self.move = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        q = self.quality(active, weight, bounds)
        a = np.zeros(2)
        z = np.stack([q, np.ones_like(q)], axis=1)
        for _ in range(50):  # Newton steps for the logistic curve
            p = 1 / (1 + np.exp(-(z @ a)))
            a = a + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (label - p) - 1e-2 * a)
        self.slope, self.shift = a
        return self


def _bounded(texts: pa.ChunkedArray, most: int) -> int:
    """How many of the texts, from the first on, have at most `most` lines together."""
    n = 1 + pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy()
    return int((np.cumsum(n) <= most).sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MAX_LINES) -> LineChain:
    """Learns from docs (doc_id, text) and labels (doc_id, quality): at most `sample` labelled documents of at most
    MAX_CHARS characters, by least hash of the doc_id, and of these, from the first on, as many as have at most
    `most_lines` lines together, which bounds the features on the driver. Null text counts as one empty line; rows
    without a label (0 or 1) are left out. Without both labels the model scores 0.5 or the one label's side."""
    marked = labels.where("quality in (0, 1)").select("doc_id", "quality")
    some = F.broadcast(marked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    texts = docs.select("doc_id", "text").where(F.char_length(F.coalesce("text", F.lit(""))) <= MAX_CHARS).join(some, "doc_id")
    table = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "quality").limit(sample).select("text", "quality").toArrow()
    table = table.slice(0, _bounded(table.column("text"), most_lines))
    label = np.array(table.column("quality").to_pylist(), np.int64)
    chain = LineChain()
    if len(set(label.tolist())) < 2:
        chain.slope, chain.shift = 0.0, 0.0 if not len(label) else 4.0 * (2 * label[0] - 1)
        return chain
    return chain.fit(*joined_features(table.column("text")), label)


def classify(docs: DataFrame, chain: LineChain, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to docs; null text counts as empty, one empty line.
    Columns of docs with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kept = docs.drop("score", "predicted")
    names = list(kept.columns)
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(at), 1 << 20):
                score = model.probability(model.quality(*features(data, off)))
                own = [batch.column(c).slice(i, j - i) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return kept.mapInArrow(run, schema + ", score double, predicted int")


def held_out() -> Column:
    return fold(F.col("doc_id"), 5) == 0


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chain = train(docs.where(~held_out()), read_table(spark, sf_dir, "labels"))
    return classify(docs, chain).select("doc_id", held_out().alias("held_out"), "score", "predicted")
