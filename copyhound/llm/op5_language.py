"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text into (language, bucket) cells, adds them up in each task and then
by key; the matrix of log-probabilities, buckets x languages, is broadcast, and a batch of texts is scored by
gathering its n-grams' rows and adding them up by text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents, fold, stored

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Bytes of text that a worker takes at once: its arrays take about fifty times as much.
BLOCK_BYTES = 512 << 10
_MARK, _LETTER = 1, 2
_SEED = {n: np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & (1 << 64) - 1) for n in range(1, 9)}


@functools.cache
def letter_table() -> np.ndarray:
    """For each code point: _LETTER for Unicode's category L, _MARK for M (it stays inside a word), else 0."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter((_LETTER if k == "L" else _MARK if k == "M" else 0 for k in kinds), np.uint8, 0x110000)


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 texts with every run of neither letters nor marks as one 0, and each text's first
    place. Lower case is that of ASCII, Latin-1, Greek and Cyrillic."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    code = b.copy()
    more = np.concatenate([data[1:], np.zeros(3, np.uint8)]).astype(np.uint32)
    for low, high, keep, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        hit = np.flatnonzero((b >= low) & (b < high))
        if len(hit):
            value = b[hit] & keep
            for k in range(extra):
                value = value << 6 | more[at[hit] + k] & 0x3F
            code[hit] = value
    upper = ((code >= 65) & (code <= 90)) | ((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)) | ((code >= 0x391) & (code <= 0x3A9) & (code != 0x3A2)) | ((code >= 0x410) & (code <= 0x42F))
    code[upper] += 32
    letter = letter_table()[code] > 0
    code[~letter] = 0
    first = np.searchsorted(at, off)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter
    kept = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], kept[first]


def gram_buckets(code: np.ndarray, bounds: np.ndarray, order: int, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram of an order. No n-gram crosses texts or holds a break but at its ends."""
    n = len(code) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = text[:n] == text[order - 1:]
    for k in range(order) if order == 1 else range(1, order - 1):
        ok &= code[k:k + n] != 0
    value = np.zeros(n, np.uint64)
    for k in range(order):
        value = value << np.uint64(21) ^ code[k:k + n].astype(np.uint64)
    value = value[ok] * np.uint64(2) ^ _SEED[order]
    return text[:n][ok], (B.mix(value) >> np.uint64(64 - bits)).astype(np.int64)


class LanguageModel:
    """log_prob: float32, one row for each (order, bucket), one column for each language."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.languages, self.log_prior, self.log_prob = languages, log_prior, log_prob


def train(docs: DataFrame, bits: int = BUCKET_BITS, smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows of docs (text, lang); rows without a text or a label are left out.

    Counts are one dense array for each language in a task, (orders x 2**bits) longs, so a language that holds most
    rows still sends at most one array from a task. Raises ValueError beyond MAX_LANGUAGES labels, which bounds
    what the driver gets."""
    labelled = docs.where("text is not null and lang is not null").select("lang", "text")
    cells = len(ORDERS) << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1), BLOCK_BYTES):
                langs = batch.column(0).slice(i, j - i).to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                code, bounds = code_points(data, off)
                for k, order in enumerate(ORDERS):
                    text, bucket = gram_buckets(code, bounds, order, bits)
                    got = np.bincount(number[text] * (1 << bits) + bucket, minlength=len(names) << bits).reshape(len(names), -1)
                    for one, row in zip(names, got):
                        if one not in totals:
                            totals[one] = np.zeros(cells, np.int64)
                        totals[one][k << bits:k + 1 << bits] += row
                for one, n in zip(*np.unique(number, return_counts=True)):
                    rows[names[one]] = rows.get(names[one], 0) + int(n)
        for one, array in totals.items():
            at = np.flatnonzero(array)
            yield pa.RecordBatch.from_arrays([pa.array([one] * (len(at) + 1)), pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[rows[one]], array[at]]))], names=["lang", "cell", "n"])

    counted = labelled.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counted = stored(counted, "gram-counts")
    languages = [r["lang"] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages.sort()
    table, prior = np.zeros((len(languages), cells)), np.ones(len(languages))
    packed = counted.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))
    for r in packed.toLocalIterator():  # a language at a time, straight into the matrix
        k, cell, n = languages.index(r["lang"]), np.array(r["cells"]), np.array(r["ns"], float)
        prior[k] = n[cell < 0].sum()
        table[k, cell[cell >= 0]] = n[cell >= 0]
    table += smoothing
    for k in range(len(ORDERS)):
        part = table[:, k << bits:k + 1 << bits]
        part /= part.sum(axis=1, keepdims=True)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(table).T.astype(np.float32).copy())


def predict(docs: DataFrame, model: LanguageModel, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds lang_pred and score (the posterior of that language) to docs; `und` with score 0 for a null text, one
    without letters, or if no language was learned. Ties go to the language that sorts first. Columns of docs that
    have these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    names = [c for c in kept.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(at), BLOCK_BYTES):
                code, bounds = code_points(data, off)
                total = np.tile(m.log_prior, (j - i, 1))
                letters = B.per_row((letter_table()[code] == _LETTER).astype(np.int64), bounds)
                for k, order in enumerate(ORDERS):
                    text, bucket = gram_buckets(code, bounds, order, bits)
                    edges = np.searchsorted(text, np.arange(j - i + 1))
                    bucket += k << bits
                    for c in range(len(m.languages)):
                        total[:, c] += B.per_row(m.log_prob[bucket, c].astype(np.float64), edges)
                known = (letters > 0) & (len(m.languages) > 0)
                if len(m.languages):
                    best = total.argmax(axis=1)
                    top = total[np.arange(j - i), best]
                    prob = 1 / np.exp(total - top[:, None]).sum(axis=1)
                    pred = np.array(m.languages, object)[best]
                else:
                    prob, pred = np.zeros(j - i), np.full(j - i, UNKNOWN, object)
                pred = np.where(known, pred, UNKNOWN)
                own = [batch.column(c).slice(i, j - i) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pred.tolist(), pa.string()), pa.array(np.where(known, prob, 0.0))], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema + ", lang_pred string, score double")


def held_out() -> Column:
    return fold(F.col("doc_id"), 4) == 2


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
