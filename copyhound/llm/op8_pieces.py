"""SentencePiece encoding and decoding for merge-type vocabularies (BPE with byte fallback).

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make, the leftmost first
among equals, and merges the best until none is left. Two characters that stand side by side in no piece of the
vocabulary can never meet in a symbol, so a text is cut there; each distinct segment is merged once in a worker.
Short segments run in step: every round merges the head of each segment's agenda, in numpy. Long ones use a heap.
In each Arrow batch a part of the texts is encoded by the sentencepiece library too, and a difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from copyhound.llm import blocks as B
from copyhound.llm.shared import documents
from copyhound.llm.tokens import vocabulary_path

KEEP_SEGMENTS = 2 << 20
LONG = 48
CHECK_EVERY = 64
_SPACE = "▁"


class MergeVocabulary:
    """The pieces, scores and merges of a model, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("Aﬁ  b ") != f"{_SPACE}Aﬁ{_SPACE}{_SPACE}b{_SPACE}":
            raise ValueError("only models with identity normalisation, a dummy prefix and all white space kept")
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces aren't supported")
        self.n = n
        self.byte_id = np.zeros(256, np.int64)
        self.piece_id: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece_id[piece.replace(_SPACE, " ")] = i
        # Symbols: a piece has its id; any other character has n + its code point.
        symbol = lambda s: self.piece_id.get(s, n + ord(s) if len(s) == 1 else -1)
        left, right, made = [], [], []
        self.meet = np.zeros((256, 256), bool)
        for piece, i in self.piece_id.items():
            raw = piece.encode()
            for a, b in zip(raw, raw[1:]):
                self.meet[a, b] = True
            for k in range(1, len(piece)):
                x, y = symbol(piece[:k]), symbol(piece[k:])
                if x >= 0 and y >= 0:
                    left.append(x)
                    right.append(y)
                    made.append(i)
        self.made = np.array(made, np.int64)
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1]  # equal scores have equal ranks
        self.pairs = B.HashTable(18)
        self.pairs.add(B.mix(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)))
        self.pair = {(x, y): i for x, y, i in zip(left, right, made)}
        self.char_symbol = np.arange(0x110000, dtype=np.int64) + n
        for piece, i in self.piece_id.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 for none."""
        at = self.pairs.find(B.mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))
        return np.where(at < 0, -1, self.made[at])

    def heap_merge(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over a linked list, for one long segment."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (i := self.pair.get((symbols[a], symbols[b]))) is not None:
                heapq.heappush(agenda, (int(self.rank[i]), a, symbols[a], symbols[b], i))

        for a in range(n - 1):
            offer(a)
        while agenda:
            _, a, x, y, i = heapq.heappop(agenda)
            b = after[a]
            if symbols[a] != x or b >= n or symbols[b] != y:
                continue
            symbols[a], symbols[b] = i, -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [s for s in symbols if s >= 0]

    def step_merge(self, symbol: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many segments in step. Returns the symbols left and each segment's number of them."""
        size = np.diff(bounds)
        segment = np.repeat(np.arange(len(size)), size)
        done_symbol, done_segment = [], []
        while len(symbol):
            inside = np.zeros(len(symbol), bool)
            inside[:-1] = segment[1:] == segment[:-1]
            at = np.flatnonzero(inside)
            piece = self.merged(symbol[at], symbol[at + 1])
            at, piece = at[piece >= 0], piece[piece >= 0]
            # The head of each agenda: least rank, then leftmost.
            key = self.rank[piece] * np.int64(len(symbol)) + at
            first = np.flatnonzero(np.concatenate([[True], segment[at][1:] != segment[at][:-1]])) if len(at) else np.zeros(0, np.int64)
            best = np.minimum.reduceat(key, first) if len(at) else np.zeros(0, np.int64)
            live = np.zeros(len(size), bool)
            live[segment[at]] = True
            over = ~live[segment]
            done_symbol.append(symbol[over])
            done_segment.append(segment[over])
            head = best % len(symbol) if len(best) else best
            chosen = np.searchsorted(at, head)
            symbol[head] = piece[chosen]
            over[head + 1] = True
            symbol, segment = symbol[~over], segment[~over]
        symbols, segments = np.concatenate(done_symbol or [symbol]), np.concatenate(done_segment or [segment])
        by = np.argsort(segments, kind="stable")
        return symbols[by], np.bincount(segments, minlength=len(size))

    def to_ids(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters without a piece as their UTF-8 bytes, and the number of ids of each symbol."""
        code = symbol - self.n
        size = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        out = np.repeat(symbol, size)
        raw = np.flatnonzero(code >= 0)
        if len(raw):
            text = "".join(map(chr, code[raw].tolist())).encode("utf-8", "surrogatepass")
            out[B.ranges((np.cumsum(size) - size)[raw], size[raw])] = self.byte_id[np.frombuffer(text, np.uint8)]
        return out, size


class PieceCoder:
    """Encodes blocks of texts with a cache of segments; equal means equal 64-bit hash, length and last byte."""

    def __init__(self, path: str):
        self.vocabulary = MergeVocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.table = B.HashTable(20)
        self.first, self.size, self.sign = (np.zeros(1 << 16, t) for t in (np.uint32, np.uint32, np.uint32))
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint16 if self.vocabulary.n <= 1 << 16 else np.uint32), 0

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments: cut where two characters meet in no piece, by the bytes at their border."""
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.vocabulary.meet[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[off] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:], np.searchsorted(at[:-1], off)

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments, put together, and each one's number of ids."""
        v = self.vocabulary
        width = end - start
        raw = data[B.ranges(start, width)]
        stop = np.cumsum(width)
        lead = (raw & 0xC0) != 0x80
        count = B.per_row(lead.astype(np.int64), np.concatenate([[0], stop]))
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        symbol = v.char_symbol[code]
        bounds = np.concatenate([[0], np.cumsum(count)])
        long = count > LONG
        kept = ~np.repeat(long, count)
        got, n = v.step_merge(symbol[kept], np.concatenate([[0], np.cumsum(count[~long])]))
        if long.any():
            size = np.zeros(len(count), np.int64)
            size[~long] = n
            merged = {k: v.heap_merge(symbol[bounds[k]:bounds[k + 1]].tolist()) for k in np.flatnonzero(long).tolist()}
            size[list(merged)] = [len(x) for x in merged.values()]
            out = np.zeros(int(size.sum()), np.int64)
            place = np.cumsum(size) - size
            out[B.ranges(place[~long], n)] = got
            for k, x in merged.items():
                out[place[k]:place[k] + len(x)] = x
            got, n = out, size
        ids, wide = v.to_ids(got)
        return ids, B.per_row(wide, np.concatenate([[0], np.cumsum(n)]))

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, sign: np.ndarray) -> None:
        new, size = self.merge(data, start, end)
        n, more = self.table.count, len(start)
        while n + more > len(self.first):
            self.first, self.size, self.sign = (np.resize(x, 2 * len(x)) for x in (self.first, self.size, self.sign))
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.n_ids:self.n_ids + len(new)] = new
        self.first[n:n + more] = self.n_ids + np.cumsum(size) - size
        self.size[n:n + more] = size
        self.sign[n:n + more] = sign
        self.n_ids += len(new)
        self.table.add(key)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block and the number of ids before each (one more entry)."""
        if len(data) == 0:
            return np.zeros(0, self.ids.dtype), np.zeros(len(off), np.int64)
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else ()
        if len(mark):  # the mark that stands for a space is one
            gone = np.zeros(len(data) + 1, np.int64)
            gone[mark + 1] = gone[mark + 2] = 1
            data = data.copy()
            data[mark] = 0x20
            keep = gone[:-1] == 0
            off = off - np.concatenate([[0], np.cumsum(gone)])[off]
            data = data[keep]
        # The dummy prefix: a space before each text that isn't empty.
        full = np.diff(off) > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        out = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(off))] = data
        data, off = out, off + shift
        start, end, bounds = self.cut(data, off)
        key = B.span_hashes(data, start, end)
        sign = ((end - start).astype(np.uint32) << np.uint32(8)) | data[end - 1]
        if self.table.count > KEEP_SEGMENTS:
            self.clear()
        at = self.table.find(key)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            where = miss[np.unique(key[miss], return_index=True)[1]]
            self._learn(data, start[where], end[where], key[where], sign[where])
            at[miss] = self.table.find(key[miss])
        if np.array_equal(self.sign[at], sign):
            size = self.size[at].astype(np.int64)
            ids = self.ids[B.ranges(self.first[at].astype(np.int64), size)]
        else:  # two segments share a hash: all are merged anew
            ids, size = self.merge(data, start, end)
        return ids, np.concatenate([[0], np.cumsum(size)])[bounds]


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, model: str, check_every: int = CHECK_EVERY, with_ids: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): n_tokens, ids_sha256, decoded_sha256 (with_ids: ids, decoded).

    Null text counts as empty: no ids, the empty text. Null doc_ids and repeated rows stay rows. Every `check_every`-th
    text of a batch (from its first) is also encoded by the library; RuntimeError where it differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        sp = c.vocabulary.library
        for batch in batches:
            for i, j, data, off in B.text_blocks(batch.column(1)):
                flat_ids, bounds = c.encode(data, off)
                ids = [flat_ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
                for k in range(-i % check_every, j - i, check_every):
                    if sp.encode(data[off[k]:off[k + 1]].tobytes().decode()) != ids[k]:
                        raise RuntimeError(f"doc_id {batch.column(0)[i + k]}: ids differ from the library's")
                texts = [sp.decode(x) for x in ids]
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                columns = [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(bounds)),
                           pa.array([sha(",".join(map(str, x))) for x in ids], pa.string()), pa.array([sha(x) for x in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))
