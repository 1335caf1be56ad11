"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, each distinct piece encoded once.

`blocks.pieces` cuts texts only where the vocabulary's own splitting always cuts, so the ids of the pieces, put
together, are the ids of the text. A worker keeps the ids of the pieces it has met, up to a bound. The file's added
tokens (such as <|endoftext|>) keep their own ids where a text holds one, as the library has it, in an encoder
`as_loaded`; otherwise they are text like any other.
"""

from __future__ import annotations

import os
import re

import numpy as np

from copyhound.llm import blocks as B

KEEP_PIECES = 3 << 20
_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}
#: Bytes that stand for themselves in a byte-level vocabulary; the others are numbered on from 256.
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    other = [b for b in range(256) if b not in _PLAIN_BYTES]
    return {b: chr(b) for b in _PLAIN_BYTES} | {b: chr(256 + k) for k, b in enumerate(other)}


class PieceEncoder:
    """Encodes blocks of texts. Pieces count as equal when a 64-bit hash, the length and the last byte agree."""

    def __init__(self, path: str, as_loaded: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not as_loaded
        added = {t.content.encode(): (k, t) for k, t in self.tokenizer.get_added_tokens_decoder().items() if as_loaded or not t.special}
        self.added = {content: k for content, (k, _) in added.items()}
        self.added_bare = not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.table = B.HashTable(20)
        self.room = 1 << 16
        self.first, self.size, self.sign = (np.zeros(self.room, t) for t in (np.uint32, np.uint16, np.uint32))
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, sign: np.ndarray) -> None:
        """Adds new pieces. One that is a single unit of the vocabulary's splitting (letters, with or without a space
        before them) goes to the library's model at once; others go through the whole library."""
        letter = B.LETTER[data]
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter |= lead
        letter[1:] |= lead[:-1]
        total = np.concatenate([[0], np.cumsum(letter)])
        begin = start + (data[start] == 0x20)
        unit = (total[end] - total[begin] == end - begin) & (end > begin)
        raw = data.tobytes()
        ids: list[list[int]] = [[]] * len(start)
        others = np.flatnonzero(~unit).tolist()
        width = (end - start)[unit]
        mapped = data[B.ranges(start[unit], width)].tobytes().decode("latin-1").translate(self.letters)
        stop = np.cumsum(width)
        tokenize = self.tokenizer.model.tokenize
        for k, a, b in zip(np.flatnonzero(unit).tolist(), (stop - width).tolist(), stop.tolist()):
            ids[k] = [t.id for t in tokenize(mapped[a:b])]
        texts = [raw[start[k]:end[k]].decode("utf-8", "replace") for k in others]
        for k, e in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            ids[k] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((x for one in ids for x in one), np.int64, int(size.sum()))
        n, more = self.table.count, len(start)
        while n + more > self.room:
            self.room *= 2
            self.first, self.size, self.sign = (np.resize(x, self.room) for x in (self.first, self.size, self.sign))
        while self.n_ids + len(new) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        if size.max(initial=0) >= 1 << 16:
            self.size = self.size.astype(np.uint32)
        self.ids[self.n_ids:self.n_ids + len(new)] = new
        self.first[n:n + more] = self.n_ids + np.cumsum(size) - size
        self.size[n:n + more] = size
        self.sign[n:n + more] = sign
        self.n_ids += len(new)
        self.table.add(key)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, in order, and for each text the number of ids before it (one more entry)."""
        if len(data) == 0:
            return np.zeros(0, self.ids.dtype), np.zeros(len(off), np.int64)
        if self.added_pattern:
            raw = data.tobytes()
            if self.added_pattern.search(raw):
                return self._with_added(data, off, raw)
        return self._encode(data, off)

    def _with_added(self, data: np.ndarray, off: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The added tokens of each text are taken out with their ids, and what stands between them is encoded as texts."""
        if not self.added_bare:  # a token that takes space or words around it into account is the library's to find
            return self._plain(data, off)
        found = [m for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in self.added_pattern.finditer(raw, a, b)]
        if not found:  # only across the end of a text
            return self._encode(data, off)
        start, end = (np.array([at(m) for m in found], np.int64) for at in (re.Match.start, re.Match.end))
        rest = np.ones(len(data), bool)
        rest[B.ranges(start, end - start)] = False
        gone = np.concatenate([[0], np.cumsum(end - start)])
        # a part begins with each text and after each token
        texts_at = off - gone[np.searchsorted(start, off)]
        parts = np.insert(texts_at, np.searchsorted(off, start, "right"), start - gone[:-1])
        ids, bounds = self._encode(data[rest], parts)
        token_part = np.searchsorted(off, start, "right") + np.arange(len(start))
        ids = np.insert(ids, bounds[token_part], np.array([self.added[m.group()] for m in found], ids.dtype))
        text_part = np.arange(len(off)) + np.searchsorted(start, off)
        return ids, bounds[text_part] + np.searchsorted(start, off)

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) == 0:
            return np.zeros(0, self.ids.dtype), np.zeros(len(off), np.int64)
        start, end, bounds = B.pieces(data, off)
        key = B.span_hashes(data, start, end)
        sign = ((end - start).astype(np.uint32) << np.uint32(8)) | data[end - 1]
        if self.table.count > KEEP_PIECES:
            self.clear()
        at = self.table.find(key)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            _, where = np.unique(key[miss], return_index=True)
            where = miss[where]
            self._learn(data, start[where], end[where], key[where], sign[where])
            at[miss] = self.table.find(key[miss])
        if not np.array_equal(self.sign[at], sign):  # two pieces share a hash: the library does the block
            return self._plain(data, off)
        size = self.size[at].astype(np.int64)
        ids = self.ids[B.ranges(self.first[at].astype(np.int64), size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[bounds]

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        ids = [np.array(e.ids, self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


def encoder(path: str, as_loaded: bool = False) -> PieceEncoder:
    """This worker's encoder for a vocabulary file. The work is Spark's to spread, so the library uses one thread."""
    if (path, as_loaded) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, as_loaded] = PieceEncoder(path, as_loaded)
    return _ENCODERS[path, as_loaded]
