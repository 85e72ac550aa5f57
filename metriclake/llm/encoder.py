"""Token ids of whole batches with the tokenizers library, each distinct chunk of a text encoded once.

Both public BPE vocabularies split a text before merging, and never merge across the border between a
word and the white space before it, or between an ASCII letter and a mark beside it. A text is therefore cut
there into chunks, the library encodes each chunk that is new to this Python worker, and numpy gathers the ids
of all chunks of a batch. Known chunks are found by their bytes, not by a hash of them. Texts that hold a special
token's name, and those with white space outside ASCII, where the byte-level pattern looks across such a
border, go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from metriclake.llm.arrays import LOWER, MULT, SHORT, SPACE, U, content, give_back, mix, utf8, words

#: White space that the byte-level pattern knows besides the six ASCII characters (fixed values of Unicode).
OTHER_SPACE = "[\x1c-\x1f\u0085   -     　]"
#: 1 for an ASCII letter, 2 for an ASCII mark but the apostrophe, which begins contractions; else 0.
LETTER_OR_MARK = np.array([1 if chr(i).isalpha() and i < 128 else 2 if 32 < i < 127 and not chr(i).isalnum() and i != 39 else 0 for i in range(256)], dtype=np.uint8)
#: Chunks kept per worker before the cache starts anew; bounds memory, not results.
CACHE_CHUNKS = 1_500_000
SLOTS = 1 << 22


class Encoder:
    """`leading`: whether a chunk keeps the one white-space character before its word (byte-level BPE)."""

    _loaded: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, leading: bool) -> Encoder:
        """One encoder per worker process and file, whose cache serves later tasks too until it is unloaded."""
        if (path, leading) not in cls._loaded:
            cls._loaded[path, leading] = cls(path, leading)
        return cls._loaded[path, leading]

    @classmethod
    def unload(cls) -> None:
        """Drops the worker's encoders and gives their memory back, so that other stages' tasks have it."""
        cls._loaded.clear()
        give_back()

    def __init__(self, path: str, leading: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading = leading
        #: Texts in which this is found are encoded whole.
        names = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([*names, *([OTHER_SPACE] if leading else [])])
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(SLOTS, dtype=np.int32)  # an open-addressed table: 1 + the number of a chunk (0: free)
        self.low, self.high = np.zeros(1 << 15, dtype=U), np.zeros(1 << 15, dtype=U)  # content of the chunks
        self.bytes = np.zeros(1 << 15, dtype=np.int64)
        self.long: dict[bytes, int] = {}  # numbers of chunks over 16 bytes
        self.known = 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 15, dtype=np.int64)
        self.count = np.zeros(1 << 15, dtype=np.int64)
        self.used = 0

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (mix(low + mix(high + n.astype(U) * MULT)) & U(SLOTS - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of chunks of at most 16 bytes by their content, -1 for new ones."""
        out = np.full(len(n), -1, dtype=np.int64)
        todo, slot = np.arange(len(n)), self._slot(low, high, n)
        while len(todo):
            held = self.slots[slot] - 1  # of a free slot -1: the last row, which is not asked below
            hit = (held >= 0) & (self.low[held] == low[todo]) & (self.high[held] == high[todo]) & (self.bytes[held] == n[todo])
            out[todo[hit]] = held[hit]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> None:
        """Enter different new chunks of at most 16 bytes under their numbers."""
        self.low[numbers], self.high[numbers], self.bytes[numbers] = low, high, n
        todo, slot = np.arange(len(n)), self._slot(low, high, n)
        while len(todo):
            free = np.flatnonzero(self.slots[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]] = numbers[todo[won]] + 1
            on = np.ones(len(todo), dtype=bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Encode new chunks; their numbers."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        n, total = self.known, int(lengths.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < n + len(got):
            for name in ("first", "count", "low", "high", "bytes"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=total)
        self.first[n : n + len(got)] = self.used + np.cumsum(lengths) - lengths
        self.count[n : n + len(got)] = lengths
        self.used += total
        self.known += len(got)
        return np.arange(n, self.known)

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each chunk; new ones are learned."""
        low, high = content(data, start, end)
        n, raw = end - start, data.tobytes()
        short, long = np.flatnonzero(n <= SHORT), np.flatnonzero(n > SHORT)
        out = np.full(len(n), -1, dtype=np.int64)
        out[short] = self._find(low[short], high[short], n[short])
        keys = [raw[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
        out[long] = [self.long.get(k, -1) for k in keys]
        new = short[out[short] < 0]
        if len(new):
            order = new[np.lexsort((n[new], high[new], low[new]))]
            same = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1]) & (n[order][1:] == n[order][:-1])
            one = order[np.concatenate([[True], ~same])]
            numbers = self._learn([raw[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            self._insert(low[one], high[one], n[one], numbers)
            out[new] = self._find(low[new], high[new], n[new])
        fresh = dict.fromkeys(k for k, i in zip(keys, out[long].tolist(), strict=True) if i < 0)
        if fresh:
            self.long.update(zip(fresh, self._learn([k.decode() for k in fresh]).tolist(), strict=True))
            out[long] = [self.long[k] for k in keys]
        return out

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the chunks in order."""
        start, end, first = words(data, offsets)
        kinds = LETTER_OR_MARK[data]
        turn = np.flatnonzero(kinds[1:] * kinds[:-1] == 2) + 1  # a letter meets a mark
        turn = turn[offsets[np.searchsorted(offsets, turn)] != turn]
        start, end = np.sort(np.concatenate([start, turn])), np.sort(np.concatenate([end, turn]))
        first = np.searchsorted(start, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        if not self.leading:
            return start, end, doc
        begin = start - ((start > offsets[doc]) & SPACE[data[start - 1]])  # with the white space before a word
        before = offsets[doc].copy()
        same = np.zeros(len(doc), dtype=bool)
        same[1:] = doc[1:] == doc[:-1]
        before[same] = end[:-1][same[1:]]
        last = offsets[:-1].copy()  # where the document's last word ends
        has = np.diff(first) > 0
        last[has] = end[first[1:][has] - 1]
        gaps, tails = before < begin, last < offsets[1:]
        start = np.concatenate([begin, before[gaps], last[tails]])
        end = np.concatenate([end, begin[gaps], offsets[1:][tails]])
        doc = np.concatenate([doc, doc[gaps], np.flatnonzero(tails)])
        order = np.argsort(start, kind="stable")
        return start[order], end[order], doc[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets); a null has no ids."""
        column = column.cast(pa.large_string()).fill_null("")
        whole = np.zeros(len(column), dtype=bool)
        if self.apart:
            whole = pc.match_substring_regex(column, self.apart).to_numpy(zero_copy_only=False).astype(bool)
        rest = pc.if_else(pa.array(whole), "", column) if whole.any() else column
        ids, offsets = self._encode_chunks(rest)
        if not whole.any():
            return ids, offsets
        each = np.split(ids, offsets[1:-1])
        places = np.flatnonzero(whole)
        for i, x in zip(places, self.tokenizer.encode_batch_fast(column.take(pa.array(places)).to_pylist(), add_special_tokens=False), strict=True):
            each[i] = np.array(x.ids, dtype=np.uint32)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def _encode_chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(column)
        if not self.leading:
            data = LOWER[data]  # this vocabulary knows no capitals
        start, end, doc = self._chunks(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        parts, counts = [], []
        for i in range(0, len(start), CACHE_CHUNKS):  # one part but for a very long text
            if self.known > CACHE_CHUNKS or len(self.ids) > 8 * CACHE_CHUNKS:
                self._forget()
            index = self._numbers(data, start[i : i + CACHE_CHUNKS], end[i : i + CACHE_CHUNKS])
            first, count = self.first[index], self.count[index]
            total = np.cumsum(count)
            parts.append(self.ids[np.repeat(first - (total - count), count) + np.arange(total[-1])])
            counts.append(count)
        per = np.bincount(doc, weights=np.concatenate(counts), minlength=len(column)).astype(np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(per)])


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each document."""
    n = len(offsets) - 1
    after = offsets + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[after[1:] - 1] = False
    out[keep] = ids
    return out, after

