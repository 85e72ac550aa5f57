"""Vectorised work on whole Arrow batches of texts: bytes, words, hashes of words and windows.

All functions take numpy arrays that cover a whole batch (many documents laid end to end); document
borders are passed as offsets, so there is no Python loop over bytes, and none over words but the long ones.

Hashes are of 64 bits and mix after every step, so no structure of a text cancels out as it does in a
polynomial modulo 2**64. Two contents still share one by chance once in 2**64 pairs; where results depend on
content, whoever uses a hash compares the content too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers (of the golden ratio and of public finalisers).
MULT, OTHER, THIRD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xBF58476D1CE4E5B9)
#: Words up to so many bytes are hashed from their bytes as two integers at once.
SHORT = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply), element by element."""
    x = x.astype(U, copy=True)
    x ^= x >> U(31)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * OTHER)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that are no part of a folded word: all ASCII but letters and digits.
NOT_FOLDED = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words without case (A-Z) and marks, first word of each document and the total)."""
    data, offsets = utf8(column)
    start, end, first = words(data, offsets, NOT_FOLDED)
    return word_hashes(LOWER[data], start, end), first


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of the text column, one row at least: bounds the memory
    of vectorised work, whose arrays are many times as large as the texts."""
    for batch in batches:
        column = batch.column(text)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Python workers live on with the stages after it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and the total) of the words between bytes of one kind."""
    inside = ~between[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    before[borders] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def content(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each span as two integers; with the length they are the content of short spans."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    n = end - start
    return at[start] & MASKS[np.minimum(n, 8)], at[np.minimum(start + 8, len(data))] & MASKS[np.clip(n - 8, 0, 8)]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair: of the two integers of a short word, XXH64 of a longer one."""
    from xxhash import xxh64_intdigest

    low, high = content(data, start, end)
    n = (end - start).astype(U)
    out = mix(mix(low ^ OTHER) + mix(high + n * MULT))
    long = np.flatnonzero(n > SHORT)
    if len(long):
        raw = data.tobytes()
        out[long] = np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), dtype=U, count=len(long))
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair of hashes, in that order."""
    x = a * MULT
    x ^= x >> U(32)
    x += b
    x *= THIRD
    x ^= x >> U(29)
    return x


class Levels:
    """Hashes of runs of 1, 2, 4, ... codes, each joined from its halves; other runs are joined from those."""

    def __init__(self, codes: np.ndarray) -> None:
        self.level = [mix(codes)]

    def _of(self, k: int) -> np.ndarray:
        while len(self.level) <= k:
            last, half = self.level[-1], 1 << (len(self.level) - 1)
            self.level.append(joined(last[: max(0, len(last) - half)], last[half:]))
        return self.level[k]

    def at(self, start: np.ndarray, width: int) -> np.ndarray:
        """Hash of the `width` codes from each start."""
        out, done = None, 0
        for k in range(width.bit_length()):
            if width >> k & 1:
                part = self._of(k)[start + done]
                out = part if out is None else joined(out, part)
                done += 1 << k
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hash of each run of `width` codes, by its start."""
        n = len(self.level[0]) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=U)
        out, done = None, 0
        for k in range(width.bit_length()):
            if width >> k & 1:
                part = self._of(k)[done : done + n]
                out = part if out is None else joined(out, part)
                done += 1 << k
        return out


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` codes, by its start; border-crossing ones are the caller's to leave out."""
    return Levels(codes).windows(width)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(levels: Levels, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Maximal runs of windows with the same sampled gram.

    Each window of `width` codes inside a document is represented by its smallest gram of `gram` codes
    (the first of equals), so equal windows have equal grams at the same place. Windows that share one
    gram occurrence form a segment: doc (index in the batch), first (code index of its first window in
    the document), count (windows), anchor_at (the gram's place in the document).
    """
    lengths = np.diff(offsets)
    if not (lengths >= width).any():
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "count", "anchor_at")}
    grams = levels.windows(gram)
    if len(grams) >= 1 << 31:
        raise ValueError("a batch has too many codes; lower the Arrow batch size")
    place = np.arange(len(grams), dtype=U)
    smallest = (sliding_min((grams & U(0xFFFFFFFF80000000)) | place, width - gram + 1) & U(0x7FFFFFFF)).astype(np.int64)
    windows = np.maximum(lengths - width + 1, 0)
    doc_of = np.repeat(np.arange(len(lengths)), windows)
    start = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(len(doc_of))
    chosen = smallest[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc_of[1:] != doc_of[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    begin, anchor = start[at], chosen[at]
    return {"doc": doc_of[at], "first": begin - offsets[doc_of[at]], "count": count, "anchor_at": anchor - offsets[doc_of[at]]}


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, for Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def union_of_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint and not touching half-open spans that cover the same places."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:] - 1, len(first) - 1)]
