"""Exact substring dedup over bytes by sorted suffixes.

Suffixes are taken where a window of `width` bytes has its anchor (see repeats), so every repeated string of `width` bytes
holds such a suffix at the same place in each of its occurrences. Splitters that Spark samples range-partition the
suffixes by their leading bytes (then by place, so that equal ones, however many, spread over several buckets). A bucket sorts its suffixes by multikey quicksort, eight bytes at a time, and neighbours that are equal, with what
stands before them, are repeats. Of suffixes that only begin alike, all strings of `width` bytes around them
are sorted in the same way. A bucket's first and last anchor may go on in the buckets beside it: their strings are compared
across the boundaries, by digests of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import MASKS, U, slices, utf8
from metriclake.llm.repeats import Kind, asked_blocks, judged, located, packed, rows_of, unpacked
from metriclake.llm.shared import shuffle_partitions, written

#: Bytes of an anchor; longer anchors mean more suffixes.
GRAM = 16
#: Suffixes of a bucket at most, about; a bucket is sorted in memory.
BUCKET = 40_000
#: Leading bytes by which suffixes are dealt into buckets; those with the same are dealt by their places.
LEADING = 64
#: more: places of further blocks of the same document with the same bytes (many where a text is periodic).
SUFFIXES = "suffix binary, before binary, doc long, h long, place long, more array<long>"
#: A repeated span (digest is null), or a string to compare across buckets, for weight places.
SORTED = "doc long, h long, first long, last long, digest binary, weight int"


def dedup(documents: DataFrame, width: int = 200) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary.

    Every byte that a string of `width` bytes covers which also starts anywhere else, in any row, is
    removed. A null text has no bytes; matches never cross rows; a row that is repeated whole is a repeat
    of itself. A null doc_id stays null. What is kept may end inside a character, so it is binary.
    Other columns are not read.
    """
    kind = Kind("bytes", width, max(1, min(GRAM, width), width - 254))
    dealt, asked, n = located(rows_of(documents), kind)
    buckets = max(2 * shuffle_partitions(documents.sparkSession), -(-n // BUCKET))
    suffixes = asked.select("doc", "h", "text", "asked").mapInArrow(lambda it: _suffixes(it, kind), SUFFIXES)
    ranged = suffixes.repartitionByRange(buckets, F.substring("suffix", 1, LEADING), "doc", "h", "place")
    found = written(ranged.mapInArrow(lambda it: _sorted(it, kind), SORTED), "suffixes")
    strings = found.filter("digest IS NOT NULL")
    times = strings.groupBy("digest").agg(F.sum("weight").alias("times")).filter("times > 1")
    again = strings.filter("weight = 1").join(times, "digest").select("doc", "h", "first", "last")
    spans = found.filter("digest IS NULL").select("doc", "h", "first", "last").unionByName(again)
    return judged(dealt, spans, kind, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _suffixes(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """For each asked block of rows (doc, h, text, asked): its bytes from the anchor on, and those before it, reversed."""
    for batch in slices(batches, text=2):
        of, first, count, off = asked_blocks(batch.column(3))
        place = packed(first, count, off)
        data, offsets = utf8(batch.column(2))
        raw = data.tobytes()
        begin = offsets[of] + first
        anchor, end = begin + off, np.minimum(begin + count + kind.width - 1, offsets[of + 1])
        after = [raw[a:b] for a, b in zip(anchor.tolist(), end.tolist(), strict=True)]
        before = [raw[a:b][::-1] for a, b in zip(begin.tolist(), anchor.tolist(), strict=True)]
        seen: dict[tuple[int, bytes, bytes], int] = {}
        more: dict[int, list[int]] = {}
        for i, key in enumerate(zip(of.tolist(), after, before, strict=True)):
            j = seen.setdefault(key, i)
            if j != i:
                more.setdefault(j, []).append(int(place[i]))
        one = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
        for i in range(0, len(one), 20_000):
            part = one[i : i + 20_000]
            at = part.tolist()
            row = pa.array(of[part])
            out = [pa.array([after[k] for k in at], pa.binary()), pa.array([before[k] for k in at], pa.binary()), batch.column(0).take(row), batch.column(1).take(row), pa.array(place[part]), pa.array([more.get(k) for k in at], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in SUFFIXES.split(", ")])


class Strings:
    """Strings in one array of bytes, by their starts and ends."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))  # the eight bytes from each place
        self.start, self.end = start, end
        self.longest = int((end - start).max(initial=0))

    @staticmethod
    def of(column: pa.Array) -> Strings:
        data, offsets = utf8(column)
        return Strings(data, offsets[:-1], offsets[1:])

    def key(self, which: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes at depth of these strings; what is beyond the end counts as 0."""
        at = self.start[which] + depth
        left = np.clip(self.end[which] - at, 0, 8)
        return self.words[np.minimum(at, len(self.words) - 1)].astype(U) & ~MASKS[8 - left]


def multikey(strings: Strings, order: np.ndarray, head: np.ndarray) -> None:
    """Multikey quicksort: sort the strings numbered in order, in each of the groups that begin where head is set, and
    set head where a string begins that differs from the one before it.

    At each depth only groups of strings that are equal so far are sorted on, by their next eight bytes, and
    split; strings that differ by length alone are told apart at the end.
    """
    depth = 0
    while True:
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return
        group = np.cumsum(head)[at]
        own = order[at]
        last = depth >= strings.longest
        key = (strings.end[own] - strings.start[own]).astype(U) if last else strings.key(own, depth)
        by = np.lexsort((key, group))
        order[at] = own[by]
        key, group = key[by], group[by]
        split = np.flatnonzero((key[1:] != key[:-1]) & (group[1:] == group[:-1])) + 1
        head[at[split]] = True
        if last:
            return
        depth += 8


def _sorted(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """What a bucket of suffixes tells of repeats; see SORTED."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    suffix, before = (table.column(i).combine_chunks() for i in (0, 1))
    doc, h, place = (table.column(i).to_numpy() for i in (2, 3, 4))
    first, count, off = unpacked(place)
    width, n = kind.width, len(doc)
    order, head = np.arange(n), np.zeros(n, dtype=bool)
    head[0] = True
    after = Strings.of(suffix)
    multikey(after, order, head)
    multikey(Strings.of(before), order, head)  # now each run is one block, with the same bytes on both sides
    # anchors: neighbours whose first bytes are the same
    anchor = np.ones(n, dtype=bool)
    same = np.ones(n - 1, dtype=bool)
    for depth in range(0, kind.gram, 8):
        key = after.key(order, depth) & ~MASKS[8 - min(8, kind.gram - depth)]
        same &= key[1:] == key[:-1]
    anchor[1:] = ~same
    group = np.cumsum(anchor) - 1
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, n))
    lists = table.column(5).combine_chunks()
    others = np.diff(np.asarray(lists.offsets)) if lists.null_count < n else np.zeros(n, np.int64)
    several = np.repeat(np.add.reduceat(1 + others[order], start) > 1, size)  # of each suffix in order
    sure = order[several]
    yield from _rows(doc[sure], h[sure], first[sure], first[sure] + count[sure] - 1 + width)
    if others.any():
        of = np.repeat(np.arange(n), others)
        f, c, _ = unpacked(lists.flatten().to_numpy())
        yield from _rows(doc[of], h[of], f, f + c - 1 + width)
    # one of each block stands for all of them
    stands, weight, of = order[start], np.where(several[start], 2, 1).astype(np.int32), group[start]
    blocks = np.bincount(of)
    border = (of == 0) | (of == of[-1])
    found = (doc, h, first, count, off)
    for part in _parts(np.flatnonzero(border), of):
        yield from _strings(part, stands[part], weight[part], of[part], suffix, before, found, width, True)
    for part in _parts(np.flatnonzero(~border & (blocks[of] > 1)), of):
        yield from _strings(part, stands[part], weight[part], of[part], suffix, before, found, width, False)


def _rows(doc, h, first, last, digest: list[bytes] | None = None, weight: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    if len(doc):
        columns = [*[pa.array(x, pa.int64()) for x in (doc, h, first, last)], pa.array(digest or [None] * len(doc), pa.binary()), pa.array(np.zeros(len(doc)) if weight is None else weight, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SORTED.split(", ")])


def _parts(mine: np.ndarray, of: np.ndarray, most: int = 2000) -> list[np.ndarray]:
    """The blocks in parts of about `most`, of which none splits a group of `of`."""
    parts, begin = [], 0
    for end in [*(np.flatnonzero(np.diff(of[mine])) + 1).tolist(), len(mine)]:
        if end - begin >= most or (end == len(mine) and end > begin):
            parts.append(mine[begin:end])
            begin = end
    return parts


def _strings(part, stands, weight, group, suffix, before, found, width: int, border: bool) -> Iterator[pa.RecordBatch]:
    """Strings of `width` bytes of these blocks that two blocks of a group have, as spans; of a bucket's first and last
    group also each different string with its digest, to be compared across buckets."""
    doc, h, first, count, off = found
    content = [(before[i].as_py() or b"")[::-1] + (suffix[i].as_py() or b"") for i in stands.tolist()]
    lengths = np.fromiter(map(len, content), dtype=np.int64, count=len(content))
    many = np.minimum(count[stands], np.maximum(lengths - width + 1, 0))
    block = np.repeat(np.arange(len(stands)), many)
    k = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(np.cumsum(lengths) - lengths, many) + k
    raw = b"".join(content)
    aligned = off[stands][block] - k  # how far the anchor is from the string's start: equal in equal strings
    order = np.lexsort((aligned, group[block]))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (aligned[order][1:] != aligned[order][:-1]) | (group[block][order][1:] != group[block][order][:-1])
    multikey(Strings(np.frombuffer(raw, np.uint8), begin, begin + width), order, head)
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(order)))
    again = order[np.repeat(size > 1, size)]
    chosen = np.sort(again[weight[block[again]] == 1])
    row = stands[block[chosen]]
    at = first[row] + k[chosen]
    if len(at):  # strings in a row are one span
        new = np.ones(len(at), dtype=bool)
        new[1:] = (block[chosen][1:] != block[chosen][:-1]) | (at[1:] != at[:-1] + 1)
        low, high = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
        yield from _rows(doc[row[low]], h[row[low]], at[low], at[high] + width)
    if border:  # one of each string stands for all of them here
        from xxhash import xxh3_128_digest

        one = order[start]
        times = np.where(size > 1, 2, weight[block[one]])
        row = stands[block[one]]
        at = first[row] + k[one]
        yield from _rows(doc[row], h[row], at, at + width, [xxh3_128_digest(raw[a : a + width]) for a in begin[one].tolist()], times)


def _cut(batch: pa.RecordBatch, borders: np.ndarray, mask: np.ndarray) -> list[pa.Array]:
    new = mask.copy()
    new[1:] &= ~mask[:-1]
    at = borders[:-1][borders[:-1] < len(mask)]
    new[at] = mask[at]
    sums, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (mask, new))
    removed, n_spans = (x[borders[1:]] - x[borders[:-1]] for x in (sums, runs))
    kept = [
        np.frombuffer(x, np.uint8)[~mask[a:b]].tobytes() if n else x or b""
        for x, a, b, n in zip(batch.column(2).cast(pa.large_binary()).to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), removed.tolist(), strict=True)
    ]
    return [batch.column(0), pa.array(np.diff(borders)), pa.array(removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())]
