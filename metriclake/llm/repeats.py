"""Where documents may repeat each other: what substring dedup by Relative Lempel-Ziv factors and by sorted
suffixes have in common.

A window is `width` consecutive units (words or bytes). Its anchor is its smallest gram, so equal windows hold equal
anchors at equal places, and neighbouring windows with one anchor form a block. At least half of what a window has besides
its anchor stands on one side of it, so blocks are halved by that side, and a half whose anchor and context on that side
stand nowhere else in the corpus, by their hash, repeats nothing: it is left out before any text moves. What is left is
only a superset: the two operators decide by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import BYTE_CODES, Levels, mix, segments, signed, slices, utf8, word_hashes, words
from metriclake.llm.shared import shuffle_partitions, written

#: A null doc_id counts as smaller than any other.
NO_ID = -(1 << 63)
ANCHORS = "context long, doc long, h long, place long"


@dataclass(frozen=True)
class Kind:
    """What a unit is, how long a repeat must be, and how long an anchor is."""

    unit: str  # "words" or "bytes"
    width: int
    gram: int

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.width or self.width - self.gram > 254:
            raise ValueError("an anchor has 1 to width units, and at least width - 254")

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(codes, borders of the documents among them)."""
        data, offsets = utf8(column)
        if self.unit == "bytes":
            return BYTE_CODES[data], offsets
        start, end, first = words(data, offsets)
        return word_hashes(data, start, end), first


def rows_of(documents: DataFrame) -> DataFrame:
    """doc, h, text: rows with one doc_id are told apart by h, a hash of their texts."""
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def packed(first: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A block's place in its document: its first window, its windows, and how far its anchor is from the first."""
    return (first << 16) | (count << 8) | off


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 0xFF, place & 0xFF


def halves(levels: Levels, borders: np.ndarray, found: dict[str, np.ndarray], kind: Kind) -> tuple[np.ndarray, ...]:
    """(context, doc, place) of the halves of blocks: windows with at least `back` units before the anchor, then others."""
    back = (kind.width - kind.gram + 1) // 2
    on = kind.width - back + 1  # of the others, what stands from the anchor on
    first, count, off = found["first"], found["count"], found["anchor_at"] - found["first"]
    at = borders[found["doc"]] + found["anchor_at"]
    left, right = off >= back, off - count + 1 < back
    skipped = np.maximum(0, off - back + 1)[right]
    context = [mix(levels.at(at[left] - back, back + kind.gram)), levels.at(at[right], on)]
    place = [packed(first[left], np.minimum(count, off - back + 1)[left], off[left]), packed(first[right] + skipped, count[right] - skipped, off[right] - skipped)]
    return np.concatenate(context), np.concatenate([found["doc"][left], found["doc"][right]]), np.concatenate(place)


def anchors(rows: DataFrame, kind: Kind) -> DataFrame:
    """One row per half of a block of rows (doc, h, text): the hash of its context, doc, h, and its place."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            codes, borders = kind.codes(batch.column(2))
            levels = Levels(codes)
            found = segments(levels, borders, kind.width, kind.gram)
            if len(found["doc"]):
                context, of, place = halves(levels, borders, found, kind)
                doc, h = (batch.column(i).to_numpy(zero_copy_only=False)[of] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(context), doc, h, place)], names=["context", "doc", "h", "place"])

    return rows.mapInArrow(blocks, ANCHORS)


def asked_blocks(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, count, off) of the blocks that lists of places ask for; halves of one block are one again."""
    of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    first, count, off = unpacked(lists.flatten().to_numpy(zero_copy_only=False))
    order = np.lexsort((first, of))
    of, first, count, off = of[order], first[order], count[order], off[order]
    on = np.zeros(len(of), dtype=bool)  # the other half of the one before
    on[1:] = (of[1:] == of[:-1]) & (first[1:] == first[:-1] + count[:-1]) & (first[1:] + off[1:] == first[:-1] + off[:-1])
    start = np.flatnonzero(~on)
    return of[start], first[start], np.add.reduceat(count, start) if len(start) else count, off[start]


def shared(found: DataFrame) -> DataFrame:
    """doc, h, place of the halves of blocks (context, doc, h, place) whose context is there twice or more.

    They are range-partitioned with their places, so that one that stands everywhere takes several tasks, and
    compared with their neighbours. A task's first and last context, whose equals may be in the tasks beside it, stay.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, pending = None, None, None  # the last row of the batch before, and whether it stays for what stands before it
        for batch in batches:
            if not batch.num_rows:
                continue
            context = batch.column(0).to_numpy()
            first = context[0] if first is None else first
            same = np.zeros(len(context) + 1, dtype=bool)  # of each row, whether the one before it is equal
            same[1:-1] = context[1:] == context[:-1]
            same[0] = last is not None and context[0] == last.column(0)[0].as_py()
            if last is not None and (pending or same[0]):
                yield last.select([1, 2, 3])
            stays = same[:-1] | same[1:] | (context == first)
            stays, pending = stays.copy(), bool(stays[-1])
            last = batch.slice(len(context) - 1)
            stays[-1] = False
            if stays.any():
                yield batch.select([1, 2, 3]).filter(pa.array(stays))
        if last is not None:
            yield last.select([1, 2, 3])

    keys = ["context", "doc", "h", "place"]
    dealt = found.repartitionByRange(2 * shuffle_partitions(found.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(kept, "doc long, h long, place long")


def located(rows: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame, int]:
    """(rows dealt by document; those with `asked`, the list of places that may be repeats; the number of these).

    The dealt rows are the only shuffle of texts; a plan that joins them again by doc and h reuses it.
    """
    many = written(shared(anchors(rows, kind)), "anchors")
    asked = many.groupBy("doc", "h").agg(F.collect_set("place").alias("asked"))
    dealt = rows.repartition("doc", "h")
    return dealt, dealt.join(asked, ["doc", "h"]), many.count()


Judge = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]]


def judged(dealt: DataFrame, found: DataFrame, kind: Kind, judge: Judge, schema: str) -> DataFrame:
    """What judge makes of each batch (doc, h, text, spans), the borders of its documents and which units the
    spans (doc, h, first, last; in units, half-open, overlapping) cover. A document has no more of them than windows."""
    lists = found.groupBy("doc", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2):
            borders = kind.codes(batch.column(2))[1] if kind.unit == "words" else utf8(batch.column(2))[1]
            yield pa.RecordBatch.from_arrays(judge(batch, borders, covered(batch.column(3), borders)), names=[c.split()[0] for c in schema.split(", ")])

    out = dealt.join(lists, ["doc", "h"], "left").select("doc", "h", "text", "spans").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def covered(lists: pa.ListArray, borders: np.ndarray) -> np.ndarray:
    """Which units of a batch the lists of spans cover; a missing list covers none."""
    change = np.zeros(int(borders[-1]) + 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    flat = lists.flatten()
    if len(flat):
        first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        np.add.at(change, borders[doc] + first, 1)
        np.add.at(change, borders[doc] + last, -1)
    return np.cumsum(change)[:-1] > 0
