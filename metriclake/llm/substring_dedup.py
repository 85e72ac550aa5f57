"""Substring dedup by Relative Lempel-Ziv parsing: documents are factored against blocks of earlier documents.

The reference is the corpus itself. Its blocks (see repeats) are indexed by their anchors and sorted by anchor,
then doc_id. A block is parsed greedily against the indexed blocks of its anchor: from each window on, the reference
with the longest match gives a factor, compared word by word; the parse goes on at the first window that the factor
doesn't hold. Factors of `width` words and more are duplicate spans. Windows at their borders, which no indexed block
holds whole, are checked one by one: by digests of 128 bits against such windows of all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import U, signed, slices
from metriclake.llm.repeats import Kind, asked_blocks, judged, located, packed, rows_of
from metriclake.llm.shared import shuffle_partitions, written

#: Words of an anchor; longer anchors mean more blocks and fewer windows to check at borders.
GRAM = 12
#: Blocks of one anchor that a task parses against; what none of them holds goes to the check of windows.
REFERENCES = 8
BLOCKS = "anchor long, doc long, h long, place long, words binary"
#: Rows that a task holds before it gives them on.
HELD = 5_000
#: Different windows of one anchor that a task remembers; a further one is only compared with those of all tasks.
SEEN = 50_000
#: A duplicate span (digest is null), or a window to check: its digest and its first word.
PARSED = "doc long, h long, first long, last long, digest binary"


def factors(documents: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, factor number, first_word, n_words: the disjoint runs of words that factors of `width` words
    or more cover, in order. Documents without such a run have no row."""
    return _parsed(documents, width, "doc_id long, factor int, first_word long, n_words long", _runs)


def dedup(documents: DataFrame, width: int = 50) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are separated by ASCII white space and compared as they are. A null text has no words. A null
    doc_id counts as smallest. Rows with equal doc_id don't make each other's words repeats, and rows that
    are repeated whole come out as often as they went in. Other columns are not read.
    """
    return _parsed(documents, width, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", _kept)


def _parsed(documents: DataFrame, width: int, schema: str, judge) -> DataFrame:
    kind = Kind("words", width, max(min(GRAM, width), width - 254))
    dealt, asked, _ = located(rows_of(documents), kind)
    blocks = asked.select("doc", "h", "text", "asked").mapInArrow(lambda it: _blocks(it, kind), BLOCKS)
    keys = ["anchor", "doc", "h", "place"]
    indexed = blocks.repartitionByRange(2 * shuffle_partitions(documents.sparkSession), *keys).sortWithinPartitions(*keys)
    found = written(indexed.mapInArrow(lambda it: _factored(it, width), PARSED), "factors")
    windows = found.filter("digest IS NOT NULL")
    least = windows.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    again = windows.join(least, "digest").filter("doc > least").select("doc", "h", "first", "last")
    return judged(dealt, found.filter("digest IS NULL").select("doc", "h", "first", "last").unionByName(again), kind, judge, schema)


def _blocks(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The words of the asked blocks of rows (doc, h, text, asked), joined by spaces, and a hash of their anchors."""
    from xxhash import xxh64_intdigest

    for batch in slices(batches, text=2):
        of, first, count, off = asked_blocks(batch.column(3))
        split = [(t or b"").split() for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
        content, anchor = [], np.zeros(len(of), dtype=U)
        for i, (d, a, n, o) in enumerate(zip(of.tolist(), first.tolist(), count.tolist(), off.tolist(), strict=True)):
            words = split[d]
            content.append(b" ".join(words[a : a + n + kind.width - 1]))
            anchor[i] = xxh64_intdigest(b" ".join(words[a + o : a + o + kind.gram]))
        at = pa.array(of)
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), batch.column(0).take(at), batch.column(1).take(at), pa.array(packed(first, count, off)), pa.array(content, pa.binary())], names=[c.split()[0] for c in BLOCKS.split(", ")])


class Block:
    """A block's words, as bytes before its anchor (reversed) and from it on."""

    def __init__(self, doc: int, h: int, place: int, words: bytes) -> None:
        self.doc, self.h, self.words = doc, h, words
        self.first, self.count, self.off = place >> 16, (place >> 8) & 0xFF, place & 0xFF
        at = np.concatenate(([0], np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1, [len(words) + 1]))
        self.starts = at.tolist()  # of each word, and the end
        cut = self.starts[self.off]
        self.before, self.after = words[:cut][::-1], words[cut:] + b" "  # each word with the space on its outer side


def common_words(a: bytes, b: bytes) -> int:
    """How many whole words a and b begin with in common; each word has its space at the far end."""
    if a == b:
        return a.count(b" ")
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return a.count(b" ", 0, int(apart[0]) if len(apart) else n)


def parse(block: Block, references: list[Block], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(factors (first window, last window), windows that no factor holds) of a block, greedily.

    A reference matches around the anchor, so it holds the windows from where its match begins to where it ends.
    """
    if any(r.before == block.before and r.after == block.after for r in references):
        return [(0, block.count - 1)], []
    reach = []
    for r in references:
        back, on = _back(block.before, r.before), common_words(block.after, r.after)
        reach.append((block.off - back, block.off + on - width))  # first and last window in the match
    found, left, s = [], [], 0
    while s < block.count:
        last = max((b for a, b in reach if a <= s), default=-1)
        if last >= s:
            found.append((s, min(last, block.count - 1)))
            s = last + 1
        else:
            left.append(s)
            s += 1
    return found, left


def _back(a: bytes, b: bytes) -> int:
    """How many whole words two reversed beginnings have in common; a word ends at the next space or at the end."""
    if not a or not b:
        return 0
    return common_words(a[1:] + b" ", b[1:] + b" ")


def _factored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parse blocks that come sorted by anchor, then doc.

    A task's first and last anchor may go on in the tasks beside it: of the first, windows of blocks of the first
    doc_id here are checked too, and of both those of the first reference, so that each task sees the others'.
    """
    from xxhash import xxh3_128_digest

    out: list[tuple[int, int, int, int, bytes | None]] = []

    def spans(block: Block, found: list[tuple[int, int]]) -> None:
        out.extend((block.doc, block.h, block.first + a, block.first + b + width, None) for a, b in found)

    def windows(block: Block, left) -> None:
        for s in left:
            digest = xxh3_128_digest(block.words[block.starts[s] : block.starts[s + width] - 1])
            if seen.get(digest, block.doc) < block.doc:  # the first one here was given on for all of them
                digest = None
            elif digest not in seen and len(seen) < SEEN:
                seen[digest] = block.doc
            out.append((block.doc, block.h, block.first + s, block.first + s + width, digest))

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PARSED.split(", ")])
        out.clear()
        return done

    anchor, start, references = None, None, []
    seen: dict[bytes, int] = {}  # windows given on, of this anchor, with the first doc
    for got in batches:
        for key, doc, h, place, words in zip(*[got.column(i).to_pylist() for i in range(5)], strict=True):
            if len(out) >= HELD:
                yield batch()
            if key == anchor and doc != references[0].doc and place & 0xFF == references[0].off and words == references[0].words:
                out.append((doc, h, place >> 16, (place >> 16) + ((place >> 8) & 0xFF) - 1 + width, None))
                continue  # the common case: the whole block is a factor
            block = Block(doc, h, place, words)
            if start is None:
                start = key
            if key != anchor:
                anchor, references = key, [block]
                seen.clear()
                if key == start:
                    windows(block, range(block.count))
                continue
            lead = references[0]
            if doc == lead.doc:  # no smaller doc_id here has the anchor
                if key == start:
                    windows(block, range(block.count))
                else:
                    windows(block, parse(block, [lead], width)[1])
                continue
            found, left = parse(block, [r for r in references if r.doc < doc], width)
            spans(block, found)
            windows(block, left)
            if left and len(references) < REFERENCES:
                references.append(block)
        if out:
            yield batch()
    if references and anchor != start:
        windows(references[0], range(references[0].count))
        yield batch()


def _kept(batch: pa.RecordBatch, borders: np.ndarray, mask: np.ndarray) -> list[pa.Array]:
    sums = np.concatenate([[0], np.cumsum(mask)])
    removed = sums[borders[1:]] - sums[borders[:-1]]
    kept = []
    for text, a, b, n in zip(batch.column(2).cast(pa.large_binary()).to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), removed.tolist(), strict=True):
        found = (text or b"").split()
        kept.append(b" ".join(compress(found, ~mask[a:b]) if n else found))
    return [batch.column(0), pa.array(np.diff(borders)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())]


def _runs(batch: pa.RecordBatch, borders: np.ndarray, mask: np.ndarray) -> list[pa.Array]:
    first = np.zeros(len(mask), dtype=bool)
    first[borders[:-1][borders[:-1] < len(mask)]] = True
    begin = np.flatnonzero(mask & (first | ~np.concatenate([[False], mask[:-1]])))
    end = np.flatnonzero(mask & np.concatenate([first[1:] | ~mask[1:], [True]])) + 1 if len(mask) else begin
    doc = np.searchsorted(borders, begin, "right") - 1
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return [batch.column(0).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(begin - borders[doc]), pa.array(end - begin)]
