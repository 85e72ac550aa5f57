"""Benchmark decontamination with a BM25 inverted index of test items and block-max WAND.

An item is found in a document if some run of words, PASSAGE times as long as the item, holds the given shares of
its word shingles and of those of its question and its answer. So nothing depends on other items, on how items
are dealt into indexes or on where passages begin.

Documents are cut into overlapping passages, long enough for every such run of an item's length class. Each
passage queries the index for all items whose score reaches the item's own threshold, the score that a passage
must have if it holds the share of the item's shingles. Items are numbered by threshold and postings cut into
blocks with their greatest weight. One product over a batch tells which passages can reach a threshold in some block
of items at all; those are searched with a cursor per term, which skip by pivots and block maxima. What is
retrieved is verified run by run.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import U, folded_words, slices, window_hashes

SHINGLE = 5
#: Items of one index, and indexes that are sent to all tasks at once; more items take more passes over the documents.
ITEMS, INDEXES = 2048, 8
#: Items in a block of items, and postings in a block of postings.
BLOCK = 4
#: A share of the item's shingles, and of those of its question and its answer, must stand in the run.
OVERLAP, PART_OVERLAP = 0.8, 0.5
#: Words of the run, for each word of the item; items of one length class differ by less than RATIO in length.
PASSAGE, RATIO = 1.5, 2
K1, B = 1.2, 0.75
SLACK = 1e-2  # for sums in single precision
HITS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence or line, if it and the rest have five words."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s+|\n", text)]
    for at in reversed(ends):
        if len(text[at:].split()) >= SHINGLE and len(text[:at].split()) >= SHINGLE:
            return text[:at], text[at:]
    return text, ""


class Item:
    """An item's words, and its different shingles with those of its question and answer.

    An item under five words is one shingle. A part under five words (marks don't count) is not asked for.
    """

    def __init__(self, number: int, text: str) -> None:
        words, first = folded_words(pa.array([text, split_item(text)[0]]))
        self.id = number
        self.words = words[: first[1]]
        asked = int(first[2] - first[1])
        self.width = min(SHINGLE, len(self.words))
        hashes = window_hashes(self.words, self.width) if self.width else self.words
        self.shingles, inverse = np.unique(hashes, return_inverse=True)
        question, answer = np.zeros(len(self.shingles), dtype=bool), np.zeros(len(self.shingles), dtype=bool)
        question[inverse[: max(0, asked - SHINGLE + 1)]] = True
        answer[inverse[asked:]] = True
        self.parts = np.vstack([np.ones(len(self.shingles), dtype=bool), question, answer])
        self.total = self.parts.sum(axis=1)
        self.least_shingles = int(np.ceil(OVERLAP * len(self.shingles) - 1e-9))
        self.run = max(int(PASSAGE * len(self.words)), self.width)

    def verify(self, words: np.ndarray) -> tuple[float, float, float, int] | None:
        """(overlap, of the question, of the answer, first word) of the run with most shingles, the first of
        equals, among those with enough of all parts."""
        if len(words) < self.width:
            return None
        hashes = window_hashes(words, self.width)
        kind = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        at = np.flatnonzero(self.shingles[kind] == hashes)
        if len(np.unique(kind[at])) < self.least_shingles:
            return None
        kind = kind[at]
        at_list, kind_list = at.tolist(), kind.tolist()
        belongs = self.parts.T.astype(np.int64).tolist()
        count, held, low, best = [0] * len(self.shingles), [0, 0, 0], 0, None
        for place, k in zip(at_list, kind_list, strict=True):
            if not count[k]:
                held = [a + b for a, b in zip(held, belongs[k], strict=True)]
            count[k] += 1
            while place - at_list[low] > self.run - self.width:
                out = kind_list[low]
                count[out] -= 1
                if not count[out]:
                    held = [a - b for a, b in zip(held, belongs[out], strict=True)]
                low += 1
            if held[0] >= self.least_shingles and (best is None or held[0] > best[0][0]) and all(h >= PART_OVERLAP * t for h, t in zip(held[1:], self.total[1:].tolist(), strict=True)):
                best = (held.copy(), at_list[low])
        if best is None:
            return None
        shares = [h / t if t else 1.0 for h, t in zip(best[0], self.total.tolist(), strict=True)]
        return (*shares, best[1])


class Index:
    """Postings of items of one length class: per term the items' numbers and weights, in blocks with their greatest."""

    def __init__(self, items: list[Item], length: int, frequency: dict[int, int], n_items: int, mean: float) -> None:
        self.step = int(np.ceil(PASSAGE * length))
        self.terms = np.unique(np.concatenate([x.words for x in items]))
        df = np.array([frequency[t] for t in self.terms.tolist()])
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        found = []
        for x in items:
            terms, tf = np.unique(x.words, return_counts=True)
            at = np.searchsorted(self.terms, terms)
            weight = (idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x.words) / mean))).astype(np.float32)
            # with m shingles short of all, at most m terms are missing, the heaviest at worst
            missing = len(x.shingles) - x.least_shingles
            found.append((float(weight.sum() - np.sort(weight)[::-1][:missing].sum()), x.id, at, weight, x))
        found.sort(key=lambda x: x[:2])  # numbers ascend with thresholds
        self.items = [x[4] for x in found]
        self.least = [x[0] - SLACK for x in found]
        term = np.concatenate([x[2] for x in found])
        number = np.repeat(np.arange(len(found)), [len(x[2]) for x in found])
        weight = np.concatenate([x[3] for x in found])
        order = np.lexsort((number, term))
        self.number, self.weight = number[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        blocks = -(-len(found) // BLOCK)
        self.greatest = np.zeros((len(self.terms), blocks), dtype=np.float32)
        np.maximum.at(self.greatest, (term, number // BLOCK), weight)
        self.least_of_block = np.array(self.least[::BLOCK], dtype=np.float32)
        self.lists: dict[int, tuple[list[int], list[float], list[float]]] = {}

    def posting(self, term: int) -> tuple[list[int], list[float], list[float]]:
        """(numbers, weights, greatest weight of each block of postings) of a term."""
        if term not in self.lists:
            number, weight = self.number[self.first[term] : self.first[term + 1]], self.weight[self.first[term] : self.first[term + 1]]
            self.lists[term] = (number.tolist(), weight.tolist(), np.maximum.reduceat(weight, np.arange(0, len(weight), BLOCK)).tolist())
        return self.lists[term]

    def wand(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """(item number, score) of all items that reach their thresholds, by block-max WAND."""
        # of each term: the item under the cursor, numbers, weights, block maxima, greatest weight, cursor
        cursors = [[p[0][0], *p, float(self.most[t]), 0] for t in terms for p in (self.posting(t),)]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= self.least[c[0]]:  # thresholds ascend, so no item before this one can reach its own
                    pivot = k
                    break
            if pivot < 0:
                return
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            if cursors[0][0] == at:
                ahead = at + 1
                if sum(c[3][c[5] // BLOCK] for c in cursors[: pivot + 1]) >= self.least[at]:
                    score = sum(c[2][c[5]] for c in cursors[: pivot + 1])
                    if score >= self.least[at]:
                        yield at, score
                else:  # no item of these blocks, up to where the first of them ends or another term comes in
                    ends = [c[1][min(len(c[1]), (c[5] // BLOCK + 1) * BLOCK) - 1] for c in cursors[: pivot + 1]]
                    ahead = max(ahead, min([e + 1 for e in ends] + [c[0] for c in cursors[pivot + 1 : pivot + 2]]))
            else:
                ahead = at
            for c in cursors[: pivot + 1]:
                if c[0] < ahead:
                    c[5] = bisect_left(c[1], ahead, c[5])
                    c[0] = c[1][c[5]] if c[5] < len(c[1]) else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, score, first word, end) of passages over the items' thresholds."""
        if not len(words):
            return
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words)  # other words have no postings
        step = self.step
        lengths = np.diff(first)
        per = np.maximum(1, -(-lengths // step) - 1) * (lengths > 0)
        doc = np.repeat(np.arange(len(per)), per)
        begin = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(begin + 2 * step, first[doc + 1])
        low, high = np.searchsorted(hit, begin), np.searchsorted(hit, end)
        passage = np.repeat(np.arange(len(begin)), high - low)
        if not len(passage):
            return
        place = np.arange(len(passage)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        pair = np.unique(passage * len(self.terms) + at[hit[place]])  # each term of a query once
        passage, term = pair // len(self.terms), pair % len(self.terms)
        start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        stop = np.append(start[1:], len(term))
        opened = (np.add.reduceat(self.greatest[term], start, axis=0) >= self.least_of_block).any(axis=1)
        for k in np.flatnonzero(opened).tolist():
            p = int(passage[start[k]])
            for item, score in self.wand(term[start[k] : stop[k]].tolist()):
                yield int(doc[p]), item, score, int(begin[p]), int(end[p])


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _indexes(benchmark: DataFrame) -> list[list[Index]]:
    """Indexes of all items with a word, in groups for one pass each. Document frequencies are of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    parts = max(1, -(-items.count() // ITEMS))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, first = folded_words(batch.column(1))
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.unique(words[a:b]).view(np.int64), 0)), pa.array(np.append(np.zeros(len(np.unique(words[a:b])), np.int64), b - a))], names=["term", "n"])

    counted = items.mapInArrow(terms, "term long, n long")
    total = counted.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    n, mean = total["n"], (total["words"] or 0) / max(1, total["n"])
    counts = counted.filter("n = 0").groupBy("term").agg(F.count("*").alias("df"))
    groups: list[list[Index]] = [[] for _ in range(-(-parts // INDEXES))]
    for k in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        found = [x for x in (Item(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()) if len(x.words)]
        if not found:
            continue
        wanted = documents_frequency(counts, np.unique(np.concatenate([x.words for x in found])))
        classes: dict[int, list[Item]] = {}
        for x in found:
            length = 8
            while length < len(x.words):
                length *= RATIO
            classes.setdefault(length, []).append(x)
        groups[k // INDEXES] += [Index(own, length, wanted, n, mean) for length, own in sorted(classes.items())]
    return [g for g in groups if g]


def documents_frequency(counts: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many items each of an index's terms stands."""
    own = counts.sparkSession.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term long")
    return {int(np.int64(r["term"]).view(U)): r["df"] for r in counts.join(F.broadcast(own), "term").collect()}


def _found(indexes: list[Index], words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int, int], tuple]:
    """(document, index, item) -> (overlap, score, of the question, of the answer, first word), the best each."""
    best: dict[tuple[int, int, int], tuple] = {}
    for i, index in enumerate(indexes):
        for doc, item, score, begin, end in index.search(words, first):
            got = index.items[item].verify(words[begin:end])
            if got and (got[0], score) > best.get((doc, i, item), (0.0, 0.0))[:2]:
                best[doc, i, item] = (got[0], score, got[1], got[2], begin - int(first[doc]) + got[3])
    return best


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item found in it, with the best run of words (most overlap, then first).

    documents (doc_id, text), benchmark (item_id, text). Words are compared without case (A-Z) and marks.
    An item is found in a run of PASSAGE times its words that holds at least OVERLAP of its different five-word
    shingles (PART_OVERLAP of its question's and of its answer's); an item of fewer words is one shingle; an item
    without words is never found. Null texts have no words; repeated items and rows are each found.
    """
    spark = documents.sparkSession
    found = None
    for indexes in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(indexes)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                best = _found(shared.value, *folded_words(batch.column(1)))
                if best:
                    ids = batch.column(0).take(pa.array([d for d, _, _ in best]))
                    values = list(best.values())
                    numbers = pa.array([shared.value[i].items[k].id for _, i, k in best], pa.int64())
                    out = [ids, numbers, *[pa.array([float(v[c]) for v in values]) for c in (1, 0, 2, 3)], pa.array([v[4] for v in values], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in HITS.split(", ")])

        part = _rows(documents).mapInArrow(search, HITS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], HITS)


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows in which an item was found; all columns and other rows stay. Rows are judged
    where they are, without a shuffle or a key."""
    columns, kinds = list(documents.columns), [kind for _, kind in documents.dtypes]
    names = [f"c{i}" for i in range(len(columns))]
    rows = documents.toDF(*names)
    for indexes in _indexes(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(indexes)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text=0):
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, _, _ in _found(shared.value, *folded_words(batch.column(0)))]] = False
                yield batch.select(range(1, batch.num_columns)).filter(pa.array(keep))

        text = F.col(names[columns.index("text")]).cast("string").alias("text")
        rows = rows.select(text, *names).mapInArrow(clean, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return rows.toDF(*columns)
