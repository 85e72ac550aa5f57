"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Every document is tokenised once; only documents over the capacity are cut. What is to be packed is then
known from a histogram with at most `capacity` rows, and so is the plan: each step fills one sequence
greedily with the longest pieces that fit, swaps its smallest piece for two unpacked ones that fill the
widened gap more tightly, and repeats that pattern as often as the counts allow. Each step uses up at least
one length, so a plan has at most `capacity` patterns, however many documents there are. Spark numbers the
pieces of each length and reads their places from the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metriclake.llm.arrays import slices
from metriclake.llm.encoder import Encoder, with_end
from metriclake.llm.shared import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The pieces of one length are numbered in at least so many parts, of about so many pieces at most, so that no
#: length meets in one task, however many pieces have it.
PARTS, PART_PIECES = 16, 200_000


def pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, with_tokens: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of documents (doc_id, text): a null text is empty, a repeated row
    makes its pieces again; with_tokens adds their ids as array<int>."""
    schema = PIECES + ", tokens array<int>" * with_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, leading=False)
        for batch in slices(batches):
            ids, offsets = with_end(*encoder.encode(batch.column(1)), end_id)
            lengths = np.diff(offsets)
            per = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(per)), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, lengths[doc] - start)
            raw, at = memoryview(ids.astype("<u4").tobytes()), offsets[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            out = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_tokens:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])
        Encoder.unload()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in one sequence, number of such sequences)]; uses up the histogram of lengths exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    sizes = sorted(left)
    out = []

    def largest(limit: int, used: dict[int, int]) -> int:
        """The longest length up to limit that still has a piece, or 0."""
        i = bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    while sizes:
        used: dict[int, int] = {}
        fill: list[int] = []
        gap = capacity

        def take(n: int, used: dict[int, int] = used, fill: list[int] = fill) -> None:
            used[n] = used.get(n, 0) + 1
            fill.append(n)

        while n := largest(gap, used):
            take(n)
            gap -= n
        while gap and len(fill) > 1:  # the smallest goes for two that fill its place and more of the gap
            smallest = min(fill)
            used[smallest] -= 1
            wide, best = gap + smallest, (smallest, 0, 0)
            free = [n for n in sizes[: bisect_right(sizes, wide)] if left[n] > used.get(n, 0)]
            i, j = 0, len(free) - 1
            while i <= j:
                a, b = free[i], free[j]
                if a + b > wide:
                    j -= 1
                    continue
                if a + b > best[0] and (a != b or left[a] - used.get(a, 0) >= 2):
                    best = (a + b, a, b)
                i += 1
            fill.remove(smallest)
            if not best[1]:
                take(smallest)
                break
            take(best[1])
            take(best[2])
            gap = wide - best[0]
        times = min(left[n] // c for n, c in used.items() if c)
        out.append((fill, times))
        for n, c in used.items():
            left[n] -= c * times
        sizes = [n for n in sizes if left[n] > 0]
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, sequences, pieces of that length in each, first sequence, offset of the first).

    Pieces of one length stand side by side in a sequence; numbers of a length follow the order of patterns.
    """
    rows, seen, sequence = [], {}, 0
    for fill, times in patterns:
        offset = 0
        for n in sorted(set(fill), reverse=True):
            each = fill.count(n)
            first = seen.get(n, 0)
            rows.append((n, first, times, each, sequence, offset))
            seen[n] = first + times * each
            offset += n * each
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """parts (doc_id, piece, length, any others) with sequence_id and offset.

    Lengths are 1 to capacity, and parts must give the same rows each time (a written table). The driver
    holds the histogram (at most `capacity` rows) and the plan; the plan is broadcast, with at most
    `capacity` patterns of few different lengths each.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths are not all in 1..{capacity}")
    rows = places(plan(counts, capacity))
    where = spark.createDataFrame(rows, "length long, first long, sequences long, each long, first_sequence long, first_offset long")
    split = spark.createDataFrame([(n, max(PARTS, -(-c // PART_PIECES))) for n, c in counts.items()], "length long, _parts int")  # at most capacity rows
    others = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    dealt = parts.join(F.broadcast(split), "length").withColumn("_part", F.pmod(F.xxhash64(*others), F.col("_parts"))).drop("_parts")
    totals = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = totals.select("length", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    dealt = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    numbered = dealt.join(F.broadcast(before), ["length", "_part"])  # at most capacity * PARTS rows and one for PART_PIECES pieces
    numbered = numbered.withColumn("_number", F.col("_rank") + F.col("_before"))
    steps = where.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequences", "each", "first_sequence", "first_offset"))).alias("_steps"))
    # the step that a number falls in: the last whose first number is not greater, found by halving
    found = numbered.join(F.broadcast(steps), "length").withColumn(
        "_low",
        F.expr(
            "aggregate(sequence(1, 1 + CAST(ceil(log2(size(_steps) + 1)) AS INT)), named_struct('a', 0, 'b', size(_steps)),"
            " (s, i) -> CASE WHEN s.b - s.a <= 1 THEN s WHEN _steps[CAST(floor((s.a + s.b) / 2) AS INT)].first <= _number"
            " THEN named_struct('a', CAST(floor((s.a + s.b) / 2) AS INT), 'b', s.b) ELSE named_struct('a', s.a, 'b', CAST(floor((s.a + s.b) / 2) AS INT)) END, s -> s.a)"
        ),
    )
    found = found.withColumn("_step", F.expr("_steps[_low]")).withColumn("_in", F.expr("_number - _step.first"))
    return found.select(
        *parts.columns,
        F.expr("_step.first_sequence + _in DIV _step.each").alias("sequence_id"),
        F.expr("_step.first_offset + (_in % _step.each) * length").alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_tokens: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see pieces() and pack(). An empty table gives no row."""
    return pack(written(pieces(documents, tokenizer, end_id, capacity, with_tokens), "pieces"), capacity)
