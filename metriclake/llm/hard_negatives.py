"""Hard negatives by exact integer scores: a matrix product in a residue number system.

Components become integers. A block of anchors is multiplied with a block of rows modulo several small primes, in
float32: the primes are so small that no sum leaves the integers that float32 holds. The Chinese remainder theorem
gives the exact signed scores back, whatever their size. Rows are dealt evenly into stripes and anchors into blocks;
a cell is one block against one stripe, so each task holds a bounded matrix, whatever label or vector is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metriclake.llm.shared import shuffle_partitions, written

#: Components of a block of anchors and of a stripe of rows, about: what one cell multiplies. Results don't depend on them.
ANCHORS, ROWS = 1 << 19, 1 << 21
#: float32 holds all integers up to this; components of one product at most; scores (anchors x rows) held at once.
FLOAT32, DEPTH, HELD = 1 << 24, 1024, 1 << 20
LONG = (1 << 63) - 1


def primes_for(depth: int, bound: int) -> list[int]:
    """The largest primes whose residues (-p/2..p/2) keep a sum of `depth` products exact in float32, so many that
    their product tells all integers of -bound..bound apart."""
    p, found, product = 2 * math.isqrt(FLOAT32 // depth) + 1, [], 1
    while product <= 2 * bound:
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def norm(m: np.ndarray) -> int:
    """At least the largest Euclidean norm of a row of integral floats."""
    if np.abs(m).max(initial=0) < 1e6:
        return math.isqrt(int(np.square(m).sum(axis=1).max(initial=0))) + 1
    return math.isqrt(max(sum(int(v) ** 2 for v in row) for row in m)) + 1


def residues(m: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """m modulo each prime in -p/2..p/2; exact for integral floats of any size, as fmod is."""
    found = (np.mod(m, p) for p in primes)
    return [np.where(r > p // 2, r - p, r).astype(np.float32) for r, p in zip(found, primes, strict=True)]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The inner products of all rows of a with all rows of b from their residues, by mixed radix; what is beyond
    64 bits is the last 64-bit integer of its side."""
    whole = math.prod(primes)
    kind = np.int64 if whole < 1 << 62 else object
    value, weight = 0, 1
    for x, y, p in zip(a, b, primes, strict=True):
        r = sum((x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T).astype(np.int64) for k in range(0, max(1, x.shape[1]), DEPTH))
        digit = np.mod((r - np.mod(value, p)).astype(np.int64) * pow(weight % p, -1, p), p)
        value, weight = value + digit.astype(kind) * weight, weight * p
    value = np.where(value > whole // 2, value - whole, value)
    return value if kind is np.int64 else np.clip(value, -LONG, LONG).astype(np.int64)


def firsts(found: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k times (lines that still have an allowed column, its number): the best of each line, the first of equals."""
    left = np.where(allowed, found, -LONG - 1)
    for _ in range(k if left.size else 0):
        best = left.argmax(axis=1)
        line = np.flatnonzero(left[np.arange(len(left)), best] > -LONG - 1)
        yield line, best[line]
        left[line, best[line]] = -LONG - 1


class Cell:
    """One block of anchors against one stripe of rows, which are in the order of their ids (null last)."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, scale: float) -> None:
        rows = rows.sort_by([("vec_id", "ascending"), ("_row", "ascending")])
        vectors = [t.column("v").combine_chunks() for t in (anchors, rows)]
        lengths = [np.diff(v.offsets.to_numpy()) for v in vectors]
        width = max(n.max(initial=0) for n in lengths)
        both = []
        for v, n in zip(vectors, lengths, strict=True):  # shorter vectors end with zeros
            m = np.zeros((len(n), width))
            m[np.arange(width) < n[:, None]] = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            both.append(m)
        self.primes = primes_for(min(DEPTH, max(1, width)), norm(both[0]) * norm(both[1]))
        self.a, self.b = (residues(m, self.primes) for m in both)
        self.anchors, self.rows = anchors, rows
        self.anchor, self.row = (t.column("_row").to_numpy() for t in (anchors, rows))
        self.anchor_label, self.label = (t.column("label").to_numpy() for t in (anchors, rows))

    def parts(self, lines: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(some of the lines, their scores with all columns), so many that HELD scores are held."""
        step = max(1, HELD // max(1, len(columns)))
        b = [x[columns] for x in self.b]
        for k in range(0, len(lines), step):
            some = lines[k : k + step]
            yield some, scores([x[some] for x in self.a], b, self.primes)

    def table(self, found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
        """The arrays (anchor line, ..., row column, score) as _anchor, ..., vec_id, score, _row."""
        line, *more, column, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * (3 + len(names))))
        out = [self.anchor[line], *more, self.rows.column("vec_id").take(pa.array(column)), score, self.row[column]]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, pa.int64()) for x in out], names=["_anchor", *names, "vec_id", "score", "_row"])


def best_positives(scale: float, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each anchor's first k other rows of its label in the stripe."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell, found = Cell(anchors, rows, scale), []
        for label in np.unique(cell.anchor_label):
            columns = np.flatnonzero(cell.label == label)
            for lines, s in cell.parts(np.flatnonzero(cell.anchor_label == label), columns):
                for at, best in firsts(s, cell.row[columns] != cell.anchor[lines][:, None], k):
                    found.append((lines[at], columns[best], s[at, best]))
        return cell.table(found, [])

    return run


def best_negatives(scale: float, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each anchor and score of a positive, the first k rows of other labels in the window, by the stripe."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        cell, found = Cell(anchors, rows, scale), []
        wanted = anchors.column("wanted").to_pylist()
        for lines, s in cell.parts(np.arange(len(cell.anchor)), np.arange(len(cell.row))):
            other = cell.label != cell.anchor_label[lines][:, None]
            for p in range(max(len(wanted[i]) for i in lines)):
                having = np.array([n for n, i in enumerate(lines) if p < len(wanted[i])])
                score = [wanted[lines[n]][p] for n in having]
                least, most = (np.array([f(x) for x in score], dtype=np.int64)[:, None] for f in (lambda x: -(-low * x // 100), lambda x: high * x // 100))
                part = s[having]
                for at, best in firsts(part, other[having] & (part >= least) & (part <= most), k):
                    found.append((lines[having[at]], np.array(score, dtype=np.int64)[at], best, part[at, best]))
        return cell.table(found, ["positive_score"])

    return run


def taking_part(embeddings: DataFrame, scale: float) -> DataFrame:
    """_row (a number of its own for each row), vec_id, label, v: the rows that take part, written. Where vec_id is
    divisible by 7, the label is moved on."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    whole = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return written(whole.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").alias("v")), "vectors")


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`, against all rows. Rows with a null label, a null vector, or a
    null or non-finite component take no part; a null id is never an anchor and comes last among equal scores. Repeated
    rows are rows of their own: each is an anchor, a positive, a negative. Vectors of different lengths are compared
    as if the shorter ended with zeros; scores beyond 64 bits count as the last 64-bit integer. Other columns are left
    out; an empty table gives no rows.

    Two passes over the same cells: the second needs the scores of all stripes' best positives. What a stripe gives on
    is at most `positives` or positives x negatives rows an anchor.
    """
    spark = embeddings.sparkSession
    rows = taking_part(embeddings, scale)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own
    n, n_anchors, width = rows.select(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = -(-max(1, n_anchors) * max(1, width) // ANCHORS)
    stripes = max(-(-max(1, n) * max(1, width) // ROWS), shuffle_partitions(spark))

    def dealt(df: DataFrame, own: str, parts: int, copies: str, times: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("_row"), F.lit(parts))).withColumn(copies, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def best(left: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, of: list[str], k: int) -> DataFrame:
        """The best k of what the cells give, by the columns `of`."""
        cells = [dealt(left, "_block", blocks, "_stripe", stripes), dealt(rows, "_stripe", stripes, "_block", blocks)]
        grouped = [c.groupBy(F.col("_block").cast("long"), F.col("_stripe").cast("long")) for c in cells]
        found = grouped[0].cogroup(grouped[1]).applyInArrow(run, schema)
        order = Window.partitionBy(*of).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = best(anchors, best_positives(scale, positives), "_anchor long, vec_id long, score long, _row long", ["_anchor"], positives)
    pairs = written(first.select("_anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = pairs.groupBy(F.col("_anchor").alias("_row")).agg(F.collect_set("positive_score").alias("wanted"))
    second = best(anchors.join(wanted, "_row"), best_negatives(scale, negatives, low, high), "_anchor long, positive_score long, vec_id long, score long, _row long", ["_anchor", "positive_score"], negatives)
    of_anchors = anchors.select(F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id"))
    negative = second.select("_anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(negative, ["_anchor", "positive_score"]).join(of_anchors, "_anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
