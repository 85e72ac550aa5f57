"""Which intervals hold a point: a plane sweep over slices of the axis.

The axis of each key is cut into slices with about the same number of points and interval starts; an instant that has too many of them is
split by hash. An interval goes to the slices it touches, one row each, however long it is: these rows are the active set that is
carried over the borders of tasks. A task sorts its slice and sweeps it once, dropping intervals as they end.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points and interval starts of a slice, about; microseconds of the axis that are counted together.
SLICE, UNIT = 200_000, 60_000_000
#: Pairs (point, active interval) that a task compares at once.
HELD = 1 << 20


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def slices(points: DataFrame, intervals: DataFrame, key: list[str]) -> DataFrame:
    """key, _unit, _slice, _parts: the slice of each counted unit of the axis, and in how many parts it is dealt."""
    units = points.select(*key, F.floor(F.col("_at") / UNIT).alias("_unit")).unionByName(intervals.select(*key, F.floor(F.col("_from") / UNIT).alias("_unit")))
    counts = units.groupBy(*key, "_unit").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_unit")) - F.col("_n")
    return counts.withColumn("_slice", F.floor(before / SLICE)).withColumn("_parts", F.ceil(F.sum("_n").over(Window.partitionBy(*key, "_slice")) / SLICE))


def answers(only: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each point (_at, _start, _end) the interval that is active there (_from..._to) and whose window (_low..._high) holds
    _start..._end: the only one, or else the first by _rank (highest), then name."""

    def run(points: pa.Table, intervals: pa.Table) -> pa.Table:
        points = points.sort_by("_at")
        intervals = intervals.sort_by([("_rank", "descending"), ("_name", "descending")])
        at, start, end = (points.column(c).to_numpy() for c in ("_at", "_start", "_end"))
        begins, ends, low, high = (intervals.column(c).to_numpy() for c in ("_from", "_to", "_low", "_high"))
        coming, i = np.argsort(begins, kind="stable"), 0
        leaving: list[tuple[int, int]] = []
        active: set[int] = set()
        found = np.full(len(at), -1)
        borders = np.append(np.flatnonzero(np.diff(at, prepend=at[:1] - 1)), len(at))
        now = np.zeros(0, np.int64)
        for first, last in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            t, changed = at[first], False
            while i < len(coming) and begins[coming[i]] <= t:
                heapq.heappush(leaving, (int(ends[coming[i]]), int(coming[i])))
                active.add(int(coming[i]))
                i, changed = i + 1, True
            while leaving and leaving[0][0] < t:
                active.discard(heapq.heappop(leaving)[1])
                changed = True
            if changed:
                now = np.sort(np.fromiter(active, np.int64, len(active)))
            for k in range(first, last if len(now) else first, max(1, HELD // max(1, len(now)))):
                some = slice(k, min(last, k + max(1, HELD // len(now))))
                inside = (low[now] <= start[some, None]) & (high[now] >= end[some, None])
                many = inside.sum(axis=1)
                found[some] = np.where(many == 1 if only else many > 0, now[inside.argmax(axis=1)], -1)
        kept = np.flatnonzero(found >= 0)
        out = points.drop_columns(["_slice", "_part"]).take(pa.array(kept))
        return out.append_column("_name", intervals.column("_name").take(pa.array(found[kept])))

    return run


def stabbed(points: DataFrame, intervals: DataFrame, key: list[str], only: bool) -> DataFrame:
    """points (key, _at, _start, _end: long) with _name, that of the interval (key, _from, _to, _low, _high, _rank: long, _name: string)
    which `answers` names; points without one are left out. All bounds belong to the intervals. Rows with a null take no part."""
    points, intervals = points.select(*key, "_at", "_start", "_end").na.drop(), intervals.select(*key, "_from", "_to", "_low", "_high", "_rank", "_name").na.drop()
    units = slices(points, intervals, key)
    part = F.pmod(F.xxhash64("_at", "_start", "_end"), F.col("_parts")).alias("_part")
    dealt = points.withColumn("_unit", F.floor(F.col("_at") / UNIT)).join(units.drop("_n"), [*key, "_unit"]).select(*points.columns, "_slice", part)
    ranges = units.groupBy(*key, "_slice").agg(F.min("_unit").alias("_first"), F.max("_unit").alias("_last"), F.max("_parts").alias("_parts"))
    each = ranges.groupBy(*key).agg(F.collect_list(F.struct("_slice", "_first", "_last", "_parts")).alias("_slices"))
    touched = F.filter("_slices", lambda s: (s["_last"] >= F.floor(F.col("_from") / UNIT)) & (s["_first"] <= F.floor(F.col("_to") / UNIT)))
    copied = intervals.join(each, key).withColumn("_s", F.explode(touched)).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s._parts") - 1)))
    copied = copied.select(*[F.col(c).alias(c) for c in intervals.columns], F.col("_s._slice").alias("_slice"), F.col("_part").alias("_part"))
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in points.columns) + ", _name string"
    by = [*key, "_slice", "_part"]
    return dealt.groupBy(*by).cogroup(copied.groupBy(*by)).applyInArrow(answers(only), schema)
