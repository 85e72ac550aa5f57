"""Streaming jobs over landed files: upserts, dedup, watermarks, provisional revisions, daily rollups.

Each runs what has arrived (trigger availableNow) and can be started again from its checkpoint. Keyed results are tables that
merge when they are read (deltas.py): a batch adds its own rows only, and one that is tried twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metriclake.sources.shared import shared_folder
from metriclake.streaming.deltas import DeltaTable


def read_files(spark: SparkSession, folder: str, name: str = "*.parquet", at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files of a name in a folder, so many a batch."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", at_once).parquet(folder)


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class RepeatedIdentity(ValueError):
    """One batch brings an identity more than once."""


def merge_into(table: DeltaTable, strict: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function that adds batches to a table. strict: a batch with two rows of one key is an error, and adds nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        if strict and not batch.groupBy(*table.keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise RepeatedIdentity(f"batch {number} brings a key twice")
        table.append(batch, number)

    return merge


def keyed(stream: DataFrame, keys: list[str], order: Callable[[], list[Column]], strict: bool = False) -> DeltaTable:
    """The table of a stream's rows by key, after all that has arrived."""
    folder = work_folder(stream.sparkSession)
    table = DeltaTable(stream.sparkSession, f"{folder}/table", keys, order)
    run(stream, merge_into(table, strict), folder)
    return table


def rows(table: DeltaTable, like: DataFrame) -> DataFrame:
    """What a table holds, with the columns of `like`; none if no batch came."""
    found = table.read()
    return table.spark.createDataFrame([], like.schema) if found is None else found.select(*like.columns)


def upsert(stream: DataFrame, keys: list[str], observed: str, strict: bool = False) -> DataFrame:
    """Rows of a stream with one row per key: that observed last, then brought last. strict: see merge_into."""
    return rows(keyed(stream, keys, lambda: [F.desc(observed)], strict), stream)


def revise(stream: DataFrame, keys: list[str], completeness: str, observed: str) -> DataFrame:
    """Rows of a stream with one row per key: the most settled, then that observed last, so a late provisional
    row never replaces a final one."""

    def order() -> list[Column]:
        return [F.array_position(F.array(*[F.lit(c) for c in ("final", "provisional", "realtime", "unknown")]), F.col(completeness)), F.desc(observed)]

    return rows(keyed(stream, keys, order), stream)


def dedup(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows of a stream without re-deliveries of a key within the delay; the first stays."""
    folder = work_folder(stream.sparkSession)
    once = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(once.schema).parquet(f"{folder}/rows")


def kept_state(state: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of a streaming aggregate by its keys: each batch adds the groups that it changed."""
    folder = work_folder(state.sparkSession)
    numbered = state.withColumn("_batch", F.lit(0).cast("long"))
    table = DeltaTable(state.sparkSession, f"{folder}/table", keys, lambda: [F.desc("_batch")])
    run(state, lambda batch, n: table.append(batch.withColumn("_batch", F.lit(n).cast("long")), n), folder, "update")
    return rows(table, numbered).drop("_batch")


def daily_rollup(stream: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Counts and exact sums per key and day, kept up to date batch by batch."""
    state = stream.groupBy(*keys, F.to_date(time).alias("day")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    return kept_state(state, [*keys, "day"])
