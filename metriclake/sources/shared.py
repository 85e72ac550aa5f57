"""Tables written in the folder that driver and executors share, to end a lineage that would grow."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder serves a local session, as in tests; on a
    cluster, whose machines don't share one, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="metriclake-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task is given to sort or to sum, about.
ROWS = 1 << 20


def parts_of(spark: SparkSession, rows: int) -> int:
    """Into how many parts so many rows are dealt: about ROWS in each, and no fewer parts than Spark's own number."""
    return max(math.ceil(rows / ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys into so many parts that each has about ROWS of its rows; as Spark deals it where its own number of parts is enough.
    So what a task holds doesn't grow with the table."""
    parts = math.ceil(rows / ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
