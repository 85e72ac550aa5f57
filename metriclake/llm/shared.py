"""Places and habits common to the corpus operators: the shared folder, written stages, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder
    serves a local session, as in tests; on a cluster, whose machines don't share one, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="metriclake-"))
    return context.getCheckpointDir().rstrip("/")


def row_key(documents: DataFrame) -> DataFrame:
    """documents with _k1 and _k2: 128 bits that tell rows of different doc_id or text apart, nulls included."""
    flags = F.col("doc_id").isNull().cast("int") + 2 * F.col("text").isNull().cast("int")
    parts = [flags, F.col("doc_id").cast("string"), "text"]
    return documents.withColumns({"_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit("other"), *reversed(parts))})


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends, a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
