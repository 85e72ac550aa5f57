"""A lake of revisioned bulk exports: epochs per site, table and provider date, published only when totals match."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metriclake.sources.commits import Conflict, Log

PARTITION = ("site_id", "namespace", "data_date", "epoch")
#: Rows of a file, about: a large partition is written by several tasks.
FILE_ROWS = 2_000_000


def latest_revision(log: DataFrame, start: str, end: str) -> DataFrame:
    """The newest epoch (then publish time) of each namespace and date in the range."""
    order = Window.partitionBy("namespace", "data_date").orderBy(F.desc("epoch"), F.desc("published_at"))
    some = log.filter((F.col("data_date") >= F.lit(start).cast("date")) & (F.col("data_date") < F.lit(end).cast("date")))
    return some.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def control_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Row count and exact sums, with whether all counts are whole and none is negative."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("position_sum").alias("position_sum"), F.bool_and((F.col("clicks") >= 0) & (F.col("impressions") >= 0) & (F.col("position_sum") >= 0)).alias("non_negative")
    )


def read_partition(rows: DataFrame, site: str, date: str) -> DataFrame:
    """The rows of one site and date; both are partition columns, so only their files are read."""
    return rows.filter((F.col("site_id") == site) & (F.col("data_date") == F.lit(date).cast("date")))


def publish(rows: DataFrame, expected: DataFrame, folder: str, base: int | None = None) -> DataFrame:
    """Write new epoch partitions and return the folder's manifest.

    rows has PARTITION's columns; expected has them and row_count, clicks, impressions. Each call writes a batch of its
    own and then commits it in the folder's log, so what a call that died has left is never read. Partitions whose totals differ
    are kept apart (accepted=false). Epochs that version `base` of the manifest (default: the newest) holds already are left out: publishing them again changes
    nothing. If others committed since, their batches are looked at: partitions of other epochs are no matter, and the
    commit is tried again behind them; if one of them accepted a partition of this batch, all of this batch is refused (Conflict).
    """
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    log = Log(spark, folder)
    base = log.latest() if base is None else base
    found = control_totals(rows, *PARTITION)
    held = read_manifest(spark, folder, base)
    if held is not None:
        found = found.join(held.filter("accepted").select(*PARTITION), list(PARTITION), "left_anti")
    wanted = expected.select(*PARTITION, F.col("row_count").alias("_n"), F.col("clicks").alias("_c"), F.col("impressions").alias("_i"))
    same = (F.col("row_count") == F.col("_n")) & (F.col("clicks") == F.col("_c")) & (F.col("impressions") == F.col("_i")) & F.col("non_negative")
    judged = found.join(wanted, list(PARTITION), "left").withColumn("accepted", F.coalesce(same, F.lit(False))).drop("_n", "_c", "_i")
    judged.write.parquet(f"{folder}/judged/batch={batch}")  # decided once, before any row moves
    judged = spark.read.schema(judged.schema).parquet(f"{folder}/judged/batch={batch}")
    parts = rows.join(judged.select(*PARTITION, "accepted", "row_count"), list(PARTITION))
    part = F.pmod(F.xxhash64(*rows.columns), F.ceil(F.col("row_count") / FILE_ROWS).cast("int"))
    dealt = parts.withColumn("_part", part).repartition(*PARTITION, "_part").drop("_part", "row_count")
    dealt.write.partitionBy("accepted", *PARTITION).parquet(f"{folder}/data/batch={batch}")
    while not log.put(base + 1, batch):
        newest = log.latest()
        since = read_manifest(spark, folder, newest, after=base).filter("accepted")
        if not judged.filter("accepted").join(since, list(PARTITION), "left_semi").isEmpty():
            raise Conflict(f"partitions of batch {batch} were published after version {base}")
        base = newest
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str, version: int | None = None, after: int = -1) -> DataFrame | None:
    """All partitions, accepted or not, that commits after..version published, with their batches and versions; None if
    there are none yet."""
    log = Log(spark, folder)
    version = log.latest() if version is None else version
    if version < 0:
        return None
    commits = log.read(version, after).select(F.col("name").alias("batch"), "version")
    return spark.read.parquet(f"{folder}/judged").join(commits, "batch")


def current_partitions(manifest: DataFrame) -> DataFrame:
    """The highest accepted epoch of each site, namespace and date; it never goes down."""
    return manifest.filter("accepted").groupBy("site_id", "namespace", "data_date").agg(F.max("epoch").alias("epoch"))


def read_current(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """All rows of the partitions that are current at a version (default: the newest); none before anything was accepted."""
    rows = spark.read.parquet(f"{folder}/data").withColumn("data_date", F.col("data_date").cast("date")).filter("accepted = 'true'")
    manifest = read_manifest(spark, folder, version)
    if manifest is None:
        return rows.limit(0).drop("accepted", "batch")
    named = manifest.filter("accepted").join(current_partitions(manifest), list(PARTITION)).select(*PARTITION, "batch").distinct()
    return rows.join(named, [*PARTITION, "batch"], "left_semi").drop("accepted", "batch")


def verify(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Partitions whose rows don't have the manifest's totals, that are not declared, or have no rows."""
    real = control_totals(rows, *PARTITION).select(*PARTITION, F.col("row_count").alias("real_count"), F.col("clicks").alias("real_clicks"), F.col("impressions").alias("real_impressions"))
    both = manifest.filter("accepted").join(real, list(PARTITION), "full")
    problem = F.when(F.col("row_count").isNull(), "undeclared").when(F.col("real_count").isNull(), "no_rows").when((F.col("row_count") != F.col("real_count")) | (F.col("clicks") != F.col("real_clicks")) | (F.col("impressions") != F.col("real_impressions")), "totals_differ")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select(*PARTITION, "problem")


def check_epochs(log: DataFrame) -> DataFrame:
    """Per namespace and date: whether epochs are exactly 0 to n - 1, each once."""
    return log.groupBy("namespace", "data_date").agg(F.count("*").alias("n"), ((F.min("epoch") == 0) & (F.max("epoch") == F.count("*") - 1) & (F.countDistinct("epoch") == F.count("*"))).alias("continuous"))


def lake_status(manifest: DataFrame) -> DataFrame:
    """Per site: dates of each namespace, paired and unpaired, and the last paired one."""
    dates = current_partitions(manifest).groupBy("site_id", "data_date").agg(F.countDistinct("namespace").alias("n"))
    return dates.groupBy("site_id").agg(F.count("*").alias("n_dates"), F.count_if(F.col("n") == 2).alias("paired"), F.count_if(F.col("n") < 2).alias("unpaired"), F.max(F.when(F.col("n") == 2, F.col("data_date"))).alias("last_paired"))


def plan_sync(spine: DataFrame, log: DataFrame, manifest: DataFrame, activation: str) -> DataFrame:
    """What to do for each expected site, namespace and date: pre_activation, log_incomplete, current, write,
    refuse_downgrade. A date needs both namespaces in the export log."""
    newest = log.groupBy("site_id", "namespace", "data_date").agg(F.max("epoch").alias("exported"))
    both = newest.groupBy("site_id", "data_date").agg((F.countDistinct("namespace") == 2).alias("both"))
    held = current_partitions(manifest).withColumnRenamed("epoch", "held")
    out = spine.join(newest, ["site_id", "namespace", "data_date"], "left").join(both, ["site_id", "data_date"], "left").join(held, ["site_id", "namespace", "data_date"], "left")
    action = (
        F.when(F.col("data_date") < F.lit(activation).cast("date"), "pre_activation")
        .when(F.col("exported").isNull() | ~F.coalesce("both", F.lit(False)), "log_incomplete")
        .when(F.col("held").isNull() | (F.col("held") < F.col("exported")), "write")
        .when(F.col("held") > F.col("exported"), "refuse_downgrade")
        .otherwise("current")
    )
    return out.select("site_id", "namespace", "data_date", action.alias("action"))
