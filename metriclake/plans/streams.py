"""Queries that run the streaming jobs over the events as they land in several files."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.plans.registry import query
from metriclake.sources import shared
from metriclake.sources.derived import Tables
from metriclake.streaming import jobs
from metriclake.streaming.progress import closed_runs


def landed(t: Tables) -> str:
    """A folder with all events in three files as they came: the days to the 15th, those after it, and, after all
    others, every tenth event, which was late. So batches after the first are merged too."""
    folder = f"{jobs.work_folder(t.spark)}/landed"
    late, early = F.col("event_id") % 10 == 7, F.dayofmonth("ts") <= 15
    for part in (~late & early, ~late & ~early, late):
        t.base("events").filter(part).coalesce(1).write.mode("append").parquet(folder)
    return folder


def events(t: Tables) -> DataFrame:
    return jobs.read_files(t.spark, landed(t))


@query("stream_upsert_facts", "SELECT user_id, event_type, MAX(event_id) AS event_id FROM events GROUP BY ALL")
def _(t: Tables):
    return jobs.upsert(events(t), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("stream_dedup", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def _(t: Tables):
    """A third of the events is delivered again with the other files."""
    folder = f"{jobs.work_folder(t.spark)}/landed"
    for part in ("event_id % 2 = 0", "event_id % 2 = 1 OR event_id % 3 = 0", "event_id % 6 = 1"):
        t.base("events").filter(part).coalesce(1).write.mode("append").parquet(folder)
    return jobs.dedup(jobs.read_files(t.spark, folder), "event_id", "ts", "60 days").groupBy("event_type").agg(F.count("*").alias("n"))


LATE = "CASE WHEN event_id % 50 = 7 THEN 12 WHEN event_id % 10 = 7 THEN 1 ELSE 0 END"


#: Rows of a file at least where a batch has several, so that none stays empty.
LEAST = 1000


def told(t: Tables) -> DataFrame:
    """Runs and facts as they arrive, in batches of five days, each in as many files as its rows need: a run's row when it ends, a fact at its time, some a day later (in time), some twelve days
    later (too late). Facts of one day in 15 never come, so their runs tell nothing; runs of the 9th, 19th and 29th found nothing."""
    run = F.concat_ws("|", "site_id", F.date_format("day", "yyyy-MM-dd"))
    facts = t.hits.filter("dayofmonth(day) % 10 <> 9").select(
        F.col("site_id").alias("binding_key"), run.alias("run_id"), F.lit("fact").alias("kind"), F.col("ts").alias("end"), F.lit(None).cast("long").alias("expected"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.expr(LATE))).alias("arrived"), (F.dayofmonth("day") % 15 == 4).alias("lost"),
    )
    runs = t.hits.groupBy("site_id", "day").agg(F.max("ts").alias("arrived"), F.count("*").alias("n"))
    own = runs.select(
        F.col("site_id").alias("binding_key"), run.alias("run_id"), F.lit("run").alias("kind"), (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")).alias("end"),
        F.when(F.dayofmonth("day") % 10 == 9, 0).otherwise(F.col("n")).alias("expected"), F.col("arrived").cast("timestamp_ntz").alias("arrived"),
    )
    clock = [(f"clock {i}", "clock", "fact", datetime(2024, 3, i), None, datetime(2024, 3, i)) for i in (1, 2)]
    ticks = t.spark.createDataFrame(clock, "binding_key string, run_id string, kind string, end timestamp_ntz, expected long, arrived timestamp_ntz")
    rows = facts.filter("NOT lost").drop("lost").unionByName(own).unionByName(ticks)
    folder = f"{jobs.work_folder(t.spark)}/landed"
    rows.withColumn("file", F.expr("least(7, datediff(arrived, DATE'2024-01-01') div 5) + IF(arrived >= '2024-03-02', 1, 0)")).write.partitionBy("file").parquet(f"{folder}/by")
    kept = t.spark.read.parquet(f"{folder}/by")
    sizes = [r.n for r in kept.filter("file < 8").groupBy("file").agg(F.count("*").alias("n")).collect()]  # one row a batch
    files = max(1, min(math.ceil(max(sizes) / shared.ROWS), min(sizes) // LEAST))  # of a batch, the same number for all but the last
    for n in range(9):
        written = f"{folder}/files/{n}"
        kept.filter(F.col("file") == n).drop("file").repartition(files).write.parquet(written)
        found = len(t.spark.read.parquet(written).inputFiles())
        if found != files and n in range(8) and (found > 1 or files > 1):
            raise RuntimeError(f"batch {n} landed in {found} files, not in {files}")
    return jobs.read_files(t.spark, f"{folder}/files/*", at_once=files)


@query(
    "stream_watermark",
    f"facts AS (SELECT site_id, day, ts, ts + to_days({LATE}) AS arrived FROM hits WHERE day(day) % 10 <> 9 AND day(day) % 15 <> 4),"
    " r AS (SELECT site_id, day, CAST(day AS TIMESTAMP) + INTERVAL 18 HOURS AS window_end, CASE WHEN day(day) % 10 = 9 THEN 0 ELSE COUNT(*) END AS expected, MAX(ts) AS arrived FROM hits GROUP BY site_id, day),"
    " every AS (SELECT site_id, day, arrived, true AS own FROM r UNION ALL SELECT site_id, day, arrived, false FROM facts),"
    " files AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(arrived AS DATE)) // 5 AS file FROM every), marks AS (SELECT file, MAX(arrived) AS mark FROM files GROUP BY file),"
    " heard AS (SELECT site_id, day, MAX(arrived) + INTERVAL 4 DAYS AS expires FROM files JOIN (SELECT site_id, day, MIN(file) AS file FROM files GROUP BY ALL) USING (site_id, day, file) GROUP BY site_id, day),"
    " intime AS (SELECT f.site_id, f.day, f.ts FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(arrived AS DATE)) // 5 AS file FROM facts) f JOIN heard USING (site_id, day) WHERE NOT EXISTS (SELECT 1 FROM marks WHERE marks.file <= f.file - 2 AND mark >= expires)),"
    " done AS (SELECT r.site_id, r.day, CASE WHEN COUNT(i.ts) = 0 THEN window_end ELSE least(MAX(i.ts), window_end) END AS through FROM r LEFT JOIN intime i USING (site_id, day) GROUP BY r.site_id, r.day, window_end, expected HAVING expected = 0 OR COUNT(i.ts) > 0)"
    " SELECT site_id AS binding_key, site_id || '|' || strftime(day, '%Y-%m-%d') AS run_id, through AS data_through FROM done",
    "hits",
)
def _(t: Tables):
    return closed_runs(told(t), "4 DAYS").select("binding_key", "run_id", "data_through")


@query("stream_provisional_revision", "SELECT user_id, completeness, event_id FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'final' ELSE 'provisional' END AS completeness, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 <> 0, event_id DESC) AS k FROM events) WHERE k = 1")
def _(t: Tables):
    rows = events(t).withColumn("completeness", F.when(F.col("event_id") % 3 == 0, "final").otherwise("provisional"))
    return jobs.revise(rows, ["user_id"], "completeness", "event_id").select("user_id", "completeness", "event_id")


@query("stream_daily_rollup", "SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def _(t: Tables):
    return jobs.daily_rollup(events(t), ["event_type"], "ts", "value").withColumn("total", F.col("total").cast("double"))
