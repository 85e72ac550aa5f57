"""How far each binding is complete, while runs and their facts arrive in any order: keyed state with event-time timers.

A binding keeps its open runs: how many facts came and the latest end among them, the window's end and the number of facts as the
run's own row gives them. A run closes when its row and all its facts are there, or when its timer fires; then its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from metriclake.streaming.deltas import DeltaTable
from metriclake.streaming.jobs import rows, run, work_folder

OPEN = "facts long, latest long, window_end long, expected long, expires long"
CLOSED = "binding_key string, run_id string, data_through long, by_timer boolean, completed_through long"
STORE = "spark.sql.streaming.stateStore.providerClass"


class OpenRuns(StatefulProcessor):
    """Rows (binding_key, run_id, kind: fact or run, n: facts, end: micros, expected, arrived) -> CLOSED, one row a closed run."""

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "run_id string", OPEN)
        self.through = handle.getValueState("through", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = []
        for batch in rows:
            facts = batch[batch["kind"] == "fact"].groupby("run_id").agg(n=("n", "sum"), latest=("end", "max"), arrived=("arrived", "max"))
            runs = batch[batch["kind"] == "run"].groupby("run_id").agg(end=("end", "max"), expected=("expected", "max"), arrived=("arrived", "max"))
            for name in sorted({*facts.index, *runs.index}):
                n, latest, window, expected, expires = self.open.getValue((name,)) if self.open.containsKey((name,)) else (0, None, None, None, None)
                came = [t[name].arrived for t in (facts.T, runs.T) if name in t]
                if name in facts.index:
                    n, latest = n + int(facts.at[name, "n"]), max(int(facts.at[name, "latest"]), latest if latest is not None else -(1 << 63))
                if name in runs.index:
                    window, expected = int(runs.at[name, "end"]), int(runs.at[name, "expected"])
                if expected is not None and n >= expected:
                    if expires is not None:
                        self.handle.deleteTimer(expires)
                        self.arm_others(name, expires)
                    self.open.removeKey((name,))
                    closed.append((name, min(latest, window) if expected else window, False))
                    continue
                if expires is None:
                    expires = int(max(came).timestamp() * 1000) + self.grace_ms
                    self.handle.registerTimer(expires)
                self.open.updateValue((name,), (n, latest, window, expected, expires))
        yield self.told(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, closed = expiredTimerInfo.getExpiryTimeInMs(), []
        for (name,), (n, latest, window, _, expires) in list(self.open.iterator()):
            if expires <= now:
                self.open.removeKey((name,))
                if n and window is not None:  # facts without a window, and a run whose facts stayed away, prove nothing
                    closed.append((name, min(latest, window), True))
        yield self.told(key, closed)

    def arm_others(self, name: str, expires: int) -> None:
        """A timer is one for all runs of its moment: set it again if another run waits for it."""
        if any(other != name and state[4] == expires for (other,), state in self.open.iterator()):
            self.handle.registerTimer(expires)

    def told(self, key, closed: list[tuple[str, int, bool]]) -> pd.DataFrame:
        if closed:
            before = self.through.get()[0] if self.through.exists() else -(1 << 63)
            through = max(before, *(c[1] for c in closed))
            self.through.update((through,))
        return pd.DataFrame([(key[0], *c, through) for c in closed], columns=[c.split()[0] for c in CLOSED.split(", ")])

    def close(self) -> None:
        pass


SUMMED = "binding_key string, run_id string, kind string, n long, end long, expected long, arrived timestamp"


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each part of a batch tells of a run in one row: a binding's state gets a few rows a task, however many facts came."""
    for batch in batches:
        yield batch.groupby(["binding_key", "run_id", "kind"], as_index=False, sort=False).agg(n=("end", "size"), end=("end", "max"), expected=("expected", "max"), arrived=("arrived", "max"))


def closed_runs(stream: DataFrame, grace: str, folder: str | None = None) -> DataFrame:
    """stream (binding_key, run_id, kind, end, expected, arrived) -> binding_key, run_id, data_through, by_timer: one row a closed run.

    kind `run`: end is the window's end and expected the number of its facts; kind `fact`: end is the fact's. data_through is the
    smaller of the latest fact's end and the window's end; the window's end of a run that expects no facts (proven empty). A run whose facts stay
    away is closed by the watermark of `arrived`, `grace` after it was first heard of, with what came till then; facts that come later change nothing. Facts of a run without a row, and a
    run of which no expected fact came, prove nothing and close none. Rows with null keys are left out. The state of a closed run is dropped.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    grace_ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01' + INTERVAL {grace})").first()[0])
    timed = stream.select(
        "binding_key", "run_id", "kind", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(end AS TIMESTAMP_NTZ))").alias("end"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.col("arrived").cast("timestamp").alias("arrived")
    )
    whole = timed.filter("binding_key IS NOT NULL AND run_id IS NOT NULL AND end IS NOT NULL").mapInPandas(summed, SUMMED)
    found = whole.withWatermark("arrived", "0 seconds").groupBy("binding_key").transformWithStateInPandas(OpenRuns(grace_ms), CLOSED, "Update", "EventTime")
    table = DeltaTable(spark, f"{folder}/table", ["binding_key", "run_id"], lambda: [F.col("by_timer").desc()])
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run(found, table.append, folder, "update")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return rows(table, found).withColumn("data_through", F.timestamp_micros("data_through").cast("timestamp_ntz")).drop("completed_through")


def completed_through(stream: DataFrame, grace: str, folder: str | None = None) -> DataFrame:
    """The latest data_through of each binding over its closed runs; it never goes back."""
    return closed_runs(stream, grace, folder).groupBy("binding_key").agg(F.max("data_through").alias("completed_through"))
