"""Which cells are proven, and what may be compared: run intervals, coverage, gaps, providers side by side.

Days of runs are exploded, so that cells join runs by equality; which run brought a fact is found by a plane sweep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.operators import sweep
from metriclake.sources.shared import materialised


def days_of(start: Column, end: Column) -> Column:
    """The calendar days that a half-open interval touches."""
    last = F.to_date(end - F.expr("INTERVAL 1 MICROSECOND"))
    return F.sequence(F.to_date(start), last)


def each_of(rows: DataFrame, options: list[dict]) -> DataFrame:
    """Every row with every option of a fixed list, its keys as columns; no join."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in option.items()]) for option in options]
    return rows.withColumn("_option", F.explode(F.array(*structs))).select("*", "_option.*").drop("_option")


def expected_cells(sites: DataFrame, options: list[dict], first: str, last: str) -> DataFrame:
    """Every site with every option (source, metric) and day of the window: a spine made without a join."""
    spine = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    return each_of(sites, options).select("*", spine)


def covered_cells(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells (site_id, source, day) whose whole day lies in one successful run of theirs."""
    ok = runs.filter("status = 'success'").select("site_id", "source", "window_start", "window_end", F.explode(days_of(F.col("window_start"), F.col("window_end"))).alias("day"))
    whole = (F.col("window_start") <= F.col("day").cast("timestamp_ntz")) & (F.col("window_end") >= F.date_add("day", 1).cast("timestamp_ntz"))
    return cells.join(ok.filter(whole).select("site_id", "source", "day"), ["site_id", "source", "day"], "left_semi")


def attribute(facts: DataFrame, runs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Facts (site_id, source, start_ts, end_ts, observed_at) with the run_id of the run that brought them.

    A fact stays if exactly one run that brought data (result_kind) was under way when it was observed and holds its interval,
    if that run is the one that finished last (then of the largest run_id) of all runs that hold the interval, whether they brought data or proved it empty, and if
    its binding_key is one of bindings. A run holds what lies between window_start and the earlier of window_end and data_through. Failed
    and unfinished runs take no part. Facts of one moment and interval share one answer, so the sweeps see each only once.
    """
    key, ends = ["site_id", "source"], F.least("window_end", F.coalesce("data_through", "window_end"))
    done = runs.filter("status = 'success' AND finished_at IS NOT NULL AND result_kind IN ('data', 'empty')")
    window = done.select(*key, "result_kind", F.col("run_id").cast("string").alias("_name"), *[sweep.micros(c).alias(n) for c, n in (("started_at", "_begun"), ("finished_at", "_rank"), ("window_start", "_low"))], sweep.micros(ends).alias("_high"))
    asked = facts.select(*key, *[sweep.micros(c).alias(n) for c, n in (("observed_at", "_at"), ("start_ts", "_start"), ("end_ts", "_end"))]).distinct()
    owners = materialised(sweep.stabbed(asked, window.filter("result_kind = 'data'").withColumns({"_from": F.col("_begun"), "_to": F.col("_rank")}), key, only=True))
    cells = owners.select(*key, F.col("_start").alias("_at"), "_start", "_end").distinct()
    latest = sweep.stabbed(cells, window.withColumns({"_from": F.col("_low"), "_to": F.col("_high")}), key, only=False)
    sure = owners.join(latest.drop("_at"), [*key, "_start", "_end", "_name"])
    current = runs.join(bindings.select("binding_key").distinct(), "binding_key", "left_semi").select(*key, F.col("run_id").cast("string").alias("_name"), "run_id")
    found = sure.join(current.distinct(), [*key, "_name"]).drop("_name")
    at = {"_at": sweep.micros("observed_at"), "_start": sweep.micros("start_ts"), "_end": sweep.micros("end_ts")}
    return facts.withColumns(at).join(found, [*key, *at]).drop(*at)


def latest_run_per_day(runs: DataFrame) -> DataFrame:
    """(site_id, source, day, run_id, status) of the run that finished last among those touching the day."""
    each = runs.select("site_id", "source", "run_id", "status", "finished_at", F.explode(days_of(F.col("window_start"), F.col("window_end"))).alias("day"))
    order = Window.partitionBy("site_id", "source", "day").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return each.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "finished_at")


def latest_sync_status(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("binding_key").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def coverage(expected: DataFrame, present: DataFrame, proven: DataFrame) -> DataFrame:
    """Expected cells (site_id, metric, source, day) with covered: they have a fact, or a run proves them empty."""
    seen = present.select("site_id", "metric", "day").distinct().withColumn("_seen", F.lit(True))
    sure = proven.select("site_id", "source", "day").distinct().withColumn("_sure", F.lit(True))
    out = expected.join(seen, ["site_id", "metric", "day"], "left").join(sure, ["site_id", "source", "day"], "left")
    return out.withColumn("covered", F.coalesce("_seen", "_sure", F.lit(False))).drop("_seen", "_sure")


def coverage_status(cells: DataFrame, *level: str) -> DataFrame:
    """complete, partial or unavailable at a level, with the numbers of cells."""
    covered, expected = F.count_if("covered"), F.count("*")
    status = F.when(covered == expected, "complete").when(covered > 0, "partial").otherwise("unavailable")
    return cells.groupBy(*level).agg(expected.alias("expected"), covered.alias("covered"), status.alias("status"))


def with_inputs(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cells of derived metrics: covered only if the cells of all their inputs are; missing names the others.

    cells: site_id, metric, day, covered for plain metrics; catalog: metric, inputs.
    """
    wanted = catalog.select(F.col("metric").alias("derived"), F.explode("inputs").alias("metric"))
    out = cells.join(F.broadcast(wanted), "metric").groupBy("site_id", "derived", "day").agg(F.bool_and("covered").alias("covered"), F.array_sort(F.collect_set(F.when(~F.col("covered"), F.col("metric")))).alias("missing"))
    return out.withColumnRenamed("derived", "metric")


def date_ranges(days: DataFrame, *keys: str) -> DataFrame:
    """Consecutive days of each key as (first, last, n)."""
    order = Window.partitionBy(*keys).orderBy("day")
    islands = days.select(*keys, "day").distinct().withColumn("_island", F.date_sub("day", F.row_number().over(order)))
    return islands.groupBy(*keys, "_island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("_island")


def missing_ranges(cells: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Missing cells (keys, day, reason) as ranges in which the days follow each other and the reason stays."""
    order = Window.partitionBy(*keys).orderBy("day")
    new = ~(F.lag("day").over(order).eqNullSafe(F.date_sub("day", 1)) & F.lag(reason).over(order).eqNullSafe(F.col(reason)))
    runs = cells.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.first(reason).alias(reason), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("_run")


def continuous_through(days: DataFrame, *keys: str) -> DataFrame:
    """The last day of the unbroken run that starts with each key's first day."""
    ranges = date_ranges(days, *keys)
    return ranges.groupBy(*keys).agg(F.min_by("last_day", "first_day").alias("through"))


def fill_zero(cells: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, covered) with value: zero only where the cell is proven and nothing was observed."""
    return cells.join(values, keys, "left").withColumn("value", F.when(F.col("value").isNull() & F.col("covered"), 0).otherwise(F.col("value")))


def with_comparison(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows (keys, value, complete) with the previous value where both periods are complete."""
    before = previous.select(*keys, F.col("value").alias("_value"), F.col("complete").alias("_complete"))
    out = current.join(before, keys, "left").withColumn("previous_value", F.when(F.col("complete") & F.col("_complete"), F.col("_value")))
    return out.withColumn("change_percent", percent_change(F.col("value"), F.col("previous_value"))).withColumn("trend", trend_state(F.col("value"), F.col("previous_value"))).drop("_value", "_complete")


def percent_change(value: Column, previous: Column) -> Column:
    """Change in per cent to two digits; null without a previous value or from zero."""
    return F.when(previous != 0, F.round((value - previous) / previous * 100, 2))


def trend_state(value: Column, previous: Column, lower_is_better: bool = False) -> Column:
    better, worse = ("worse", "better") if lower_is_better else ("better", "worse")
    return F.when(value.isNull() | previous.isNull(), "unknown").when((previous == 0) & (value != 0), "new").when(value > previous, better).when(value < previous, worse).otherwise("same")


def pair_dates(days: DataFrame) -> DataFrame:
    """days (.., a, b) with pairing: paired, a_only, b_only; days with neither go."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return days.filter("a IS NOT NULL OR b IS NOT NULL").withColumn("pairing", F.when(both, "paired").when(F.col("a").isNotNull(), "a_only").otherwise("b_only"))


def divergence(pairs: DataFrame, *keys: str, low: int = 100) -> DataFrame:
    """How two providers' daily counts agree, in whole numbers: a day diverges outside 0.8 to 1.25.

    aligned, within_expected_variation, low_volume (either total under `low`), isolated_divergence,
    persistent_divergence, unknown (exactly half the days), coverage_mismatch, non_comparable.
    """
    paired = F.col("pairing") == "paired"
    outside = paired & (F.col("a") != F.col("b")) & ((F.col("b") == 0) | (5 * F.col("a") < 4 * F.col("b")) | (4 * F.col("a") > 5 * F.col("b")))
    out = pairs.groupBy(*keys).agg(
        F.count_if(paired).alias("paired"), F.count_if(~paired).alias("unpaired"), F.count_if(outside).alias("outside"), F.count_if(paired & (F.col("a") != F.col("b"))).alias("different"), F.sum(F.when(paired, F.col("a"))).alias("a"), F.sum(F.when(paired, F.col("b"))).alias("b")
    )
    state = (
        F.when(F.col("paired") == 0, "non_comparable")
        .when(F.col("unpaired") > 0, "coverage_mismatch")
        .when((F.col("a") < low) | (F.col("b") < low), "low_volume")
        .when(F.col("different") == 0, "aligned")
        .when(F.col("outside") == 0, "within_expected_variation")
        .when(F.col("paired") == 1, "isolated_divergence")
        .when(2 * F.col("outside") > F.col("paired"), "persistent_divergence")
        .when(2 * F.col("outside") < F.col("paired"), "isolated_divergence")
        .otherwise("unknown")
    )
    return out.withColumn("state", state)


def reconcile_routes(routes: DataFrame, headline: DataFrame, *keys: str) -> DataFrame:
    """Daily sums over routes against the headline on the headline's days: status and reason per key.

    routes: keys, day, value, final; headline: keys, day, value.
    """
    sums = routes.groupBy(*keys, "day").agg(F.sum("value").alias("_routes"), F.bool_and("final").alias("_final"))
    days = headline.join(sums, [*keys, "day"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.sum("value").alias("headline_total"), F.sum("_routes").alias("_total"), F.bool_and(F.coalesce("_final", F.lit(True))).alias("_final"), F.bool_and(F.col("_routes").isNotNull()).alias("_all"), F.bool_and(F.col("_routes") == F.col("value")).alias("_same")
    )
    reason = F.when(~F.col("_final"), "route_coverage_incomplete").when(~F.col("_all"), "route_facts_absent").when(~F.col("_same"), "route_sum_differs_from_headline")
    out = days.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "reconciled").otherwise("withheld"))
    shown = F.col("_final") & F.col("_all")
    return out.select(*keys, "n_days", "headline_total", F.when(shown, F.col("_total")).alias("route_total"), "status", "reason")


def spine_counts(rows: DataFrame, spine: DataFrame, keys: list[str], status: str, states: list[str]) -> DataFrame:
    """Counts per key and state with a row of zeros for every expected key."""
    counts = rows.groupBy(*keys).pivot(status, states).count()
    return spine.join(counts, keys, "left").na.fill(0, states).withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in states]))


def inbox_daily(messages: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(day, received, unread): distinct messages of each day, filtered by a contained word in any case."""
    low = F.lower("subject")
    if include:
        messages = messages.filter(F.instr(low, include.lower()) > 0)
    if exclude:
        messages = messages.filter(F.instr(low, exclude.lower()) == 0)
    return messages.groupBy("day").agg(F.countDistinct("message_id").alias("received"), F.countDistinct(F.when(~F.col("seen"), F.col("message_id"))).alias("unread"))


def activation_conflicts(activations: DataFrame) -> DataFrame:
    """Activations (identity, activated_at, retired_at) that begin before the one before has ended."""
    order = Window.partitionBy("identity").orderBy("activated_at", "activation_id")
    before, end = F.lag("activation_id").over(order), F.lag("retired_at").over(order)
    return activations.withColumn("_before", before).withColumn("_end", end).filter(F.col("_before").isNotNull() & (F.col("_end").isNull() | (F.col("_end") > F.col("activated_at")))).drop("_before", "_end")
