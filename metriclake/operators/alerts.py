"""Alert rules of nine types, evaluated for all their sites and days at once.

Each type has a measure: rows (rule_type, site_id, key, day, value, baseline, n_baseline), where key says which source, metric
or goal it is of. A rule on a day is one equality join with the measures; value is null where the inputs are not complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which fields a rule of each type must have, and which it must not have.
FIELDS = {
    "sync_failure": (("source", "threshold"), ("comparison",)),
    "stale_data": (("source", "threshold"), ("comparison",)),
    "missing_binding": (("source", "threshold"), ("comparison",)),
    "coverage_drop": (("threshold",), ("comparison",)),
    "absolute_threshold": (("threshold",), ("comparison",)),
    "relative_change": (("comparison",), ("threshold",)),
    "zero_after_nonzero": (("comparison",), ("threshold",)),
    "cross_provider_divergence": (("threshold",), ("comparison", "source")),
    "goal_change": (("comparison", "goal_version_id"), ("threshold", "source")),
}
#: Types that compare with a baseline.
RELATIVE = ("coverage_drop", "relative_change", "zero_after_nonzero", "goal_change")


def day_number() -> Column:
    return F.datediff("day", F.lit("1970-01-01").cast("date"))


def key_of(*parts: str | Column) -> Column:
    """One string of several, nulls told from empty strings."""
    return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})


def _measure(rule_type: str, rows: DataFrame, key: Column, value: Column, baseline: Column | None = None, n_baseline: Column | None = None) -> DataFrame:
    null, none = F.lit(None).cast("double"), F.lit(0)
    return rows.select(F.lit(rule_type).alias("rule_type"), "site_id", key.alias("key"), "day", value.cast("double").alias("value"), (null if baseline is None else baseline.cast("double")).alias("baseline"), (none if n_baseline is None else n_baseline).cast("long").alias("n_baseline"))


def runs_as_of(days: DataFrame, runs: DataFrame) -> DataFrame:
    """site_id, source, day, failures, through: failed runs in a row at the end of each day, and how far successful ones reach."""
    own = ["site_id", "source"]
    order = Window.partitionBy(*own).orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("status") == "success"
    ended = runs.filter("finished_at IS NOT NULL").withColumn("_ok", F.sum(ok.cast("int")).over(order)).withColumn("through", F.max(F.when(ok, F.col("window_end"))).over(order))
    streak = F.sum((~ok).cast("int")).over(Window.partitionBy(*own, "_ok").orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0))
    daily = ended.withColumn("failures", streak).groupBy(*own, F.to_date("finished_at").alias("day")).agg(F.max_by(F.struct("failures", "through"), F.struct("finished_at", "run_id")).alias("_state"))
    spine = days.select("site_id", "day").distinct().join(runs.select(*own).distinct(), "site_id")
    before = Window.partitionBy(*own).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carried = spine.join(daily, [*own, "day"], "full").withColumn("_state", F.last("_state", True).over(before))
    return carried.select(*own, "day", "_state.failures", "_state.through")


def measures(days: DataFrame, cells: DataFrame, runs: DataFrame, bindings: DataFrame, goals: DataFrame, baseline_days: int) -> DataFrame:
    """The measures of all types; see `evaluate` for the tables."""
    state = runs_as_of(days, runs)
    bound = days.select("site_id", "day").distinct().join(bindings, "site_id").filter("bound_from <= day")
    bound = bound.groupBy("site_id", "source", "day").agg(F.max(F.least(F.coalesce("bound_to", "day"), F.col("day"))).alias("last"))

    known = F.when(F.col("complete"), F.col("value"))
    series = Window.partitionBy("site_id", "source", "metric")
    recent, earlier = series.orderBy(day_number()).rangeBetween(-baseline_days, -1), series.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    values = cells.withColumns({"_known": known, "_n": F.count(known).over(recent), "_mean": F.avg(known).over(recent), "_last": F.last(known, True).over(earlier), "_seen": F.count(known).over(earlier)})

    counted = [F.count_if("complete").alias("done"), F.count("*").alias("n")]
    covered = cells.groupBy("site_id", "source", "day").agg(*counted).unionByName(cells.groupBy("site_id", "day").agg(*counted).withColumn("source", F.lit(None).cast("string")))
    surface = Window.partitionBy("site_id", "source").orderBy(day_number())
    now, before = surface.rangeBetween(1 - baseline_days, 0), surface.rangeBetween(1 - 2 * baseline_days, -baseline_days)
    covered = covered.withColumns({"_now": F.sum("done").over(now) / F.sum("n").over(now), "_before": F.sum("done").over(before) / F.sum("n").over(before), "_days": F.count("*").over(before)})

    both = cells.groupBy("site_id", "metric", "day").agg(F.count_distinct("source").alias("n"), F.bool_and("complete").alias("complete"), F.min("value").alias("low"), F.max("value").alias("high"))
    apart = F.when(F.col("complete") & (F.col("n") > 1), F.when(F.col("high") == F.col("low"), 0.0).otherwise((F.col("high") - F.col("low")) / F.greatest(F.abs("high"), F.abs("low")) * 100))
    past = Window.partitionBy("site_id", "goal_version_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    reached = goals.withColumns({"_known": known, "_last": F.last(known, True).over(past), "_seen": F.count(known).over(past)})

    one, pair = key_of("source"), key_of("source", "metric")
    parts = [
        _measure("sync_failure", state, one, F.col("failures")),
        _measure("stale_data", state, one, F.datediff("day", F.date_sub(F.to_date("through"), 1))),
        _measure("missing_binding", bound, one, F.datediff("day", "last")),
        _measure("coverage_drop", covered, one, F.col("_now"), F.col("_before"), F.col("_days")),
        _measure("absolute_threshold", values, pair, F.col("_known")),
        _measure("relative_change", values, pair, F.col("_known"), F.col("_mean"), F.col("_n")),
        _measure("zero_after_nonzero", values, pair, F.col("_known"), F.col("_last"), F.col("_seen")),
        _measure("cross_provider_divergence", both, key_of("metric"), apart),
        _measure("goal_change", reached, key_of("goal_version_id"), F.col("_known"), F.col("_last"), F.col("_seen")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _by_type(of: dict[str, Column]) -> Column:
    return reduce(lambda so_far, kind: so_far.when(F.col("rule_type") == kind, of[kind]), of, F.when(F.lit(False), F.lit(None)))


def evaluate(rules: DataFrame, days: DataFrame, cells: DataFrame, runs: DataFrame, bindings: DataFrame, goals: DataFrame, baseline_days: int = 7) -> DataFrame:
    """A row for each rule, site of it and day: rule, site_id, day, value, baseline, state, incident.

    rules: rule, rule_type, site_ids (null: all), source, metric, goal_version_id, threshold, comparison (percent; of
    zero_after_nonzero the least earlier value that counts), minimum_baseline, maturity_lag_days (days that it looks back),
    quiet_periods (array of "HH:MM-HH:MM", also over midnight). days: site_id, day, at (when it is evaluated). cells: site_id,
    source, metric, day, value, complete, one row each. runs: run_id, site_id, source, status, finished_at, window_end. bindings:
    site_id, source, bound_from, bound_to (null: still bound; its last day). goals: goal_version_id, site_id, day, value, complete.

    state is error if the rule lacks a field that its type needs, has one that it must not have, or is of no known type;
    suppressed_incomplete where the inputs aren't complete; insufficient_baseline where fewer than minimum_baseline values
    stand before, or the baseline of a percentage is zero; suppressed_quiet for what would be triggered in a quiet period;
    else triggered or clear. A source that was never bound is missing. Days in a row on which a rule is triggered are one
    incident, named by its first day. baseline_days are those of relative_change and coverage_drop; zero_after_nonzero
    and goal_change compare with the last complete value, however long ago.
    """
    wrong = {kind: reduce(Column.__or__, [F.col(f).isNull() for f in need] + [F.col(f).isNotNull() for f in no]) for kind, (need, no) in FIELDS.items()}
    key = {kind: key_of("source") for kind in ("sync_failure", "stale_data", "missing_binding", "coverage_drop")}
    key |= {kind: key_of("source", "metric") for kind in ("absolute_threshold", "relative_change", "zero_after_nonzero")}
    key |= {"cross_provider_divergence": key_of("metric"), "goal_change": key_of("goal_version_id")}
    ready = rules.withColumn("_wrong", F.coalesce(_by_type(wrong), F.lit(True))).withColumn("key", _by_type(key))
    some = ready.filter("site_ids IS NOT NULL").withColumn("site_id", F.explode(F.array_distinct("site_ids")))
    every = ready.filter("site_ids IS NULL").join(days.select("site_id").distinct())  # a row for each site of a rule
    due = some.unionByName(every).join(days, "site_id").withColumnRenamed("day", "_due").withColumn("day", F.expr("date_sub(_due, CAST(maturity_lag_days AS INT))"))
    rows = due.join(measures(days, cells, runs, bindings, goals, baseline_days), ["rule_type", "site_id", "key", "day"], "left")

    value, base, limit, share = F.col("value"), F.col("baseline"), F.col("threshold"), F.col("comparison")
    change = F.abs(value - base) / F.abs(base) * 100
    fired = {kind: value >= limit for kind in ("sync_failure", "stale_data", "absolute_threshold", "cross_provider_divergence")}
    fired |= {"missing_binding": value.isNull() | (value >= limit), "coverage_drop": F.round((base - value) * 100, 9) >= limit}
    fired |= {"relative_change": change >= share, "goal_change": change >= share, "zero_after_nonzero": (value == 0) & (base > 0) & (base >= share)}
    few = F.col("rule_type").isin(*RELATIVE) & ((F.col("n_baseline") < F.col("minimum_baseline")) | base.isNull())
    nothing = F.col("rule_type").isin("relative_change", "goal_change") & (base == 0)
    clock = F.date_format("at", "HH:mm")

    def within(period: Column) -> Column:
        low, high = F.substring(period, 1, 5), F.substring(period, 7, 5)
        return F.when(low <= high, (clock >= low) & (clock < high)).otherwise((clock >= low) | (clock < high))

    quiet = F.coalesce(F.exists("quiet_periods", within), F.lit(False))
    missing = value.isNull() & (F.col("rule_type") != "missing_binding")
    state = F.when(F.col("_wrong"), "error").when(missing, "suppressed_incomplete").when(few | nothing, "insufficient_baseline").when(~F.coalesce(_by_type(fired), F.lit(False)), "clear").when(quiet, "suppressed_quiet").otherwise("triggered")
    out = rows.select("rule", "site_id", F.col("_due").alias("day"), "value", "baseline", state.alias("state"))
    own = Window.partitionBy("rule", "site_id")
    islands = out.withColumn("_island", F.count_if(F.col("state") != "triggered").over(own.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("state") == "triggered", F.col("day"))).over(Window.partitionBy("rule", "site_id", "_island"))
    return islands.withColumn("incident", F.when(F.col("state") == "triggered", first)).drop("_island")
