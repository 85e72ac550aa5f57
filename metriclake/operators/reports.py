"""Reports made of the other operators: totals, cards, attention items, goals, alerts, exports.

Goals and alerts follow their published contract: the definitions name metrics and thresholds, and a result is
withheld, not guessed, where its inputs are not complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.operators.coverage import each_of, percent_change


def summary_totals(current: DataFrame, previous: DataFrame, catalog: DataFrame) -> DataFrame:
    """One total per metric of two periods (metric, site_id, source, value, complete).

    A sum that is proven complete and has no rows is zero; a weighted metric needs complete coverage; more
    than one source withholds the value; the previous value needs both periods complete with one source, and
    daily-unique metrics are never compared.
    """

    def period(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.groupBy("metric").agg(F.sum("value").alias(f"sum{suffix}"), F.bool_and("complete").alias(f"complete{suffix}"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("source"))).alias(f"sources{suffix}"), F.min("source").alias(f"source{suffix}"))

    rows = period(current, "").join(period(previous, "_p"), "metric", "left").join(F.broadcast(catalog.select("metric", "aggregation")), "metric")
    mixed = F.col("sources") > 1
    value = F.when(mixed, None).when((F.col("aggregation") == "weighted") & ~F.col("complete"), None).when(F.col("sum").isNull() & (F.col("aggregation") == "sum") & F.col("complete"), 0).otherwise(F.col("sum"))
    comparable = F.col("complete") & F.coalesce("complete_p", F.lit(False)) & (F.col("source") == F.col("source_p")) & ~mixed & (F.col("aggregation") != "daily-unique")
    out = rows.withColumn("value", value).withColumn("comparable", F.coalesce(comparable, F.lit(False)))
    out = out.withColumn("previous_value", F.when(F.col("comparable"), F.coalesce("sum_p", F.when(F.col("aggregation") == "sum", 0))))
    return out.select("metric", "value", "previous_value", percent_change(F.col("value"), F.col("previous_value")).alias("change_percent"), "comparable", F.when(mixed, "mixed").otherwise(F.col("source")).alias("source"))


def ratio_cards(values: DataFrame, cards: list[tuple[str, str, str]]) -> DataFrame:
    """Ratios (name, numerator metric, denominator metric) over the sites that measure both.

    values: site_id, metric, value, status (complete, partial, unavailable). not_measured where no site has
    both, withheld where a site's input is not complete, unavailable over zero, else observed.
    """
    definitions = values.sparkSession.createDataFrame(cards, "card string, numerator string, denominator string")
    top = values.select("site_id", F.col("metric").alias("numerator"), F.col("value").alias("n"), F.col("status").alias("ns"))
    bottom = values.select("site_id", F.col("metric").alias("denominator"), F.col("value").alias("d"), F.col("status").alias("ds"))
    both = F.broadcast(definitions).join(top, "numerator").join(bottom, ["denominator", "site_id"]).groupBy("card").agg(
        F.count("*").alias("n_sites"), F.bool_and((F.col("ns") == "complete") & (F.col("ds") == "complete")).alias("complete"), F.sum("n").alias("n"), F.sum("d").alias("d")
    )
    state = F.when(F.col("n_sites").isNull(), "not_measured").when(~F.col("complete"), "withheld").when(F.coalesce("d", F.lit(0)) == 0, "unavailable").otherwise("observed")
    out = definitions.join(both, "card", "left").withColumn("state", state)
    return out.select("card", "state", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.when(F.col("state") == "observed", F.col("n") / F.col("d")).alias("ratio"))


def metric_card(totals: DataFrame) -> DataFrame:
    """The state of each total: withheld, no_comparison, new, changed, unchanged."""
    state = F.when(F.col("value").isNull(), "withheld").when(F.col("previous_value").isNull(), "no_comparison").when((F.col("previous_value") == 0) & (F.col("value") != 0), "new").when(F.col("value") == F.col("previous_value"), "unchanged").otherwise("changed")
    return totals.withColumn("state", state)


def site_pulse(values: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per site with a column for each metric: the value where it is complete. A metric that a site has from
    several sources is withheld, as none of them is the one to show."""
    shown = values.withColumn("shown", F.when(F.col("status") == "complete", F.coalesce("value", F.lit(0))))
    return shown.groupBy("site_id").pivot("metric", metrics).agg(F.when(F.count("status") <= 1, F.max("shown")))


#: Severities in the order in which items are shown (fixed values).
SEVERITY = ("critical", "warning", "info")


def attention(*rules: tuple[str, str, DataFrame]) -> DataFrame:
    """Items of all rules (id, severity, rows with a subject) in order of severity, rule and subject."""
    parts = [rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("subject").cast("string").alias("subject")) for rule, severity, rows in rules]
    return attention_order(reduce(DataFrame.unionByName, parts))


def attention_order(items: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return items.orderBy(F.when(rank == 0, len(SEVERITY) + 1).otherwise(rank), "rule", "subject")


def evaluate_goals(goals: DataFrame, values: DataFrame) -> DataFrame:
    """Goals (goal, site_id, metric, denominator or null, target, minimum_coverage) against values (site_id,
    metric, value, covered, expected): met, missed, or withheld below the coverage."""
    share = F.col("covered") / F.col("expected")
    top = values.select("site_id", "metric", F.col("value").alias("_v"), share.alias("_c"))
    bottom = values.select("site_id", F.col("metric").alias("denominator"), F.col("value").alias("_d"), share.alias("_dc"))
    rows = goals.join(top, ["site_id", "metric"], "left").join(bottom, ["site_id", "denominator"], "left")
    ratio = F.col("denominator").isNotNull()
    enough = (F.coalesce("_c", F.lit(0.0)) >= F.col("minimum_coverage")) & (~ratio | (F.coalesce("_dc", F.lit(0.0)) >= F.col("minimum_coverage")))
    value = F.when(ratio, F.when(F.col("_d") > 0, F.col("_v") / F.col("_d"))).otherwise(F.coalesce("_v", F.lit(0.0)))
    out = rows.withColumn("value", F.when(enough, value))
    state = F.when(~enough, "withheld").when(F.col("value").isNull(), "unavailable").when(F.col("value") >= F.col("target"), "met").otherwise("missed")
    return out.withColumn("state", state).select("goal", "site_id", "value", "state")


def evaluate_alerts(days: DataFrame, rules: list[dict], baseline_days: int = 7) -> DataFrame:
    """Rules (rule, kind, threshold) for daily values (series, day, value or null, complete).

    Kinds: above, below (the value), drop_percent, rise_percent (against the mean of the complete days of the
    baseline before), missing (no value although complete). A day that isn't complete is suppressed; without
    a full baseline a relative rule says insufficient_baseline.
    """
    seconds = F.datediff("day", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("series").orderBy(seconds).rangeBetween(-baseline_days, -1)
    known = F.when(F.col("complete"), F.col("value"))
    rows = each_of(days.withColumn("_n", F.count(known).over(before)).withColumn("_mean", F.avg(known).over(before)), rules)
    relative = F.col("kind").isin("drop_percent", "rise_percent")
    change = (F.col("value") - F.col("_mean")) / F.col("_mean") * 100
    fired = (
        F.when(F.col("kind") == "above", F.col("value") > F.col("threshold"))
        .when(F.col("kind") == "below", F.col("value") < F.col("threshold"))
        .when(F.col("kind") == "drop_percent", change <= -F.col("threshold"))
        .when(F.col("kind") == "rise_percent", change >= F.col("threshold"))
        .otherwise(F.col("value").isNull())
    )
    state = F.when(~F.col("complete"), "suppressed").when(relative & ((F.col("_n") < baseline_days) | (F.col("_mean") == 0)), "insufficient_baseline").when(F.coalesce(fired, F.lit(False)), "triggered").otherwise("clear")
    return rows.select("rule", "series", "day", state.alias("state"))


def export_rows(rows: DataFrame, comparison: DataFrame, context: dict[str, str]) -> DataFrame:
    """Report rows and comparison rows as one flat table with the report's context on every row."""
    both = rows.withColumn("record", F.lit("row")).unionByName(comparison.withColumn("record", F.lit("comparison")), allowMissingColumns=True)
    return both.withColumns({k: F.lit(v) for k, v in context.items()})


def export_series(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.withColumn("period", F.lit("current")).unionByName(previous.withColumn("period", F.lit("comparison")))


def json_facts(texts: DataFrame, column: Column) -> DataFrame:
    """Facts of JSON texts {"points": [{resource_id, date, metric, unit, value, dimensions}]}; a text that isn't
    such JSON has none."""
    schema = "points array<struct<resource_id: string, date: date, metric: string, unit: string, value: decimal(38,9), dimensions: map<string,string>>>"
    return texts.select(F.explode(F.from_json(column, schema)["points"]).alias("p")).select("p.*")


def landed_series(texts: DataFrame, column: Column) -> DataFrame:
    """Rows of a provider's answer {"dimensions": [..], "rows": [{"keys": [..], "values": [..]}], "metrics": [..]}
    as one fact per row and metric."""
    schema = "dimensions array<string>, metrics array<string>, rows array<struct<keys: array<string>, values: array<double>>>"
    rows = texts.select("*", F.from_json(column, schema).alias("j")).select(*texts.columns, F.col("j.dimensions").alias("dimensions"), F.col("j.metrics").alias("metrics"), F.explode("j.rows").alias("r"))
    points = rows.select(*texts.columns, F.map_from_arrays("dimensions", "r.keys").alias("dims"), F.explode(F.arrays_zip(F.col("metrics").alias("metric"), F.col("r.values").alias("value"))).alias("m"))
    return points.select(*texts.columns, "dims", F.col("m.metric").alias("metric"), F.col("m.value").alias("value"))
