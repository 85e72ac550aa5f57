"""Queries that compose the operators into reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from metriclake import catalog
from metriclake.operators import facts, reports as ops
from metriclake.operators.coverage import each_of
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

HALF = "day < DATE '2024-01-16'"
SUMS = "s AS (SELECT metric, site_id, source, CAST(SUM(value) FILTER (NOT early) AS DOUBLE) AS cur, CAST(SUM(value) FILTER (early) AS DOUBLE) AS prev FROM (SELECT *, day < DATE '2024-01-16' AS early FROM facts WHERE metric <> 'search.position') GROUP BY ALL) "


def halves(t: Tables):
    """Sums of both halves of the month, as complete but for one site's clicks."""
    some = t.facts.filter("metric <> 'search.position'").withColumn("early", F.col("start_ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    rows = some.groupBy("metric", "site_id", "source", "early").agg(F.sum("value").cast("double").alias("value")).withColumn("complete", ~((F.col("metric") == "search.clicks") & (F.col("site_id") == "site-5")))
    return rows.filter("NOT early").drop("early"), rows.filter("early").drop("early")


TOTALS = SUMS + ", t AS (SELECT metric, SUM(cur) AS value, SUM(prev) AS p, metric <> 'search.clicks' AS complete, MIN(source) AS source FROM s GROUP BY metric), totals AS (SELECT metric, value, CASE WHEN complete THEN p END AS previous_value, CASE WHEN complete THEN round((value - p) / p * 100, 2) END AS change_percent, complete AS comparable, source FROM t) "


def totals(t: Tables):
    return ops.summary_totals(*halves(t), catalog.metric_catalog(t.spark))


@query("summary_totals", TOTALS + "SELECT * FROM totals", "facts")
def _(t: Tables):
    return totals(t)


@query("metric_card", TOTALS + "SELECT metric, CASE WHEN value IS NULL THEN 'withheld' WHEN previous_value IS NULL THEN 'no_comparison' WHEN value = previous_value THEN 'unchanged' ELSE 'changed' END AS state FROM totals", "facts")
def _(t: Tables):
    return ops.metric_card(totals(t)).select("metric", "state")


VALUES = "v AS (SELECT site_id, metric, CAST(SUM(value) AS DOUBLE) AS value, CASE WHEN site_id = 'site-5' AND metric = 'search.clicks' THEN 'partial' ELSE 'complete' END AS status FROM facts WHERE metric <> 'search.position' GROUP BY site_id, metric) "


def values(t: Tables):
    rows = t.facts.filter("metric <> 'search.position'").groupBy("site_id", "metric").agg(F.sum("value").cast("double").alias("value"))
    return rows.withColumn("status", F.when((F.col("site_id") == "site-5") & (F.col("metric") == "search.clicks"), "partial").otherwise("complete"))


@query(
    "ratio_cards",
    VALUES
    + "SELECT 'pages_per_impression' AS card, 'observed' AS state, COUNT(*) AS n_sites, round(SUM(a.value) / SUM(b.value), 9) AS ratio FROM v a JOIN v b USING (site_id) WHERE a.metric = 'web.pageviews' AND b.metric = 'search.impressions' UNION ALL SELECT 'ctr', 'withheld', COUNT(DISTINCT site_id), NULL FROM v WHERE metric = 'search.clicks' UNION ALL SELECT 'orders_per_page', 'not_measured', 0, NULL",
    "facts",
)
def _(t: Tables):
    cards = [("pages_per_impression", "web.pageviews", "search.impressions"), ("ctr", "search.clicks", "search.impressions"), ("orders_per_page", "shop.orders", "web.pageviews")]
    return ops.ratio_cards(values(t), cards).withColumn("ratio", F.round("ratio", 9))


@query("site_pulse", VALUES + "SELECT site_id, MAX(value) FILTER (metric = 'search.impressions' AND status = 'complete') AS impressions, MAX(value) FILTER (metric = 'search.clicks' AND status = 'complete') AS clicks, MAX(value) FILTER (metric = 'web.pageviews' AND status = 'complete') AS pageviews FROM v GROUP BY site_id", "facts")
def _(t: Tables):
    out = ops.site_pulse(values(t), ["search.impressions", "search.clicks", "web.pageviews"])
    return out.toDF("site_id", "impressions", "clicks", "pageviews")


RULES = (
    "failed AS (SELECT DISTINCT binding_key AS subject FROM runs WHERE status = 'failed'), pending AS (SELECT DISTINCT site || '' AS subject FROM forms WHERE status = 'pending' GROUP BY site, month HAVING COUNT(*) > 2), items AS (SELECT 'run_failed' AS rule, 'critical' AS severity, subject FROM failed UNION ALL SELECT 'forms_pending', 'warning', subject FROM pending UNION ALL SELECT 'site_seen', 'info', site_id FROM (SELECT DISTINCT site_id FROM hits)) "
)


def attention(t: Tables):
    failed = t.runs.filter("status = 'failed'").select(F.col("binding_key").alias("subject")).distinct()
    pending = t.forms.filter("status = 'pending'").groupBy("site", "month").count().filter("count > 2").select(F.col("site").alias("subject")).distinct()
    return ops.attention(("run_failed", "critical", failed), ("forms_pending", "warning", pending), ("site_seen", "info", t.hits.select(F.col("site_id").alias("subject")).distinct()))


@query("attention_items", RULES + "SELECT rule, severity, subject FROM items", "runs", "forms")
def _(t: Tables):
    return attention(t)


@query("attention_order", RULES + "SELECT severity, COUNT(*) AS n FROM items GROUP BY severity", "runs", "forms")
def _(t: Tables):
    return attention(t).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "goal_measure",
    VALUES
    + "SELECT 'views' AS goal, site_id, value, CASE WHEN value >= 250 THEN 'met' ELSE 'missed' END AS state FROM v WHERE metric = 'web.pageviews' UNION ALL SELECT 'ctr', a.site_id, CASE WHEN a.status = 'complete' THEN round(a.value / b.value, 9) END, CASE WHEN a.status <> 'complete' THEN 'withheld' WHEN a.value / b.value >= 1 THEN 'met' ELSE 'missed' END FROM v a JOIN v b USING (site_id) WHERE a.metric = 'search.clicks' AND b.metric = 'search.impressions'",
    "facts",
)
def _(t: Tables):
    cells = values(t).withColumn("expected", F.lit(10)).withColumn("covered", F.when(F.col("status") == "complete", 10).otherwise(5))
    names = ("goal", "metric", "denominator", "target", "minimum_coverage")
    goals = [("views", "web.pageviews", None, 250.0, 0.8), ("ctr", "search.clicks", "search.impressions", 1.0, 0.8)]
    per_site = each_of(cells.select("site_id").distinct(), [dict(zip(names, g, strict=True)) for g in goals])
    return ops.evaluate_goals(per_site, cells).withColumn("value", F.round("value", 9))


@query(
    "alert_evaluate",
    "d AS (SELECT site_id AS series, day, CAST(a AS DOUBLE) AS value, day(day) % 11 <> 0 AS complete FROM pair), w AS (SELECT *, COUNT(CASE WHEN complete THEN value END) OVER b AS n, AVG(CASE WHEN complete THEN value END) OVER b AS mean FROM d WINDOW b AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)), r AS (SELECT unnest(['high', 'fall', 'gone']) AS rule, unnest(['above', 'drop_percent', 'missing']) AS kind, unnest([12.0, 30.0, 0.0]) AS threshold)"
    " SELECT rule, series, day, CASE WHEN NOT complete THEN 'suppressed' WHEN kind = 'drop_percent' AND (n < 4 OR mean = 0) THEN 'insufficient_baseline' WHEN coalesce(CASE kind WHEN 'above' THEN value > threshold WHEN 'drop_percent' THEN (value - mean) / mean * 100 <= -threshold ELSE value IS NULL END, false) THEN 'triggered' ELSE 'clear' END AS state FROM w, r",
    "pair",
)
def _(t: Tables):
    days = t.pair.select(F.col("site_id").alias("series"), "day", F.col("a").cast("double").alias("value"), (F.dayofmonth("day") % 11 != 0).alias("complete"))
    rules = [{"rule": r, "kind": k, "threshold": x} for r, k, x in (("high", "above", 12.0), ("fall", "drop_percent", 30.0), ("gone", "missing", 0.0))]
    return ops.evaluate_alerts(days, rules, baseline_days=4)


@query("period_report", SUMS + "SELECT metric, site_id, source, cur AS value, prev AS previous_value, CASE WHEN prev <> 0 THEN round((cur - prev) / prev * 100, 2) END AS change_percent FROM s WHERE cur IS NOT NULL", "facts")
def _(t: Tables):
    from metriclake.operators.coverage import with_comparison

    current, previous = halves(t)
    rows = with_comparison(current.withColumn("complete", F.lit(True)), previous.withColumn("complete", F.lit(True)).drop("source"), ["metric", "site_id"])
    return rows.select("metric", "site_id", "source", "value", "previous_value", "change_percent")


@query("report_rows_export", SUMS + "SELECT 'row' AS record, metric, site_id, source, cur AS value, NULL::DOUBLE AS ratio, 'monthly' AS report FROM s WHERE cur IS NOT NULL UNION ALL SELECT 'comparison', 'search.clicks', site_id, NULL, NULL, round(SUM(a)::DOUBLE / SUM(b), 6), 'monthly' FROM pair WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY site_id", "facts", "pair")
def _(t: Tables):
    rows = halves(t)[0].drop("complete")
    both = t.pair.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("site_id").agg(F.round(F.sum("a") / F.sum("b"), 6).alias("ratio")).withColumn("metric", F.lit("search.clicks"))
    return ops.export_rows(rows, both, {"report": "monthly"})


SERIES = "SELECT site_id, day, CAST(SUM(value) AS DOUBLE) AS value, CASE WHEN day < DATE '2024-01-16' THEN 'comparison' ELSE 'current' END AS period FROM facts WHERE metric = 'search.clicks' GROUP BY site_id, day"


@query("series_export", SERIES, "facts")
def _(t: Tables):
    days = t.facts.filter("metric = 'search.clicks'").groupBy("site_id", F.to_date("start_ts").alias("day")).agg(F.sum("value").cast("double").alias("value"))
    cut = F.lit("2024-01-16").cast("date")
    return ops.export_series(days.filter(F.col("day") >= cut), days.filter(F.col("day") < cut))


@query("plot_series", "SELECT day, CAST(SUM(value) AS DOUBLE) AS value, COUNT(DISTINCT site_id) AS n_sites FROM facts WHERE metric = 'search.impressions' AND search_type = 'web' AND site_id IN ('site-1', 'site-4') GROUP BY day", "facts")
def _(t: Tables):
    some = facts.filter_surface(t.facts.filter("metric = 'search.impressions' AND site_id IN ('site-1', 'site-4')"), "web")
    return some.groupBy(F.to_date("start_ts").alias("day")).agg(F.sum("value").cast("double").alias("value"), F.countDistinct("site_id").alias("n_sites"))


@query("route_observation_export", "SELECT site_id, day, route, metric, CAST(value AS DOUBLE) AS value FROM facts WHERE source = 'web' AND site_id = 'site-3'", "facts")
def _(t: Tables):
    rows = t.facts.filter("source = 'web' AND site_id = 'site-3'")
    return rows.select("site_id", F.to_date("start_ts").alias("day"), F.col("dims")["route"].alias("route"), "metric", F.col("value").cast("double").alias("value"))


@query("load_fixture_points", "SELECT site_id AS resource_id, day AS date, 'hits' AS metric, CAST(COUNT(*) AS DOUBLE) AS value, event_type AS kind FROM hits GROUP BY ALL", "hits")
def _(t: Tables):
    points = t.hits.groupBy("site_id", "day", "event_type").agg(F.count("*").alias("value"))
    point = F.struct(F.col("site_id").alias("resource_id"), F.date_format("day", "yyyy-MM-dd").alias("date"), F.lit("hits").alias("metric"), F.lit("count").alias("unit"), "value", F.create_map(F.lit("kind"), F.col("event_type")).alias("dimensions"))
    texts = points.groupBy("site_id").agg(F.to_json(F.struct(F.collect_list(point).alias("points"))).alias("text"))  # one text per site, as such files come
    return ops.json_facts(texts, F.col("text")).select("resource_id", "date", "metric", F.col("value").cast("double").alias("value"), F.col("dimensions")["kind"].alias("kind"))


@query("land_provider_json", "SELECT site_id, route, metric, CAST(value AS DOUBLE) AS value FROM (SELECT site_id, route, SUM(impressions) AS impressions, SUM(clicks) AS clicks FROM cells GROUP BY ALL) UNPIVOT (value FOR metric IN (impressions, clicks))", "cells")
def _(t: Tables):
    sums = t.cells.groupBy("site_id", "route").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    row = F.struct(F.array("route").alias("keys"), F.array("impressions", "clicks").alias("values"))
    answer = F.to_json(F.struct(F.array(F.lit("route")).alias("dimensions"), F.array(F.lit("impressions"), F.lit("clicks")).alias("metrics"), F.array(row).alias("rows")))
    texts = sums.select("site_id", answer.alias("text"))
    return ops.landed_series(texts, F.col("text")).select("site_id", F.col("dims")["route"].alias("route"), "metric", "value")
