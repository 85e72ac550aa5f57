"""Queries over runs, coverage, gaps and provider comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from metriclake import catalog
from metriclake.operators import coverage as ops
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

SPINE = "spine AS (SELECT site_id, source, CAST(d AS DATE) AS day FROM (SELECT DISTINCT site_id FROM hits), (SELECT unnest(['search', 'web']) AS source), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d)) "
OK = "(SELECT DISTINCT site_id, source, day FROM runs WHERE status = 'success')"
MATRIX = (
    "matrix AS (SELECT s.site_id, m.metric, s.source, s.day, p.day IS NOT NULL OR o.day IS NOT NULL AS covered FROM (SELECT * FROM spine) s"
    " JOIN (SELECT unnest(['search.impressions', 'search.clicks', 'web.pageviews']) AS metric, unnest(['search', 'search', 'web']) AS source) m ON m.source = s.source"
    " LEFT JOIN (SELECT DISTINCT site_id, metric, day FROM facts WHERE value >= 2) p ON p.site_id = s.site_id AND p.metric = m.metric AND p.day = s.day"
    f" LEFT JOIN {OK} o ON o.site_id = s.site_id AND o.source = s.source AND o.day = s.day) "
)


def spine(t: Tables):
    return ops.expected_cells(t.hits.select("site_id").distinct(), [{"source": "search"}, {"source": "web"}], "2024-01-01", "2024-01-30")


def matrix(t: Tables):
    metrics = [{"metric": m, "source": s} for m, s, *_ in catalog.METRICS if m in ("search.impressions", "search.clicks", "web.pageviews")]
    expected = ops.expected_cells(t.hits.select("site_id").distinct(), metrics, "2024-01-01", "2024-01-30")
    present = t.facts.filter("value >= 2").withColumn("day", F.to_date("start_ts"))
    return ops.coverage(expected, present, ops.covered_cells(spine(t), t.runs))


@query("spine_cross_join", SPINE + "SELECT site_id, source, day FROM spine", "hits")
def _(t: Tables):
    return spine(t)


@query("run_coverage_join", SPINE + f"SELECT site_id, source, day FROM spine SEMI JOIN {OK} USING (site_id, source, day)", "runs")
def _(t: Tables):
    return ops.covered_cells(spine(t), t.runs)


HOLDS = "r.window_start <= f.start_ts AND least(r.window_end, coalesce(r.data_through, r.window_end)) >= f.end_ts"


@query(
    "attribute_facts_to_runs",
    f"asked AS (SELECT DISTINCT site_id, source, observed_at, start_ts, end_ts FROM facts), ok AS (SELECT * FROM ledger WHERE status = 'success' AND finished_at IS NOT NULL),"
    f" owner AS (SELECT f.site_id, f.source, f.observed_at, f.start_ts, f.end_ts, MIN(run_id) AS run_id, MIN(binding_key) AS binding_key FROM asked f JOIN ok r ON r.site_id = f.site_id AND r.source = f.source AND {HOLDS} AND f.observed_at BETWEEN r.started_at AND r.finished_at WHERE result_kind = 'data' GROUP BY ALL HAVING COUNT(*) = 1),"
    f" newest AS (SELECT f.site_id, f.source, f.start_ts, f.end_ts, arg_max(run_id, (finished_at, run_id)) AS run_id FROM (SELECT DISTINCT site_id, source, start_ts, end_ts FROM asked) f JOIN ok r ON r.site_id = f.site_id AND r.source = f.source AND {HOLDS} GROUP BY ALL)"
    " SELECT client_id, site_id, source, metric, route, search_type, day, run_id FROM facts JOIN owner USING (site_id, source, observed_at, start_ts, end_ts) SEMI JOIN newest USING (site_id, source, start_ts, end_ts, run_id) WHERE binding_key <> 'site-3|web'",
    "facts",
    "ledger",
)
def _(t: Tables):
    """Site 3 gave up its binding to the web provider."""
    facts = t.facts.withColumns({"route": F.col("dims")["route"], "search_type": F.col("dims")["search_type"]})
    bindings = t.ledger.select("binding_key").distinct().filter("binding_key <> 'site-3|web'")
    return ops.attribute(facts, t.ledger, bindings).select("client_id", "site_id", "source", "metric", "route", "search_type", F.to_date("start_ts").alias("day"), "run_id")


def overlapping(t: Tables):
    """Runs of three days, so that several touch a day."""
    return t.runs.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 3 DAYS"))


@query(
    "latest_run_per_day",
    "SELECT site_id, source, day, run_id, status FROM (SELECT r.site_id, r.source, CAST(d AS DATE) AS day, run_id, status, row_number() OVER (PARTITION BY r.site_id, r.source, d ORDER BY finished_at DESC, run_id DESC) AS k FROM (SELECT *, unnest(generate_series(window_start, window_start + INTERVAL 2 DAYS, INTERVAL 1 DAY)) AS d FROM runs) r) WHERE k = 1",
    "runs",
)
def _(t: Tables):
    return ops.latest_run_per_day(overlapping(t))


@query("latest_sync_status", "SELECT binding_key, run_id, status, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY binding_key ORDER BY started_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1", "runs")
def _(t: Tables):
    return ops.latest_sync_status(t.runs).select("binding_key", "run_id", "status", "finished_at")


@query("latest_run_self_join", "SELECT r.site_id, r.run_id FROM runs r JOIN (SELECT site_id, MAX(started_at) AS m FROM runs GROUP BY site_id) x ON x.site_id = r.site_id AND r.started_at = x.m", "runs")
def _(t: Tables):
    last = t.runs.groupBy("site_id").agg(F.max("started_at").alias("started_at"))
    return t.runs.join(last, ["site_id", "started_at"], "left_semi").select("site_id", "run_id")


@query("coverage_matrix", SPINE + ", " + MATRIX + "SELECT site_id, metric, source, day, covered FROM matrix", "facts", "runs")
def _(t: Tables):
    return matrix(t)


STATUS = "COUNT(*) AS expected, COUNT(*) FILTER (covered) AS covered, CASE WHEN COUNT(*) FILTER (covered) = COUNT(*) THEN 'complete' WHEN COUNT(*) FILTER (covered) > 0 THEN 'partial' ELSE 'unavailable' END AS status"


@query("coverage_status_rollup", SPINE + ", " + MATRIX + f"SELECT site_id, source, {STATUS} FROM matrix WHERE day(day) % 6 <> 0 GROUP BY ALL", "facts", "runs")
def _(t: Tables):
    return ops.coverage_status(matrix(t).filter("dayofmonth(day) % 6 <> 0"), "site_id", "source")


@query(
    "coverage_derived_metrics",
    SPINE + ", " + MATRIX + "SELECT site_id, 'search.ctr' AS metric, day, bool_and(covered) AS covered, COUNT(*) FILTER (NOT covered) AS n_missing FROM matrix WHERE source = 'search' GROUP BY site_id, day",
    "facts",
    "runs",
)
def _(t: Tables):
    derived = catalog.metric_catalog(t.spark).filter("metric = 'search.ctr'")
    return ops.with_inputs(matrix(t), derived).select("site_id", "metric", "day", "covered", F.size("missing").cast("long").alias("n_missing"))


@query("source_health", "SELECT source, MAX(window_end) AS data_through, MAX(finished_at) FILTER (status = 'success') AS last_success, COUNT(*) FILTER (status = 'failed') AS n_failed FROM runs GROUP BY source", "runs")
def _(t: Tables):
    return t.runs.groupBy("source").agg(F.max("window_end").alias("data_through"), F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"), F.count_if(F.col("status") == "failed").alias("n_failed"))


@query("operations_health", "SELECT binding_key, run_id, CASE WHEN run_id IS NULL THEN 'never_run' ELSE status END AS state FROM (SELECT site_id || '|' || source AS binding_key FROM (SELECT DISTINCT site_id FROM hits), (SELECT unnest(['search', 'web', 'shop']) AS source)) LEFT JOIN (SELECT binding_key, MAX(run_id) AS run_id, arg_max(status, run_id) AS status FROM runs GROUP BY 1) USING (binding_key)", "runs")
def _(t: Tables):
    sites = t.hits.select("site_id").distinct()
    bound = ops.each_of(sites, [{"source": s} for s in ("search", "web", "shop")]).select(F.concat_ws("|", "site_id", "source").alias("binding_key"))
    return bound.join(ops.latest_sync_status(t.runs).select("binding_key", "run_id", "status"), "binding_key", "left").select("binding_key", "run_id", F.coalesce("status", F.lit("never_run")).alias("state"))


@query("binding_operations", "SELECT site_id, source, CAST(SUM(points_written) AS BIGINT) AS points, COUNT(*) FILTER (status = 'failed') AS n_failed FROM runs GROUP BY ALL", "runs")
def _(t: Tables):
    return t.runs.groupBy("site_id", "source").agg(F.sum("points_written").alias("points"), F.count_if(F.col("status") == "failed").alias("n_failed"))


ISLANDS = "SELECT site_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days FROM (SELECT site_id, day, day - CAST(row_number() OVER (PARTITION BY site_id ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT site_id, day FROM runs WHERE source = 'web' AND status = 'success')) GROUP BY site_id, g"


def web_days(t: Tables):
    return t.runs.filter("source = 'web' AND status = 'success'").select("site_id", F.to_date("window_start").alias("day"))


@query("date_ranges", ISLANDS, "runs")
def _(t: Tables):
    return ops.date_ranges(web_days(t), "site_id")


@query("continuous_through", f"SELECT site_id, arg_min(last_day, first_day) AS through FROM ({ISLANDS}) GROUP BY site_id", "runs")
def _(t: Tables):
    return ops.continuous_through(web_days(t), "site_id")


@query(
    "missing_ranges",
    SPINE + ", " + MATRIX + "SELECT site_id, metric, reason, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days FROM (SELECT *, SUM(n) OVER (PARTITION BY site_id, metric ORDER BY day) AS g FROM (SELECT *, CASE WHEN lag(day) OVER w = day - 1 AND lag(reason) OVER w = reason THEN 0 ELSE 1 END AS n FROM (SELECT site_id, metric, day, CASE WHEN day < DATE '2024-01-15' THEN 'early' ELSE 'late' END AS reason FROM matrix WHERE NOT covered) WINDOW w AS (PARTITION BY site_id, metric ORDER BY day))) GROUP BY site_id, metric, reason, g",
    "facts",
    "runs",
)
def _(t: Tables):
    missing = matrix(t).filter("NOT covered").withColumn("reason", F.when(F.col("day") < F.lit("2024-01-15").cast("date"), "early").otherwise("late"))
    return ops.missing_ranges(missing, ["site_id", "metric"], "reason")


FILLED = SPINE + ", " + MATRIX + ", filled AS (SELECT m.site_id, m.metric, m.day, m.covered, CASE WHEN v.value IS NULL AND m.covered THEN 0 ELSE v.value END AS value FROM matrix m LEFT JOIN (SELECT site_id, metric, day, CAST(SUM(value) AS DOUBLE) AS value FROM facts GROUP BY ALL) v ON v.site_id = m.site_id AND v.metric = m.metric AND v.day = m.day) "


def filled(t: Tables):
    values = t.facts.groupBy("site_id", "metric", F.to_date("start_ts").alias("day")).agg(F.sum("value").cast("double").alias("value"))
    return ops.fill_zero(matrix(t).select("site_id", "metric", "day", "covered"), values, ["site_id", "metric", "day"])


@query("fill_proven_zero_series", FILLED + "SELECT site_id, metric, day, covered, value FROM filled", "facts", "runs")
def _(t: Tables):
    return filled(t)


PERIODS = "SELECT site_id, metric, day < DATE '2024-01-16' AS early, SUM(value) AS value, bool_and(covered OR day(day) % 6 = 0) AND site_id <> 'site-2' AS complete FROM filled GROUP BY site_id, metric, day < DATE '2024-01-16'"


def periods(t: Tables):
    early = (F.col("day") < F.lit("2024-01-16").cast("date")).alias("early")
    proven = F.col("covered") | (F.dayofmonth("day") % 6 == 0)
    return filled(t).groupBy("site_id", "metric", early).agg(F.sum("value").alias("value"), (F.bool_and(proven) & (F.col("site_id") != "site-2")).alias("complete"))


PRIOR = (
    FILLED
    + f", periods AS ({PERIODS}) SELECT c.site_id, c.metric, c.value, CASE WHEN c.complete AND p.complete THEN p.value END AS previous_value, CASE WHEN c.complete AND p.complete AND p.value <> 0 THEN round((c.value - p.value) / p.value * 100, 2) END AS change_percent, CASE WHEN NOT (c.complete AND p.complete) THEN 'unknown' WHEN p.value = 0 AND c.value <> 0 THEN 'new' WHEN c.value > p.value THEN 'better' WHEN c.value < p.value THEN 'worse' ELSE 'same' END AS trend FROM periods c JOIN periods p ON p.site_id = c.site_id AND p.metric = c.metric WHERE p.early AND NOT c.early"
)


@query("prior_period_join", PRIOR, "facts", "runs")
def _(t: Tables):
    both = periods(t)
    current, previous = both.filter("NOT early").drop("early"), both.filter("early").drop("early")
    return ops.with_comparison(current, previous, ["site_id", "metric"]).drop("complete")


@query("percent_change", "SELECT site_id, day, CASE WHEN b <> 0 THEN round((a - b)::DOUBLE / b * 100, 2) END AS change, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN b = 0 AND a <> 0 THEN 'new' WHEN a > b THEN 'worse' WHEN a < b THEN 'better' ELSE 'same' END AS trend FROM pair", "pair")
def _(t: Tables):
    return t.pair.select("site_id", "day", ops.percent_change(F.col("a"), F.col("b")).alias("change"), ops.trend_state(F.col("a"), F.col("b"), lower_is_better=True).alias("trend"))


PAIRING = "pairs AS (SELECT site_id, day, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'paired' WHEN a IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS pairing FROM pair WHERE a IS NOT NULL OR b IS NOT NULL) "


@query("provider_pair_join", PAIRING + "SELECT * FROM pairs", "pair")
def _(t: Tables):
    a = t.pair.filter("a IS NOT NULL").select("site_id", "day", "a")
    b = t.pair.filter("b IS NOT NULL").select("site_id", "day", "b")
    return ops.pair_dates(a.join(b, ["site_id", "day"], "full"))


@query("paired_dates", PAIRING + "SELECT site_id, pairing, COUNT(*) AS n_days, MIN(day) AS first_day, MAX(day) AS last_day FROM pairs GROUP BY ALL", "pair")
def _(t: Tables):
    return ops.pair_dates(t.pair).groupBy("site_id", "pairing").agg(F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


DIVERGENCE = """sums AS (SELECT site_id, half, COUNT(*) FILTER (pairing = 'paired') AS paired, COUNT(*) FILTER (pairing <> 'paired') AS unpaired,
 COUNT(*) FILTER (pairing = 'paired' AND a <> b AND (b = 0 OR 5 * a < 4 * b OR 4 * a > 5 * b)) AS outside, COUNT(*) FILTER (pairing = 'paired' AND a <> b) AS different,
 CAST(SUM(a) FILTER (pairing = 'paired') AS BIGINT) AS a, CAST(SUM(b) FILTER (pairing = 'paired') AS BIGINT) AS b FROM (SELECT *, day(day) % 9 % 4 AS half FROM pairs) GROUP BY ALL)
 SELECT *, CASE WHEN paired = 0 THEN 'non_comparable' WHEN unpaired > 0 THEN 'coverage_mismatch' WHEN a < 20 OR b < 20 THEN 'low_volume' WHEN different = 0 THEN 'aligned'
 WHEN outside = 0 THEN 'within_expected_variation' WHEN paired = 1 THEN 'isolated_divergence' WHEN 2 * outside > paired THEN 'persistent_divergence' WHEN 2 * outside < paired THEN 'isolated_divergence' ELSE 'unknown' END AS state FROM sums"""


@query("divergence_state", PAIRING + ", " + DIVERGENCE, "pair")
def _(t: Tables):
    pairs = ops.pair_dates(t.pair).withColumn("half", (F.dayofmonth("day") % 9 % 4).cast("long"))
    return ops.divergence(pairs, "site_id", "half", low=20)


@query(
    "provider_comparison",
    PAIRING + "SELECT site_id, COUNT(*) FILTER (pairing = 'paired') AS paired, CAST(SUM(a) FILTER (pairing = 'paired') AS BIGINT) AS a_total, CAST(SUM(b) FILTER (pairing = 'paired') AS BIGINT) AS b_total, round(SUM(a) FILTER (pairing = 'paired')::DOUBLE / SUM(b) FILTER (pairing = 'paired')::DOUBLE, 6) AS ratio FROM pairs GROUP BY site_id",
    "pair",
)
def _(t: Tables):
    sums = ops.divergence(ops.pair_dates(t.pair), "site_id")
    return sums.select("site_id", "paired", F.col("a").alias("a_total"), F.col("b").alias("b_total"), F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query(
    "route_reconciliation",
    "h AS (SELECT site_id, day, SUM(pageviews) AS value FROM cells WHERE day < DATE '2024-01-20' GROUP BY ALL), r AS (SELECT site_id, day, SUM(pageviews - CASE WHEN site_id = 'site-1' AND k = 77 THEN 1 ELSE 0 END) AS total, bool_and(site_id <> 'site-2') AS final FROM (SELECT *, CAST(split_part(route, '/', 3) AS INTEGER) AS k FROM cells) WHERE site_id <> 'site-3' OR day > DATE '2024-01-02' GROUP BY ALL),"
    " d AS (SELECT site_id, COUNT(*) AS n_days, SUM(value) AS headline_total, SUM(total) AS total, bool_and(coalesce(final, true)) AS final, bool_and(total IS NOT NULL) AS every, bool_and(total = value) AS same FROM h LEFT JOIN r USING (site_id, day) GROUP BY ALL)"
    " SELECT site_id, n_days, CAST(headline_total AS BIGINT) AS headline_total, CAST(CASE WHEN final AND every THEN total END AS BIGINT) AS route_total, CASE WHEN final AND every AND same THEN 'reconciled' ELSE 'withheld' END AS status, CASE WHEN NOT final THEN 'route_coverage_incomplete' WHEN NOT every THEN 'route_facts_absent' WHEN NOT same THEN 'route_sum_differs_from_headline' END AS reason FROM d",
    "cells",
)
def _(t: Tables):
    headline = t.cells.filter("day < DATE'2024-01-20'").groupBy("site_id", "day").agg(F.sum("pageviews").alias("value"))
    lost = F.when((F.col("site_id") == "site-1") & F.col("route").endswith("/77"), 1).otherwise(0)
    routes = t.cells.filter("site_id <> 'site-3' OR day > DATE'2024-01-02'").select("site_id", "day", (F.col("pageviews") - lost).alias("value"), (F.col("site_id") != "site-2").alias("final"))
    return ops.reconcile_routes(routes, headline, "site_id")


@query("provider_history_bounds", "SELECT site_id, source, MIN(day) AS first_day, MAX(day) AS data_through FROM facts WHERE completeness = 'final' GROUP BY ALL", "facts")
def _(t: Tables):
    return t.facts.filter("completeness = 'final'").groupBy("site_id", "source").agg(F.to_date(F.min("start_ts")).alias("first_day"), F.to_date(F.max("start_ts")).alias("data_through"))


@query("final_daily_values", "SELECT site_id, day, CAST(SUM(value) AS DOUBLE) AS value FROM facts WHERE metric = 'web.pageviews' AND completeness = 'final' AND value = floor(value) GROUP BY ALL", "facts")
def _(t: Tables):
    ok = t.facts.filter("metric = 'web.pageviews' AND completeness = 'final' AND value = floor(value) AND end_ts = start_ts + INTERVAL 1 DAY")
    return ok.groupBy("site_id", F.to_date("start_ts").alias("day")).agg(F.sum("value").cast("double").alias("value"))


FORMS = "forms_spine AS (SELECT site, CAST(m AS DATE) AS month FROM (SELECT DISTINCT c_nationkey AS site FROM customer), (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m)) "


def forms_monthly(t: Tables):
    months = F.explode(F.expr("sequence(DATE'1995-01-01', DATE'2001-08-01', INTERVAL 1 MONTH)")).alias("month")
    spine_ = t.base("customer").select(F.col("c_nationkey").alias("site")).distinct().select("site", months)
    return ops.spine_counts(t.forms, spine_, ["site", "month"], "status", ["sent", "pending", "failed"])


FORMS_COUNTS = "COUNT(*) FILTER (status = 'sent') AS sent, COUNT(*) FILTER (status = 'pending') AS pending, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(status) AS total"


@query("forms_state_daily", FORMS + f"SELECT s.site, s.month, {FORMS_COUNTS} FROM forms_spine s LEFT JOIN forms f ON f.site = s.site AND f.month = s.month GROUP BY ALL", "forms")
def _(t: Tables):
    return forms_monthly(t)


@query("forms_conservation", FORMS + f"SELECT site, CAST(SUM(total) AS BIGINT) AS total, bool_and(total = sent + pending + failed) AS conserved FROM (SELECT s.site, s.month, {FORMS_COUNTS} FROM forms_spine s LEFT JOIN forms f ON f.site = s.site AND f.month = s.month GROUP BY ALL) GROUP BY site", "forms")
def _(t: Tables):
    return forms_monthly(t).groupBy("site").agg(F.sum("total").alias("total"), F.bool_and(F.expr("total = sent + pending + failed")).alias("conserved"))


@query("delivery_gap", "SELECT site, COUNT(*) - COUNT(*) FILTER (status = 'sent') AS gap FROM forms WHERE site % 4 <> 0 GROUP BY site", "forms")
def _(t: Tables):
    submissions = t.forms.groupBy("site").agg(F.count("*").alias("submitted"))
    deliveries = t.forms.filter("status = 'sent' AND site % 4 <> 0").groupBy("site").agg(F.count("*").alias("delivered"))
    return submissions.join(deliveries, "site").select("site", (F.col("submitted") - F.col("delivered")).alias("gap"))


@query("inbox_delivery_daily", "SELECT CAST(conv_id % 30 AS INTEGER) AS day, COUNT(DISTINCT conv_id) AS received, COUNT(DISTINCT CASE WHEN turn % 2 = 0 THEN conv_id END) AS unread FROM conversations WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'idiot') GROUP BY 1")
def _(t: Tables):
    rows = t.base("conversations").select((F.col("conv_id") % 30).cast("int").alias("day"), F.col("conv_id").alias("message_id"), (F.col("turn") % 2 != 0).alias("seen"), F.col("text").alias("subject"))
    return ops.inbox_daily(rows, "the", "idiot")


@query(
    "activation_history_check",
    "a AS (SELECT CAST(o_custkey AS VARCHAR) AS identity, o_orderkey AS activation_id, o_orderdate AS activated_at, o_orderdate + INTERVAL 200 DAYS AS retired_at FROM orders) SELECT activation_id, identity FROM (SELECT *, lag(activation_id) OVER w AS b, lag(retired_at) OVER w AS e FROM a WINDOW w AS (PARTITION BY identity ORDER BY activated_at, activation_id)) WHERE b IS NOT NULL AND (e IS NULL OR e > activated_at)",
)
def _(t: Tables):
    rows = t.base("orders").select(F.col("o_custkey").cast("string").alias("identity"), F.col("o_orderkey").alias("activation_id"), F.col("o_orderdate").alias("activated_at"), (F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS")).alias("retired_at"))
    return ops.activation_conflicts(rows).select("activation_id", "identity")
