"""Queries over the fact table: scans, trust filters, validation, aggregation rules, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metriclake import catalog
from metriclake.functions.geo import US_STATES, us_state
from metriclake.operators import facts as ops
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

SITES = ["site-0", "site-1", "site-2", "site-3"]
IN_WINDOW = "start_ts >= TIMESTAMP '2024-01-05' AND end_ts <= TIMESTAMP '2024-01-20'"


def flat(df):
    """Facts with plain columns in place of the dimensions."""
    return df.select("client_id", "site_id", "source", "metric", F.to_date("start_ts").alias("day"), F.col("dims")["route"].alias("route"), F.col("dims")["search_type"].alias("search_type"), F.col("value").cast("double").alias("value"), "completeness")


FLAT = "client_id, site_id, source, metric, day, route, search_type, CAST(value AS DOUBLE) AS value, completeness"


@query("scan_facts", f"SELECT {FLAT} FROM facts WHERE client_id = 'client-0' AND site_id IN ('site-0', 'site-1', 'site-2', 'site-3') AND metric IN ('search.clicks', 'web.pageviews') AND {IN_WINDOW} AND identity_version = 1", "facts")
def _(t: Tables):
    return flat(ops.scan_facts(t.facts, catalog.identity_versions(t.spark), "client-0", SITES, ["search.clicks", "web.pageviews"], "2024-01-05", "2024-01-20"))


def bindings(t: Tables):
    return t.facts.select("site_id", "source").distinct().filter("NOT (site_id = 'site-6' AND source = 'web')").withColumn("observation_start", F.when(F.col("site_id") == "site-1", F.lit("2024-01-10").cast("date")))


@query("filter_supported_points", f"SELECT {FLAT} FROM facts WHERE NOT (site_id = 'site-6' AND source = 'web') AND (site_id <> 'site-1' OR day >= DATE '2024-01-10')", "facts")
def _(t: Tables):
    return flat(ops.supported_points(t.facts, bindings(t)))


@query("filter_completeness", f"SELECT {FLAT} FROM facts WHERE completeness = 'final' OR (source = 'web' AND completeness = 'provisional')", "facts")
def _(t: Tables):
    return flat(ops.usable_for_window(t.facts, "final", ("web",)))


@query("filter_search_type", f"SELECT {FLAT} FROM facts WHERE (source <> 'search' OR search_type = 'image') AND metric <> 'search.position'", "facts")
def _(t: Tables):
    return flat(ops.filter_surface(t.facts, "image"))


@query("search_surface_scope", "SELECT surface, surface = 'web' AS is_default FROM (SELECT DISTINCT search_type AS surface FROM facts WHERE source = 'search')", "facts")
def _(t: Tables):
    return ops.surfaces(t.facts)


@query("filter_dimensions", f"SELECT {FLAT} FROM facts WHERE route = '/s1/21' AND search_type = 'web'", "facts")
def _(t: Tables):
    return flat(ops.filter_dims(t.facts, {"search_type": "web", "route": "/s1/21"}))


@query(
    "filter_route_observations",
    "SELECT day, route, metric, CAST(value AS DOUBLE) AS value, COUNT(*) OVER () AS n_total FROM facts WHERE site_id = 'site-2' AND source = 'search' AND metric = 'search.clicks' AND route LIKE '/s3/%' ORDER BY day, route, search_type LIMIT 500",
    "facts",
)
def _(t: Tables):
    some = t.facts.filter("site_id = 'site-2' AND source = 'search' AND metric = 'search.clicks'").filter(F.col("dims")["route"].startswith("/s3/"))
    total = some.agg(F.count("*")).scalar()
    rows = some.select(F.to_date("start_ts").alias("day"), F.col("dims")["route"].alias("route"), F.col("dims")["search_type"].alias("search_type"), "metric", F.col("value").cast("double").alias("value"))
    return rows.orderBy("day", "route", "search_type").limit(500).drop("search_type").withColumn("n_total", total)


def flawed(t: Tables):
    """Facts with errors of each kind among them."""
    route = F.col("dims")["route"]
    return (
        t.facts.withColumn("metric", F.when(route == "/s0/0", "search.unknown").otherwise(F.col("metric")))
        .withColumn("unit", F.when(route == "/s1/1", "percent").otherwise(F.col("unit")))
        .withColumn("source", F.when(route == "/s2/2", "other").otherwise(F.col("source")))
        .withColumn("dims", F.when(route == "/s3/3", F.create_map(F.lit("page"), route)).otherwise(F.col("dims")))
    )


@query(
    "validate_points",
    "SELECT reject_reason, COUNT(*) AS n FROM (SELECT CASE route WHEN '/s0/0' THEN 'unknown_metric' WHEN '/s1/1' THEN 'wrong_unit' WHEN '/s2/2' THEN 'wrong_source' WHEN '/s3/3' THEN 'wrong_dimensions' END AS reject_reason FROM facts) GROUP BY ALL",
    "facts",
)
def _(t: Tables):
    return ops.validate_points(flawed(t), catalog.metric_catalog(t.spark)).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "validate_fact_shape",
    "SELECT shape_error, COUNT(*) AS n FROM (SELECT CASE WHEN site_id = 'site-0' THEN 'empty_id' WHEN site_id = 'site-1' THEN 'empty_interval' WHEN site_id = 'site-2' THEN 'no_value' WHEN site_id = 'site-3' THEN 'empty_dimension' END AS shape_error FROM facts) GROUP BY ALL",
    "facts",
)
def _(t: Tables):
    bad = t.facts.withColumn("client_id", F.when(F.col("site_id") == "site-0", " ").otherwise(F.col("client_id")))
    bad = bad.withColumn("end_ts", F.when(F.col("site_id") == "site-1", F.col("start_ts")).otherwise(F.col("end_ts")))
    bad = bad.withColumn("value", F.when(F.col("site_id") != "site-2", F.col("value")))
    bad = bad.withColumn("dims", F.when(F.col("site_id") == "site-3", F.create_map(F.lit("route"), F.lit(""))).otherwise(F.col("dims")))
    return ops.check_fact_shape(bad).groupBy("shape_error").agg(F.count("*").alias("n"))


def slices(t: Tables):
    """Acquisition slices: one per site, source and day."""
    cells = t.hits.groupBy("site_id", "day").agg(F.count("*").alias("raw_rows"), F.count_if(F.col("event_type") == "error").alias("rejected_rows"))
    return cells.select(
        "site_id",
        "day",
        "raw_rows",
        "rejected_rows",
        (F.col("raw_rows") - F.col("rejected_rows") - F.when(F.dayofmonth("day") == 7, 1).otherwise(0)).alias("accepted_rows"),
        F.when(F.dayofmonth("day") % 3 == 0, "final").otherwise("provisional").alias("completeness"),
        F.floor(F.col("raw_rows") / 20).alias("pages_fetched"),
    )


SLICES = """slices AS (SELECT site_id, day, raw_rows, rejected_rows, raw_rows - rejected_rows - CASE WHEN day(day) = 7 THEN 1 ELSE 0 END AS accepted_rows,
 CASE WHEN day(day) % 3 = 0 THEN 'final' ELSE 'provisional' END AS completeness, raw_rows // 20 AS pages_fetched FROM
 (SELECT site_id, day, COUNT(*) AS raw_rows, COUNT(*) FILTER (event_type = 'error') AS rejected_rows FROM hits GROUP BY ALL)) """


@query(
    "validate_slice_accounting",
    SLICES + "SELECT site_id, day, CASE WHEN raw_rows <> accepted_rows + rejected_rows THEN 'rows_do_not_add_up' WHEN completeness = 'final' AND rejected_rows > 0 THEN 'final_with_rejects' WHEN pages_fetched < 1 THEN 'no_page' END AS slice_error FROM slices",
    "hits",
)
def _(t: Tables):
    return ops.check_slices(slices(t)).select("site_id", "day", "slice_error")


@query(
    "slice_accounting",
    SLICES + "SELECT site_id, completeness, CAST(SUM(pages_fetched) AS BIGINT) AS pages_fetched, CAST(SUM(raw_rows) AS BIGINT) AS raw_rows, CAST(SUM(accepted_rows) AS BIGINT) AS accepted_rows, CAST(SUM(rejected_rows) AS BIGINT) AS rejected_rows FROM slices GROUP BY ALL",
    "hits",
)
def _(t: Tables):
    return ops.slice_totals(slices(t), "site_id", "completeness")


SEGMENT = {"all": [{"dimension": "route", "operator": "starts_with", "value": "/s1/"}, {"not": {"dimension": "site", "operator": "in", "value": ["site-0", "site-5"]}}, {"any": [{"dimension": "surface", "operator": "equals", "value": "web"}, {"dimension": "route", "operator": "matches", "value": "0$"}]}]}


@query("segment_predicate", f"SELECT {FLAT} FROM facts WHERE route LIKE '/s1/%' AND site_id NOT IN ('site-0', 'site-5') AND (search_type = 'web' OR route LIKE '%0')", "facts")
def _(t: Tables):
    columns = {"route": F.col("dims")["route"], "site": F.col("site_id"), "surface": F.col("dims")["search_type"]}
    return flat(t.facts.filter(ops.compile_segment(SEGMENT, columns)))


@query("agg_sum", "SELECT metric, site_id, source, unit, CAST(SUM(value) AS DOUBLE) AS value FROM facts WHERE metric <> 'search.position' GROUP BY ALL", "facts")
def _(t: Tables):
    return ops.agg_sum(t.facts.filter("metric <> 'search.position'"), "metric", "site_id", "source", "unit").withColumn("value", F.col("value").cast("double"))


@query("agg_latest", "SELECT metric, site_id, source, CAST((MAX({'e': end_ts, 'o': observed_at, 'v': value})).v AS DOUBLE) AS value FROM facts GROUP BY ALL", "facts")
def _(t: Tables):
    return ops.agg_latest(t.facts, "metric", "site_id", "source").withColumn("value", F.col("value").cast("double"))


def quarter_facts(t: Tables):
    """A total per nation and quarter and a row per order's day."""
    orders = t.forms
    quarter = F.trunc("day", "quarter").cast("timestamp_ntz")
    totals = orders.groupBy("site", quarter.alias("start_ts")).agg(F.count("*").cast("decimal(18,4)").alias("value"), F.max("day").alias("seen"))
    total = totals.select("site", "start_ts", (F.add_months("start_ts", 3)).cast("timestamp_ntz").alias("end_ts"), "value", F.col("seen").cast("timestamp_ntz").alias("observed_at"), F.create_map().cast("map<string,string>").alias("dims"))
    days = orders.groupBy("site", "day", "form_id").agg(F.count("*").cast("decimal(18,4)").alias("value"))
    day = days.select("site", F.col("day").cast("timestamp_ntz").alias("start_ts"), F.date_add("day", 1).cast("timestamp_ntz").alias("end_ts"), "value", F.col("day").cast("timestamp_ntz").alias("observed_at"), F.create_map(F.lit("form"), F.col("form_id")).alias("dims"))
    return total.unionByName(day)


@query("agg_window_exact", "SELECT site, CAST(COUNT(*) AS DOUBLE) AS value FROM forms WHERE day >= DATE '1997-04-01' AND day < DATE '1997-07-01' GROUP BY site", "forms")
def _(t: Tables):
    return ops.agg_window_exact(quarter_facts(t), "1997-04-01", "1997-07-01", "site").withColumn("value", F.col("value").cast("double"))


@query("agg_bounded_count", "SELECT site_id, CASE WHEN MAX(value) < 100000 AND SUM(value) < 100000 THEN CAST(SUM(value) AS DOUBLE) END AS value FROM facts WHERE source = 'web' OR metric = 'search.clicks' GROUP BY site_id", "facts")
def _(t: Tables):
    some = t.facts.filter("source = 'web' OR metric = 'search.clicks'")
    return some.groupBy("site_id").agg(ops.bounded_sum(F.col("value"), 5).cast("double").alias("value"))


@query(
    "agg_weighted_ctr",
    "SELECT site_id, search_type, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions, CASE WHEN COUNT(*) FILTER (impressions > 0 AND clicks IS NULL) = 0 AND SUM(impressions) > 0 THEN round(SUM(clicks)::DOUBLE / SUM(impressions)::DOUBLE, 9) END AS ctr FROM (SELECT site_id, search_type, impressions, CASE WHEN site_id <> 'site-3' OR clicks > 0 THEN clicks END AS clicks FROM cells) GROUP BY ALL",
    "cells",
)
def _(t: Tables):
    cells = t.cells.withColumn("clicks", F.when((F.col("site_id") != "site-3") | (F.col("clicks") > 0), F.col("clicks")))
    return ops.weighted_ctr(cells, "site_id", "search_type").withColumn("ctr", F.round("ctr", 9))


@query(
    "agg_weighted_position",
    "SELECT site_id, CAST(SUM(position * impressions) AS DOUBLE) AS position_weight, round(CAST(SUM(position * impressions) AS DOUBLE) / SUM(impressions) FILTER (position IS NOT NULL), 6) AS position FROM cells GROUP BY ALL",
    "cells",
)
def _(t: Tables):
    return ops.weighted_position(t.cells, "site_id").withColumn("position", F.round("position", 6))


@query(
    "daily_series",
    "SELECT site_id, day, CAST(NULLIF(SUM(impressions), 0) AS DOUBLE) AS impressions, CAST(NULLIF(SUM(clicks), 0) AS DOUBLE) AS clicks, CAST(NULLIF(SUM(pageviews), 0) AS DOUBLE) AS pageviews,"
    " round(CAST(NULLIF(SUM(clicks), 0) AS DOUBLE) / CAST(NULLIF(SUM(impressions), 0) AS DOUBLE), 9) AS ctr, round(CAST(SUM(position * impressions) AS DOUBLE) / CAST(SUM(impressions) FILTER (position IS NOT NULL) AS DOUBLE), 6) AS position"
    " FROM cells WHERE impressions + clicks + pageviews > 0 GROUP BY ALL",
    "cells",
)
def _(t: Tables):
    return ops.daily_series(t.measured, "site_id").withColumns({"ctr": F.round("ctr", 9), "position": F.round("position", 6)})


@query(
    "summary_values",
    "SELECT metric, CAST(SUM(value) AS DOUBLE) AS value FROM facts WHERE metric <> 'search.position' GROUP BY ALL UNION ALL SELECT 'search.ctr', round(SUM(value) FILTER (metric = 'search.clicks')::DOUBLE / SUM(value) FILTER (metric = 'search.impressions')::DOUBLE, 9) FROM facts UNION ALL SELECT 'search.position', round(SUM(position * impressions)::DOUBLE / SUM(impressions) FILTER (position IS NOT NULL), 6) FROM cells",
    "facts",
)
def _(t: Tables):
    sums = ops.agg_sum(t.facts.filter("metric <> 'search.position'"), "metric").withColumn("value", F.col("value").cast("double"))
    ctr = ops.weighted_ctr(t.cells).select(F.lit("search.ctr").alias("metric"), F.round("ctr", 9).alias("value"))
    position = ops.weighted_position(t.cells).select(F.lit("search.position").alias("metric"), F.round("position", 6).alias("value"))
    return sums.unionByName(ctr).unionByName(position)


@query("metric_source_label", "SELECT site_id, metric, CASE WHEN site_id = 'site-4' AND metric = 'web.pageviews' THEN 'mixed' ELSE MIN(source) END AS source FROM facts GROUP BY site_id, metric", "facts")
def _(t: Tables):
    shown = F.when((F.col("site_id") == "site-4") & (F.col("metric") == "web.pageviews") & (F.dayofmonth("start_ts") % 2 == 0), "tag").otherwise(F.col("source"))
    sources = F.collect_set(shown)
    return t.facts.groupBy("site_id", "metric").agg(F.when(F.size(sources) == 1, F.element_at(sources, 1)).otherwise("mixed").alias("source"))


@query("native_over_fixture", "SELECT site_id, metric, 'native' AS origin, CAST(value AS DOUBLE) AS value FROM facts WHERE source = 'search' AND site_id <> 'site-2' UNION ALL SELECT site_id, metric, 'fixture', 1.0 FROM facts WHERE source = 'search' AND site_id = 'site-2' AND day = DATE '2024-01-02'", "facts")
def _(t: Tables):
    search = t.facts.filter("source = 'search'")
    native = search.filter("site_id <> 'site-2'").select("site_id", "metric", F.lit("native").alias("origin"), F.col("value").cast("double").alias("value"))
    fixture = search.filter("to_date(start_ts) = DATE'2024-01-02'").select("site_id", "metric", F.lit("fixture").alias("origin"), F.lit(1.0).alias("value"))
    return ops.prefer_native(native, fixture, "site_id", "metric")


@query("unpivot_measures", "SELECT site_id, route, day, measure, CAST(value AS BIGINT) AS value FROM (SELECT site_id, route, day, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(pageviews) AS pageviews FROM cells GROUP BY ALL) UNPIVOT (value FOR measure IN (impressions, clicks, pageviews))", "cells")
def _(t: Tables):
    wide = t.cells.groupBy("site_id", "route", "day").agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "pageviews")])
    return ops.to_points(wide, ["site_id", "route", "day"], ["impressions", "clicks", "pageviews"])


@query("dimension_collision_sum", "SELECT site_id, day, CASE WHEN SUM(impressions) < 1000 THEN CAST(SUM(impressions) AS DOUBLE) END AS value, COUNT(*) AS n_rows, SUM(impressions) >= 1000 AS rejected FROM cells GROUP BY ALL", "cells")
def _(t: Tables):
    rows = t.cells.select("site_id", "day", F.col("impressions").cast("decimal(18,0)").alias("value"))
    return ops.sum_collisions(rows, "site_id", "day", digits=3).withColumn("value", F.col("value").cast("double"))


@query(
    "search_observation_combine",
    "SELECT site_id, route, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(clicks) AS BIGINT) AS clicks, round(SUM(clicks)::DOUBLE / NULLIF(SUM(impressions), 0), 9) AS ctr, round(SUM(position * impressions)::DOUBLE / SUM(impressions) FILTER (position IS NOT NULL), 6) AS position FROM cells GROUP BY ALL",
    "cells",
)
def _(t: Tables):
    ctr = ops.weighted_ctr(t.cells, "site_id", "route")
    return ctr.join(ops.weighted_position(t.cells, "site_id", "route"), ["site_id", "route"]).select("site_id", "route", "impressions", "clicks", F.round("ctr", 9).alias("ctr"), F.round("position", 6).alias("position"))


@query("freshness_by_source", "SELECT source, MAX(end_ts) AS last_end, MAX(observed_at) AS last_observed, COUNT(*) AS n_facts FROM facts GROUP BY source", "facts")
def _(t: Tables):
    return ops.freshness(t.facts)


@query("retention_filter", f"SELECT {FLAT} FROM facts WHERE NOT (end_ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAYS)", "facts")
def _(t: Tables):
    return flat(ops.apply_retention(t.facts, "2024-02-01", 3, 20))


def keyed(t: Tables):
    return t.facts.select("site_id", "source", F.to_date("start_ts").alias("day"), F.concat_ws("|", "metric", F.col("dims")["route"], F.col("dims")["search_type"], "client_id").alias("point"), "value", "observed_at", "completeness")


def revised(t: Tables):
    """A later batch of search facts of three days: values one higher, every fifth route gone."""
    rows = keyed(t).filter("source = 'search' AND day BETWEEN DATE'2024-01-08' AND DATE'2024-01-10' AND NOT endswith(split(point, '[|]')[1], '5')")
    return rows.withColumns({"value": (F.col("value") + 1).cast("decimal(18,4)"), "observed_at": F.col("observed_at") + F.expr("INTERVAL 1 DAY"), "completeness": F.when(F.col("day") == F.lit("2024-01-10").cast("date"), "provisional").otherwise("final")})


IN_BATCH = "source = 'search' AND day BETWEEN DATE '2024-01-08' AND DATE '2024-01-10'"
POINT = "metric || '|' || route || '|' || search_type || '|' || client_id AS point"


@query("fact_upsert", f"SELECT site_id, source, day, {POINT}, CAST(CASE WHEN {IN_BATCH} AND route NOT LIKE '%5' THEN value + 1 ELSE value END AS DOUBLE) AS value FROM facts", "facts")
def _(t: Tables):
    return ops.upsert_facts(keyed(t), revised(t), "site_id", "source", "day", "point").select("site_id", "source", "day", "point", F.col("value").cast("double").alias("value"))


@query("stale_key_anti_join", f"SELECT site_id, source, day, {POINT} FROM facts f WHERE {IN_BATCH} AND day < DATE '2024-01-10' AND route LIKE '%5' AND EXISTS (SELECT 1 FROM facts g WHERE g.site_id = f.site_id AND g.source = f.source AND g.day = f.day AND g.route NOT LIKE '%5')", "facts")
def _(t: Tables):
    return ops.stale_keys(keyed(t), revised(t), ["site_id", "source", "day"], "point").select("site_id", "source", "day", "point")


@query(
    "acquire_snapshot_merge",
    f"SELECT site_id, source, day, {POINT}, CAST(CASE WHEN {IN_BATCH} AND route NOT LIKE '%5' THEN value + 1 ELSE value END AS DOUBLE) AS value FROM facts f WHERE NOT ({IN_BATCH} AND day < DATE '2024-01-10' AND route LIKE '%5' AND EXISTS (SELECT 1 FROM facts g WHERE g.site_id = f.site_id AND g.source = f.source AND g.day = f.day AND g.route NOT LIKE '%5'))",
    "facts",
)
def _(t: Tables):
    return ops.publish_snapshot(keyed(t), revised(t), ["site_id", "source", "day"], "point").select("site_id", "source", "day", "point", F.col("value").cast("double").alias("value"))


@query("unmapped_dimension_reject", "SELECT site_id, COUNT(*) FILTER (k % 9 <> 0) AS accepted, COUNT(*) FILTER (k % 9 = 0) AS rejected, CASE WHEN COUNT(*) FILTER (k % 9 = 0) > 0 THEN 'provisional' ELSE 'final' END AS completeness FROM hits GROUP BY site_id", "hits")
def _(t: Tables):
    known = F.when(F.col("k") % 9 != 0, F.concat(F.lit("item-"), F.col("k").cast("string")))
    rejected = F.count_if(F.col("item").isNull())
    return t.hits.withColumn("item", known).groupBy("site_id").agg(F.count("item").alias("accepted"), rejected.alias("rejected"), F.when(rejected > 0, "provisional").otherwise("final").alias("completeness"))


GEO = "SELECT code, CAST(value AS BIGINT) AS value, (SELECT COUNT(*) FROM totals WHERE value < {k}) AS n_withheld FROM totals WHERE value >= {k}"


@query("geo_country_rollup", "totals AS (SELECT n_name AS code, COUNT(*) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) " + GEO.format(k=58))
def _(t: Tables):
    rows = t.base("customer").join(F.broadcast(t.base("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.lit(1).alias("value"))
    return ops.geo_rollup(rows, "n_name", 58)


CODES, NAMES = list(US_STATES), list(US_STATES.values())


@query(
    "geo_us_state_rollup",
    f"totals AS (SELECT {CODES!r}[1 + CAST(c_custkey % 51 AS INTEGER)] AS code, COUNT(*) AS value FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1) " + GEO.format(k=25),
)
def _(t: Tables):
    def pick(values: list[str]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % 51).cast("int") + 1)

    # codes with and without the country, names in capitals, and codes that are none
    kind = F.col("c_custkey") % 7
    code = F.when(kind == 0, "XX").when(kind == 1, F.concat(F.lit("US-"), pick(CODES))).when(kind == 2, F.lower(pick(CODES))).when(kind == 3, "").when(kind > 4, pick(CODES))
    rows = t.base("customer").select(us_state(code, F.upper(pick(NAMES))).alias("code"), F.lit(1).alias("value"))
    return ops.geo_rollup(rows, "code", 25)


@query("hourly_provisional_flag", "SELECT site_id, h, n, h >= first_bad AS provisional FROM (SELECT site_id, date_trunc('hour', ts) AS h, COUNT(*) AS n FROM hits GROUP BY ALL) JOIN (SELECT site_id, MIN(date_trunc('hour', ts)) AS first_bad FROM hits WHERE event_type = 'error' AND day >= DATE '2024-01-20' GROUP BY ALL) USING (site_id)", "hits")
def _(t: Tables):
    hours = t.hits.groupBy("site_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("h")).agg(F.count("*").alias("n"), F.count_if((F.col("event_type") == "error") & (F.col("day") >= F.lit("2024-01-20").cast("date"))).alias("bad"))
    first = F.min(F.when(F.col("bad") > 0, F.col("h"))).over(Window.partitionBy("site_id"))
    return hours.withColumn("provisional", F.col("h") >= first).drop("bad")
