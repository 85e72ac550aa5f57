"""Queries over the page cube, clusters, rankings and the index census."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metriclake.functions import text
from metriclake.operators import pages as ops
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

DAILY = """daily AS (SELECT site_id, route, day, source, search_type, SUM(value) FILTER (metric = 'web.pageviews') AS pageviews, SUM(value) FILTER (metric = 'search.clicks') AS clicks,
 SUM(value) FILTER (metric = 'search.impressions') AS impressions, CAST(SUM(value) FILTER (metric = 'search.position') AS DOUBLE) / NULLIF(COUNT(*) FILTER (metric = 'search.position'), 0) AS position,
 CASE WHEN bool_or(completeness = 'provisional') THEN 'provisional' ELSE 'final' END AS completeness, MAX(observed_at) AS observed_at, COUNT(*) AS n_facts FROM facts GROUP BY ALL) """
CATALOG = "catalog AS (SELECT site_id, route, MIN(day) AS first_seen, MAX(day) AS last_seen, list_sort(list(DISTINCT source)) AS sources FROM facts GROUP BY ALL) "
WINDOW = "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND (source <> 'search' OR search_type = 'web')"
SUMS = "CAST(SUM(pageviews) AS DOUBLE) AS pageviews, CAST(SUM(clicks) AS DOUBLE) AS clicks, CAST(SUM(impressions) AS DOUBLE) AS impressions, round(SUM(position * impressions::DOUBLE), 3) AS position_weight"
METRICS = f"{DAILY}, {CATALOG}, metrics AS (SELECT c.site_id, c.route, s.pageviews, s.clicks, s.impressions, s.position_weight, s.clicks / NULLIF(s.impressions, 0) AS ctr FROM catalog c LEFT JOIN (SELECT site_id, route, {SUMS} FROM daily WHERE {WINDOW} GROUP BY ALL) s ON s.site_id = c.site_id AND s.route = c.route) "


def daily(t: Tables):
    return ops.materialize_page_daily(t.facts)


def metrics(t: Tables):
    out = ops.page_metrics(ops.page_catalog(t.facts), daily(t), "2024-01-05", "2024-01-20", "web")
    return ops.with_ratios(out.withColumn("position_weight", F.round("position_weight", 3))).drop("page_id")


@query("page_daily_materialize", DAILY + "SELECT site_id, route, day, source, search_type, CAST(pageviews AS DOUBLE) AS pageviews, CAST(clicks AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions, round(position * impressions::DOUBLE, 3) AS position_weight, completeness, observed_at, n_facts FROM daily", "facts")
def _(t: Tables):
    casts = {c: F.col(c).cast("double") for c in ("pageviews", "clicks", "impressions")}
    return daily(t).withColumns(casts | {"position_weight": F.round(F.col("position_weight").cast("double"), 3)})


@query("page_catalog_build", CATALOG + "SELECT site_id, route, first_seen, last_seen, array_to_string(sources, ',') AS sources, sha256(site_id || chr(0) || route) AS page_id FROM catalog", "facts")
def _(t: Tables):
    return ops.page_catalog(t.facts).withColumn("sources", F.array_join("sources", ","))


@query("page_metric_pivot", DAILY + f"SELECT site_id, route, {SUMS} FROM daily GROUP BY ALL", "facts")
def _(t: Tables):
    return ops.page_pivot(daily(t), "site_id", "route").withColumn("position_weight", F.round("position_weight", 3))


@query("page_window_left_join", METRICS + "SELECT site_id, route, pageviews, clicks, impressions, position_weight FROM metrics", "facts")
def _(t: Tables):
    return metrics(t).drop("ctr", "position")


@query("semi_join_membership", CATALOG + "SELECT site_id, route, day, COUNT(*) AS n FROM facts WHERE (site_id, route) IN (SELECT site_id, route FROM catalog WHERE len(sources) = 2 AND first_seen > DATE '2024-01-05') GROUP BY ALL", "facts")
def _(t: Tables):
    members = ops.page_catalog(t.facts).filter("size(sources) = 2 AND first_seen > DATE'2024-01-05'").select("site_id", "route")
    flat = t.facts.select("site_id", F.col("dims")["route"].alias("route"), F.to_date("start_ts").alias("day"))
    return flat.join(members, ["site_id", "route"], "left_semi").groupBy("site_id", "route", "day").agg(F.count("*").alias("n"))


@query("property_rollup", METRICS + "SELECT site_id, COUNT(*) AS n_pages, SUM(pageviews) AS pageviews, SUM(clicks) AS clicks, SUM(impressions) AS impressions, round(SUM(clicks) / SUM(impressions), 9) AS ctr FROM metrics GROUP BY site_id", "facts")
def _(t: Tables):
    rows = metrics(t).groupBy("site_id").agg(F.countDistinct("route").alias("n_pages"), *[F.sum(c).alias(c) for c in ("pageviews", "clicks", "impressions")])
    return rows.withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 9))


CLUSTERS = "clusters AS (SELECT split_part(route, '/', 2) AS cluster_id, COUNT(*) AS n_pages, SUM(pageviews) AS pageviews, SUM(clicks) AS clicks, SUM(impressions) AS impressions, SUM(position_weight) AS position_weight FROM metrics GROUP BY 1) "


def clusters(t: Tables):
    return ops.cluster_rollup(metrics(t), F.array(text.assign_cluster_path(F.col("route"), 1, "other")["cluster_id"]))


@query("cluster_rollup", METRICS + ", " + CLUSTERS + "SELECT cluster_id, n_pages, pageviews, clicks, impressions, round(position_weight, 1) AS position_weight FROM clusters", "facts")
def _(t: Tables):
    return clusters(t).withColumn("position_weight", F.round("position_weight", 1)).drop("impression_share")


@query("impression_share", METRICS + ", " + CLUSTERS + "SELECT cluster_id, round(impressions / SUM(impressions) OVER (), 9) AS impression_share FROM clusters", "facts")
def _(t: Tables):
    return clusters(t).select("cluster_id", F.round("impression_share", 9).alias("impression_share"))


RULES = [{"cluster_id": "first", "priority": 9, "prefixes": ["/s1"]}, {"cluster_id": "nines", "priority": 5, "globs": ["*9"]}, {"cluster_id": "short", "priority": 1, "globs": ["/s?/?"]}]
RULED = "list_filter([CASE WHEN route LIKE '/s1/%' THEN 'first' END, CASE WHEN route LIKE '%9' THEN 'nines' END, CASE WHEN regexp_matches(route, '^/s./.$') THEN 'short' END], lambda x: x IS NOT NULL)"


@query("cluster_preview", CATALOG + f"SELECT coalesce({RULED}[1], 'other') AS cluster_id, COUNT(*) AS n_pages FROM catalog GROUP BY 1", "facts")
def _(t: Tables):
    assigned = text.assign_cluster_rules(F.col("route"), RULES, "exclusive", "other")
    return ops.page_catalog(t.facts).groupBy(assigned[0].alias("cluster_id")).agg(F.count("*").alias("n_pages"))


@query("assign_cluster_rules", CATALOG + f"SELECT site_id, route, CASE WHEN len({RULED}) > 0 THEN array_to_string({RULED}, ',') ELSE 'other' END AS clusters FROM catalog", "facts")
def _(t: Tables):
    return ops.page_catalog(t.facts).select("site_id", "route", F.array_join(text.assign_cluster_rules(F.col("route"), RULES, "multilabel", "other"), ",").alias("clusters"))


@query("assign_cluster_path", CATALOG + "SELECT site_id, route, split_part(route, '/', 3) AS cluster_id, split_part(route, '/', 3) AS label FROM catalog", "facts")
def _(t: Tables):
    found = text.assign_cluster_path(F.col("route"), 2, "other")
    return ops.page_catalog(t.facts).select("site_id", "route", found["cluster_id"].alias("cluster_id"), found["label"].alias("label"))


@query("cluster_inner_join", METRICS + "SELECT m.site_id, m.route, c.cluster, m.impressions FROM metrics m JOIN (SELECT DISTINCT route, split_part(route, '/', 2) AS cluster FROM facts WHERE route NOT LIKE '/s4/%') c USING (route)", "facts")
def _(t: Tables):
    assigned = t.facts.select(F.col("dims")["route"].alias("route")).distinct().filter("route NOT LIKE '/s4/%'").withColumn("cluster", F.split_part("route", F.lit("/"), F.lit(2)))
    return metrics(t).join(assigned, "route").select("site_id", "route", "cluster", "impressions")


@query("exclusive_overlap_check", CATALOG + f"SELECT site_id, route, len({RULED}) AS n_clusters FROM catalog WHERE len({RULED}) > 1", "facts")
def _(t: Tables):
    n = F.size(text.assign_cluster_rules(F.col("route"), RULES, "multilabel", "other")).cast("long").alias("n_clusters")
    return ops.page_catalog(t.facts).select("site_id", "route", n).filter("n_clusters > 1")


@query("top_pages", METRICS + "SELECT site_id, route, impressions, clicks FROM metrics WHERE coalesce(impressions, 0) >= 3 ORDER BY impressions DESC NULLS LAST, site_id, route LIMIT 50 OFFSET 20", "facts")
def _(t: Tables):
    return ops.top_pages(metrics(t), "impressions", 50, 20, 3).select("site_id", "route", "impressions", "clicks")


@query("ctr_opportunities", METRICS + "SELECT site_id, route, impressions, round(ctr, 9) AS ctr FROM (SELECT * FROM metrics WHERE impressions >= 2 ORDER BY impressions DESC, site_id, route LIMIT 500) WHERE ctr <= 0.6 ORDER BY impressions DESC, site_id, route LIMIT 100", "facts")
def _(t: Tables):
    return ops.ctr_opportunities(metrics(t), 2, 0.6, 500, 100).select("site_id", "route", "impressions", F.round("ctr", 9).alias("ctr"))


INDEX = "fresh AS (SELECT * FROM url_status WHERE inspected_on >= DATE '2024-01-10'), cov AS (SELECT site_id, COUNT(*) AS published, COUNT(verdict) AS inspected, COUNT(*) FILTER (indexed) AS indexed, MIN(inspected_on) AS oldest_fresh FROM inventory LEFT JOIN fresh USING (url_hash) GROUP BY site_id), pct AS (SELECT *, CASE WHEN inspected = published THEN round(100.0 * indexed / published, 2) END AS percentage FROM cov) "


def covered(t: Tables):
    return ops.index_coverage(t.inventory, t.url_status, "2024-01-10")


@query("index_coverage_summary", INDEX + "SELECT site_id, published, inspected, indexed, oldest_fresh, CAST(percentage AS DOUBLE) AS percentage FROM pct", "inventory", "url_status")
def _(t: Tables):
    return covered(t)


@query("index_scope_summary", INDEX + "SELECT COUNT(*) AS n_sites, CAST(SUM(published) AS BIGINT) AS published, CAST(SUM(indexed) AS BIGINT) AS indexed FROM pct WHERE inspected * 10 >= published * 2", "inventory", "url_status")
def _(t: Tables):
    return covered(t).filter("inspected * 10 >= published * 2").agg(F.count("*").alias("n_sites"), F.sum("published").alias("published"), F.sum("indexed").alias("indexed"))


@query("index_status_join", "SELECT i.site_id, COUNT(DISTINCT i.url_hash) AS n_urls, COUNT(DISTINCT u.url_hash) AS n_inspected, MAX(u.inspected_on) AS last_inspected FROM inventory i LEFT JOIN url_status u USING (url_hash) GROUP BY i.site_id", "inventory", "url_status")
def _(t: Tables):
    status = t.url_status.groupBy("url_hash").agg(F.max("inspected_on").alias("inspected_on"))
    return t.inventory.join(status, "url_hash", "left").groupBy("site_id").agg(F.countDistinct("url_hash").alias("n_urls"), F.count("inspected_on").alias("n_inspected"), F.max("inspected_on").alias("last_inspected"))


@query("pending_inspections", "SELECT url_hash, inspected_on FROM inventory LEFT JOIN url_status USING (url_hash) WHERE inspected_on IS NULL OR inspected_on < DATE '2024-01-20' ORDER BY inspected_on IS NOT NULL, inspected_on, url_hash LIMIT 700", "inventory", "url_status")
def _(t: Tables):
    return ops.pending(t.inventory, t.url_status, "2024-01-20", 700).select("url_hash", "inspected_on")


VERSIONS = "v AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS scheme_id, o_orderkey AS version_id, o_orderdate AS activated_at, sha256(o_orderpriority) AS content FROM orders) "


def versions(t: Tables):
    return t.base("orders").select((F.col("o_custkey") % 50).cast("string").alias("scheme_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("activation_id"), F.col("o_orderdate").alias("activated_at"), F.sha2("o_orderpriority", 256).alias("content"))


@query("scheme_active_version", VERSIONS + "SELECT scheme_id, version_id, content FROM (SELECT *, row_number() OVER (PARTITION BY scheme_id ORDER BY activated_at DESC, version_id DESC) AS k FROM v) WHERE k = 1")
def _(t: Tables):
    v = versions(t)
    return ops.active_versions(v.select("scheme_id", "version_id", "activation_id", "activated_at"), v.select("scheme_id", "version_id", "content")).select("scheme_id", "version_id", "content")


@query("schemes_list", VERSIONS + "SELECT scheme_id, COUNT(*) AS n_versions, COUNT(DISTINCT content) AS n_contents, MAX(activated_at) AS last_activated FROM v GROUP BY scheme_id")
def _(t: Tables):
    return versions(t).groupBy("scheme_id").agg(F.count("*").alias("n_versions"), F.countDistinct("content").alias("n_contents"), F.max("activated_at").alias("last_activated"))


@query("definition_next_version", VERSIONS + "SELECT scheme_id, MAX(version_id) + 1 AS next_version, MAX(CASE WHEN content = sha256('1-URGENT') THEN version_id END) AS reused FROM v GROUP BY scheme_id")
def _(t: Tables):
    same = F.max(F.when(F.col("content") == F.sha2(F.lit("1-URGENT"), 256), F.col("version_id")))
    return versions(t).groupBy("scheme_id").agg((F.max("version_id") + 1).alias("next_version"), same.alias("reused"))


@query("ranked_sites", "s AS (SELECT site_id, COUNT(*) AS n FROM hits GROUP BY site_id) SELECT site_id, n, round(n / SUM(n) OVER (), 9) AS share, round(n / MAX(n) OVER (), 9) AS bar FROM s", "hits")
def _(t: Tables):
    return ops.ranked_sites(t.hits.groupBy("site_id").agg(F.count("*").alias("n")), "n").withColumns({"share": F.round("share", 9), "bar": F.round("bar", 9)})


@query("heatmap_levels", "SELECT site_id, day, a, CASE WHEN a IS NULL THEN NULL WHEN a <= 0 THEN 0 ELSE greatest(1, CAST(ceil(5.0 * a / MAX(a) OVER ()) AS INTEGER)) END AS level FROM pair", "pair")
def _(t: Tables):
    return ops.heatmap_levels(t.pair.select("site_id", "day", "a"), "a")


@query("search_capture", METRICS + "SELECT site_id, SUM(impressions) AS impressions, SUM(clicks) AS clicks, round(SUM(clicks) / SUM(impressions), 9) AS ctr, row_number() OVER (ORDER BY SUM(impressions) DESC, site_id) AS position FROM metrics GROUP BY site_id", "facts")
def _(t: Tables):
    rows = metrics(t).groupBy("site_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    ranked = Window.orderBy(F.desc("impressions"), "site_id")  # a row per site
    return rows.withColumn("ctr", F.round(F.col("clicks") / F.col("impressions"), 9)).withColumn("position", F.row_number().over(ranked).cast("long"))


@query("duplicate_label_disambiguation", "r AS (SELECT DISTINCT route, split_part(route, '/', 3) AS short FROM facts UNION SELECT DISTINCT '/x' || route, split_part(route, '/', 3) FROM facts WHERE route LIKE '%7') SELECT route, CASE WHEN COUNT(*) OVER (PARTITION BY short) > 1 THEN short || ' (' || regexp_extract(route, '^(.*)/', 1) || ')' ELSE short END AS label FROM r", "facts")
def _(t: Tables):
    routes = t.facts.select(F.col("dims")["route"].alias("route")).distinct()
    both = routes.unionByName(routes.filter("route LIKE '%7'").select(F.concat(F.lit("/x"), "route").alias("route"))).withColumn("short", F.regexp_extract("route", "([^/]*)$", 1))
    n = F.count("*").over(Window.partitionBy(F.lower("short")))
    parent = F.regexp_extract("route", "^(.*)/", 1)
    return both.withColumn("n", n).select("route", F.when(F.col("n") > 1, F.concat("short", F.lit(" ("), parent, F.lit(")"))).otherwise(F.col("short")).alias("label"))
