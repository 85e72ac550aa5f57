"""Queries over landed sitemaps, and alert rules of all types over the daily values, runs and goals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.functions.text import host_of
from metriclake.operators import alerts, sitemaps
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

FOREIGN = "https://elsewhere.example/sitemap.xml"
HEAD = '<?xml version="1.0"?><{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def landed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each host's root URL and documents: four page numbers a urlset, eight urlsets an index, which also names the next index
    and, in a circle, the root. The root names every third index and, on hosts under .net, one of another host. Every seventh
    urlset is named nowhere, every eleventh is broken, and an index may name a next one that never landed."""
    pages = t.base("pages").filter("url RLIKE '^https?://[^/?#]'").select(host_of(F.col("url")).alias("host"), "url", F.floor(F.col("page_id") / 4).alias("leaf"), F.floor(F.col("page_id") / 32).alias("mid"))
    start = F.concat(F.lit("https://"), F.col("host"))

    def document(name: str, locations) -> F.Column:
        inner = "sitemap" if name == "sitemapindex" else "url"
        texts = F.transform(locations, lambda x: F.concat(F.lit(f"<{inner}><loc> "), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</loc></{inner}>")))
        return F.concat(F.lit(HEAD.format(name)), F.array_join(texts, "\n"), F.lit(f"</{name}>"))

    def at(name: str, number) -> F.Column:
        return F.concat(start, F.lit(f"/{name}-"), number.cast("string"), F.lit(".xml"))

    leaves = pages.groupBy("host", "leaf", "mid").agg(F.collect_list("url").alias("urls")).select("host", "leaf", "mid", document("urlset", F.col("urls")).alias("xml"))
    broken = F.when(F.col("leaf") % 11 == 5, F.regexp_replace("xml", "</urlset>$", "")).otherwise(F.col("xml"))
    mids = leaves.groupBy("host", "mid").agg(F.collect_list(F.when(F.col("leaf") % 7 != 3, at("leaf", F.col("leaf")))).alias("urls"))
    onward = F.when((F.col("mid") + 1) % 3 != 0, F.array(at("mid", F.col("mid") + 1))).otherwise(F.array().cast("array<string>"))
    circle = F.array(F.concat(start, F.lit("/sitemap.xml")))
    tops = mids.groupBy("host").agg(F.collect_list(F.when(F.col("mid") % 3 == 0, at("mid", F.col("mid")))).alias("urls"))
    foreign = F.when(F.col("host").endswith(".net"), F.array(F.lit(FOREIGN))).otherwise(F.array().cast("array<string>"))
    documents = (
        leaves.select(at("leaf", F.col("leaf")).alias("url"), broken.alias("xml"))
        .unionByName(mids.select(at("mid", F.col("mid")).alias("url"), document("sitemapindex", F.concat("urls", onward, circle)).alias("xml")))
        .unionByName(tops.select(F.concat(start, F.lit("/sitemap.xml")).alias("url"), document("sitemapindex", F.concat("urls", foreign)).alias("xml")))
    )
    return pages.select(F.col("host").alias("site_id"), F.concat(start, F.lit("/sitemap.xml")).alias("root_url")).distinct(), documents


TREE = (
    "p AS (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, url, page_id // 4 AS leaf, page_id // 32 AS mid FROM pages WHERE regexp_matches(url, '^https?://[^/?#]')), mids AS (SELECT DISTINCT host, mid FROM p),"
    " way AS (SELECT host, mid, 1 AS level FROM mids WHERE mid % 3 = 0 UNION ALL SELECT way.host, mids.mid, level + 1 FROM way JOIN mids ON mids.host = way.host AND mids.mid = way.mid + 1 WHERE mids.mid % 3 <> 0),"
    " leaves AS (SELECT DISTINCT p.host, leaf, level + 1 AS level FROM p JOIN way USING (host, mid) WHERE leaf % 7 <> 3),"
    " tree AS (SELECT host AS site_id, 'https://' || host || '/sitemap.xml' AS url, 0 AS level, 'index' AS kind, CASE WHEN suffix(host, '.net') THEN 'foreign' END AS problem FROM (SELECT DISTINCT host FROM p)"
    " UNION ALL SELECT host, 'https://' || host || '/mid-' || mid || '.xml', level, 'index', NULL FROM way"
    " UNION ALL SELECT host, 'https://' || host || '/mid-' || (mid + 1) || '.xml', level + 1, 'missing', 'missing' FROM way WHERE (mid + 1) % 3 <> 0 AND (host, mid + 1) NOT IN (SELECT (host, mid) FROM mids)"
    " UNION ALL SELECT host, 'https://' || host || '/leaf-' || leaf || '.xml', level, CASE WHEN leaf % 11 = 5 THEN 'invalid' ELSE 'urlset' END, CASE WHEN leaf % 11 = 5 THEN 'invalid' END FROM leaves) "
)


@query("sitemap_tree", TREE + "SELECT * FROM tree", recursive=True)
def _(t: Tables):
    return sitemaps.sitemap_tree(*landed(t)).select("site_id", "url", "level", "kind", "problem")


@query(
    "sitemap_tree_inventory",
    TREE + "SELECT p.host AS site_id, sha256(regexp_replace(lower(regexp_extract(p.url, '^https?://[^/?#]+')) || CASE WHEN regexp_matches(p.url, '^https?://[^/?#]+/') THEN '' ELSE '/' END || regexp_replace(p.url, '^https?://[^/?#]+', ''), '#.*$', '')) AS url_hash, MIN(level) AS level, bool_and(complete) AS complete"
    " FROM p JOIN leaves ON p.host = leaves.host AND p.leaf = leaves.leaf AND p.leaf % 11 <> 5 JOIN (SELECT site_id, COUNT(problem) = 0 AS complete FROM tree GROUP BY site_id) s ON s.site_id = p.host GROUP BY ALL",
    recursive=True,
)
def _(t: Tables):
    return sitemaps.inventory(sitemaps.sitemap_tree(*landed(t)))


RULE = "rule string, rule_type string, site_ids array<string>, source string, metric string, goal_version_id string, threshold double, comparison double, minimum_baseline int, maturity_lag_days int, quiet_periods array<string>"
RULES = [
    ("sync", "sync_failure", None, "search", None, None, 1.0, None, 0, 0, None),
    ("stale", "stale_data", None, "search", None, None, 2.0, None, 0, 0, None),
    ("unbound", "missing_binding", None, "web", None, None, 3.0, None, 0, 0, None),
    ("ended", "missing_binding", None, "search", None, None, 3.0, None, 0, 0, None),
    ("cover", "coverage_drop", None, None, None, None, 10.0, None, 5, 0, None),
    ("cover_web", "coverage_drop", ["site-1", "site-5"], "web", None, None, 20.0, None, 5, 0, None),
    ("high", "absolute_threshold", None, "search", "visits", None, 6.0, None, 0, 0, ["12:00-13:00", "22:00-06:00"]),
    ("swing", "relative_change", None, "search", "visits", None, None, 30.0, 4, 1, None),
    ("silent", "zero_after_nonzero", None, "web", "visits", None, None, 1.0, 1, 0, None),
    ("apart", "cross_provider_divergence", None, None, "visits", None, 50.0, None, 0, 0, None),
    ("goal", "goal_change", None, None, None, "share", None, 25.0, 1, 0, None),
    ("wrong", "relative_change", None, "search", "visits", None, 5.0, 30.0, 0, 0, None),
]


def _literal(value) -> str:
    return "NULL" if value is None else f"[{', '.join(map(_literal, value))}]" if isinstance(value, list) else f"'{value}'" if isinstance(value, str) else str(value)


#: Conditions of the types: what is fired, from value v, baseline b, threshold t, comparison c.
ALERTS = (
    "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_literal, r[:10]))})" for r in RULES) + ") AS r(rule, rule_type, site_ids, source, metric, goal, t, c, least_n, lag)),"
    " days AS (SELECT DISTINCT site_id, day, site_id = 'site-4' AS late FROM hits),"
    " c AS (SELECT site_id, source, day, CAST(value AS DOUBLE) AS value, value IS NOT NULL AND day(day) % 10 <> 3 AS ok FROM (SELECT site_id, day, unnest(['search', 'web']) AS source, unnest([a, b]) AS value FROM pair)),"
    " goals AS (SELECT site_id, day, CASE WHEN a + b > 0 THEN 100.0::DOUBLE * a / (a + b) END AS value FROM pair),"
    " due AS (SELECT r.*, d.site_id, d.day AS due, d.day - CAST(lag AS INTEGER) AS day, late FROM rules r JOIN days d ON site_ids IS NULL OR list_contains(site_ids, d.site_id)),"
    " ended AS (SELECT *, CAST(finished_at AS DATE) AS done FROM runs),"
    " cov AS (SELECT site_id, source, day, COUNT(*) FILTER (ok) AS n_ok, COUNT(*) AS n FROM c GROUP BY ALL UNION ALL SELECT site_id, 'all', day, COUNT(*) FILTER (ok), COUNT(*) FROM c GROUP BY ALL),"
    " m AS (SELECT 'sync_failure' AS rule_type, d.site_id, source, d.day, CAST(COUNT(*) FILTER (status = 'failed' AND (last_ok IS NULL OR (finished_at, run_id) > last_ok)) AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS b, 0 AS n FROM (SELECT d.site_id, d.day, e.source, MAX((finished_at, run_id)) FILTER (status = 'success') AS last_ok FROM days d JOIN ended e ON e.site_id = d.site_id AND done <= d.day GROUP BY ALL) d JOIN ended e USING (site_id, source) WHERE done <= d.day GROUP BY ALL"
    " UNION ALL SELECT 'stale_data', d.site_id, source, d.day, CAST(date_diff('day', CAST(MAX(window_end) FILTER (status = 'success') AS DATE), d.day) + 1 AS DOUBLE), NULL, 0 FROM days d JOIN ended e ON e.site_id = d.site_id AND done <= d.day GROUP BY d.site_id, source, d.day"
    " UNION ALL SELECT 'missing_binding', d.site_id, source, d.day, CASE WHEN d.site_id = 'site-2' AND source = 'search' THEN greatest(0, date_diff('day', DATE '2024-01-10', d.day)) ELSE 0 END, NULL, 0 FROM days d JOIN (SELECT DISTINCT site_id, source FROM runs) USING (site_id) WHERE NOT (site_id = 'site-3' AND source = 'web')"
    " UNION ALL SELECT 'coverage_drop', x.site_id, x.source, x.day, SUM(y.n_ok) FILTER (y.day > x.day - 7) / SUM(y.n) FILTER (y.day > x.day - 7), SUM(y.n_ok) FILTER (y.day <= x.day - 7) / SUM(y.n) FILTER (y.day <= x.day - 7), COUNT(*) FILTER (y.day <= x.day - 7) FROM cov x JOIN cov y ON x.site_id = y.site_id AND x.source = y.source AND y.day BETWEEN x.day - 13 AND x.day GROUP BY ALL"
    " UNION ALL SELECT 'absolute_threshold', site_id, source, day, CASE WHEN ok THEN value END, NULL, 0 FROM c"
    " UNION ALL SELECT 'relative_change', x.site_id, x.source, x.day, CASE WHEN x.ok THEN x.value END, AVG(y.value), COUNT(y.value) FROM c x LEFT JOIN c y ON x.site_id = y.site_id AND x.source = y.source AND y.ok AND y.day >= x.day - 7 AND y.day < x.day GROUP BY ALL"
    " UNION ALL SELECT 'zero_after_nonzero', x.site_id, x.source, x.day, CASE WHEN x.ok THEN x.value END, arg_max(y.value, y.day), COUNT(y.value) FROM c x LEFT JOIN c y ON x.site_id = y.site_id AND x.source = y.source AND y.ok AND y.day < x.day GROUP BY ALL"
    " UNION ALL SELECT 'cross_provider_divergence', site_id, 'all', day, CASE WHEN bool_and(ok) THEN CASE WHEN MAX(value) = MIN(value) THEN 0 ELSE (MAX(value) - MIN(value)) / MAX(value) * 100 END END, NULL, 0 FROM c GROUP BY ALL"
    " UNION ALL SELECT 'goal_change', x.site_id, 'all', x.day, x.value, arg_max(y.value, y.day), COUNT(y.value) FROM goals x LEFT JOIN goals y ON x.site_id = y.site_id AND y.value IS NOT NULL AND y.day < x.day GROUP BY ALL),"
    " s AS (SELECT rule, due.site_id, due AS day, v AS value, b AS baseline, CASE WHEN rule = 'wrong' THEN 'error' WHEN v IS NULL AND due.rule_type <> 'missing_binding' THEN 'suppressed_incomplete'"
    " WHEN due.rule_type IN ('coverage_drop', 'relative_change', 'zero_after_nonzero', 'goal_change') AND (b IS NULL OR n < least_n OR (b = 0 AND due.rule_type IN ('relative_change', 'goal_change'))) THEN 'insufficient_baseline'"
    " WHEN NOT CASE due.rule_type WHEN 'missing_binding' THEN v IS NULL OR v >= t WHEN 'coverage_drop' THEN round((b - v) * 100, 9) >= t WHEN 'zero_after_nonzero' THEN v = 0 AND b >= c WHEN 'relative_change' THEN abs(v - b) / b * 100 >= c WHEN 'goal_change' THEN abs(v - b) / b * 100 >= c ELSE v >= t END THEN 'clear'"
    " WHEN rule = 'high' AND late THEN 'suppressed_quiet' ELSE 'triggered' END AS state FROM due LEFT JOIN m ON m.rule_type = due.rule_type AND m.site_id = due.site_id AND m.day = due.day AND m.source = coalesce(due.source, 'all')),"
    " g AS (SELECT *, COUNT(*) FILTER (state <> 'triggered') OVER (PARTITION BY rule, site_id ORDER BY day) AS island FROM s)"
    " SELECT rule, site_id, day, round(value, 6) AS value, round(baseline, 6) AS baseline, state, CASE WHEN state = 'triggered' THEN MIN(CASE WHEN state = 'triggered' THEN day END) OVER (PARTITION BY rule, site_id, island) END AS incident FROM g"
)


@query("alert_rules", ALERTS, "pair", "runs")
def _(t: Tables):
    rules = t.spark.createDataFrame(RULES, RULE)
    at = F.date_trunc("day", "day") + F.when(F.col("site_id") == "site-4", F.expr("INTERVAL 23 HOURS")).otherwise(F.expr("INTERVAL 9 HOURS"))
    days = t.hits.select("site_id", "day").distinct().withColumn("at", at)
    each = F.explode(F.array(F.struct(F.lit("search").alias("source"), F.col("a").alias("value")), F.struct(F.lit("web").alias("source"), F.col("b").alias("value"))))
    cells = t.pair.select("site_id", "day", each.alias("x")).select("site_id", "x.source", F.lit("visits").alias("metric"), "day", F.col("x.value").cast("double").alias("value"))
    cells = cells.withColumn("complete", F.col("value").isNotNull() & (F.dayofmonth("day") % 10 != 3))
    bindings = t.runs.select("site_id", "source").distinct().filter("NOT (site_id = 'site-3' AND source = 'web')")
    bindings = bindings.select("site_id", "source", F.expr("DATE '2015-01-01' AS bound_from"), F.expr("CASE WHEN site_id = 'site-2' AND source = 'search' THEN DATE '2024-01-10' END AS bound_to"))
    share = F.when(F.col("a") + F.col("b") > 0, F.col("a") * 100.0 / (F.col("a") + F.col("b")))
    goals = t.pair.select(F.lit("share").alias("goal_version_id"), "site_id", "day", share.cast("double").alias("value")).withColumn("complete", F.col("value").isNotNull())
    return alerts.evaluate(rules, days, cells, t.runs, bindings, goals).withColumns({"value": F.round("value", 6), "baseline": F.round("baseline", 6)})
