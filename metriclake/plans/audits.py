"""Audits: a copy of the facts against the facts, acquisition records and page records, each with damage done by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from metriclake.operators import audits as ops
from metriclake.plans.registry import query
from metriclake.sources.derived import Tables

CELL = ("client_id", "metric", "route", "search_type", "start_ts")


def hashed(*fields: str) -> str:
    return "sha256(" + " || ".join(f"CAST(length({f}) AS VARCHAR) || ':' || {f}" for f in fields) + ")"


def cells(t: Tables):
    return t.facts.select("site_id", "client_id", "metric", F.col("dims")["route"].alias("route"), F.col("dims")["search_type"].alias("search_type"), "start_ts", "value")


def damaged(rows):
    """A copy that lost, doubled, changed and gained rows."""
    value = F.expr("CAST(CASE WHEN metric = 'search.position' AND route LIKE '%5' THEN value + 1 ELSE value END AS DECIMAL(18,4))")
    kept = rows.filter("NOT (metric = 'search.clicks' AND route LIKE '%7')").withColumn("value", value)
    twice = rows.filter("metric = 'web.pageviews' AND route LIKE '%3'")
    more = rows.filter("metric = 'search.impressions' AND route LIKE '%9'").withColumn("route", F.concat("route", F.lit("/new")))
    return kept.unionByName(twice).unionByName(more)


@query(
    "integrity_differences",
    "b AS (SELECT site_id AS part, client_id, metric, route, search_type, start_ts, value FROM facts),"
    " c AS (SELECT * REPLACE (CASE WHEN metric = 'search.position' AND route LIKE '%5' THEN value + 1 ELSE value END AS value) FROM b WHERE NOT (metric = 'search.clicks' AND route LIKE '%7')"
    " UNION ALL SELECT * FROM b WHERE metric = 'web.pageviews' AND route LIKE '%3' UNION ALL SELECT * REPLACE (route || '/new' AS route) FROM b WHERE metric = 'search.impressions' AND route LIKE '%9'),"
    " x AS (SELECT part, client_id, metric, route, search_type, start_ts, COUNT(*) AS n, SUM(value) AS v FROM b GROUP BY ALL),"
    " y AS (SELECT part, client_id, metric, route, search_type, start_ts, COUNT(*) AS n, SUM(value) AS v FROM c GROUP BY ALL)"
    " SELECT part, client_id, metric, route, search_type, start_ts, CASE WHEN y.n IS NULL THEN 'lost' WHEN x.n IS NULL THEN 'added' WHEN y.n > x.n THEN 'doubled' WHEN y.n < x.n THEN 'thinned' ELSE 'changed' END AS problem"
    " FROM x FULL JOIN y USING (part, client_id, metric, route, search_type, start_ts) WHERE x.n IS DISTINCT FROM y.n OR x.v IS DISTINCT FROM y.v",
    "facts",
)
def _(t: Tables):
    rows = cells(t)
    return ops.locate_differences(rows, damaged(rows), "site_id", CELL, ["site_id", *CELL, "value"])


def slices(t: Tables):
    """A slice per run; by the day of the month it has moved, has another binding, hash, identity or run, or stands twice."""
    day = F.dayofmonth("window_start")
    moved = F.when(day == 7, 3).otherwise(0)
    out = t.runs.select(
        F.concat("run_id", F.when(day == 11, "?").otherwise("")).alias("run_id"),
        F.concat(F.when(day == 8, "x|").otherwise(""), "binding_key").alias("binding_key"),
        F.concat("source", F.lit("#"), F.date_format("window_start", "yyyy-MM-dd")).alias("slice_key"),
        F.date_add("window_start", moved).cast("timestamp_ntz").alias("start_ts"),
        F.date_add("window_end", moved).cast("timestamp_ntz").alias("end_ts"),
        day.alias("day"),
    )
    out = out.withColumn("slice_id", F.when(F.col("day") == 10, F.sha2(F.concat("run_id", "slice_key"), 256)).otherwise(ops.record_hash("run_id", "binding_key", "slice_key")))
    out = out.withColumn("record_hash", F.when(F.col("day") == 9, "").otherwise(ops.record_hash(*ops.SLICE)))
    return out.unionByName(out.filter("day = 14"))


def observations(t: Tables):
    """The facts as observations of their day's slice, every sixth day of the slice before; some with another key, hash or site."""
    route, day = F.col("dims")["route"], F.to_date("start_ts")
    ran = F.date_format(F.when(F.dayofmonth("start_ts") % 6 == 0, F.date_sub(day, 1)).otherwise(day), "yyyy-MM-dd")
    run, key = F.concat_ws("|", "site_id", "source", ran), F.concat("source", F.lit("#"), ran)
    out = t.facts.select(
        ops.record_hash(run, F.concat_ws("|", "site_id", "source"), key).alias("slice_id"),
        F.when((F.col("metric") == "web.pageviews") & route.like("%21"), "site-x").otherwise(F.col("site_id")).alias("site_id"),
        "source", "metric", "start_ts", "end_ts", F.col("value").cast("string").alias("value"), route.alias("route"),
        F.concat_ws("|", F.col("site_id"), route, F.col("dims")["search_type"], "client_id").alias("dims"),
    )
    wrong_key = (F.col("metric") == "search.position") & F.col("route").like("%11")
    out = out.withColumn("point_key", F.when(wrong_key, F.sha2("dims", 256)).otherwise(ops.record_hash(*ops.POINT))).withColumn("observation_id", ops.record_hash("slice_id", "point_key"))
    wrong_hash = (F.col("metric") == "search.clicks") & F.col("route").like("%31")
    return out.withColumn("record_hash", F.when(wrong_hash, "").otherwise(ops.record_hash(*ops.OBSERVATION)))


@query(
    "integrity_audit_acquisition",
    "s0 AS (SELECT run_id || CASE WHEN day(day) = 11 THEN '?' ELSE '' END AS run_id, CASE WHEN day(day) = 8 THEN 'x|' ELSE '' END || binding_key AS binding_key, source || '#' || strftime(day, '%Y-%m-%d') AS slice_key,"
    " CASE WHEN day(day) = 7 THEN window_start + INTERVAL 3 DAYS ELSE window_start END AS start_ts, CASE WHEN day(day) = 7 THEN window_end + INTERVAL 3 DAYS ELSE window_end END AS end_ts, day(day) AS d FROM runs),"
    f" s AS (SELECT *, CASE WHEN d = 10 THEN sha256(run_id || slice_key) ELSE {hashed('run_id', 'binding_key', 'slice_key')} END AS slice_id FROM s0),"
    " s2 AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE d = 14),"
    " f0 AS (SELECT *, strftime(CASE WHEN day(day) % 6 = 0 THEN day - 1 ELSE day END, '%Y-%m-%d') AS ran FROM facts),"
    f" f1 AS (SELECT {hashed("(site_id || '|' || source || '|' || ran)", "(site_id || '|' || source)", "(source || '#' || ran)")} AS slice_id, CASE WHEN metric = 'web.pageviews' AND route LIKE '%21' THEN 'site-x' ELSE site_id END AS owner,"
    " source, metric, start_ts, end_ts, route, site_id || '|' || route || '|' || search_type || '|' || client_id AS dims FROM f0),"
    " f2 AS (SELECT *, metric = 'search.position' AND route LIKE '%11' AS wrong_key FROM f1),"
    f" f3 AS (SELECT *, CASE WHEN wrong_key THEN sha256(dims) ELSE {hashed('owner', 'source', 'metric', 'CAST(start_ts AS VARCHAR)', 'CAST(end_ts AS VARCHAR)', 'dims')} END AS point_key FROM f2),"
    f" o AS (SELECT *, {hashed('slice_id', 'point_key')} AS observation_id FROM f3),"
    " r AS (SELECT s2.*, runs.site_id, runs.source, runs.binding_key AS bound, window_start, window_end, runs.run_id IS NOT NULL AS known FROM s2 LEFT JOIN runs USING (run_id)),"
    " u AS (SELECT DISTINCT slice_id, start_ts AS low, end_ts AS high, site_id, source AS of_source FROM r),"
    " l AS (SELECT o.*, low, high, u.site_id, of_source, u.slice_id IS NOT NULL AS linked FROM o LEFT JOIN u USING (slice_id))"
    " SELECT 'slice' AS record, slice_id AS record_id, 'identity' AS problem FROM r WHERE d = 10 UNION ALL SELECT 'slice', slice_id, 'hash' FROM r WHERE d = 9 UNION ALL SELECT 'slice', slice_id, 'run' FROM r WHERE NOT known"
    " UNION ALL SELECT 'slice', slice_id, 'binding' FROM r WHERE known AND binding_key <> bound UNION ALL SELECT 'slice', slice_id, 'window' FROM r WHERE known AND (start_ts >= window_end OR end_ts <= window_start)"
    " UNION ALL SELECT 'slice', slice_id, 'repeated' FROM s2 GROUP BY slice_id HAVING COUNT(*) > 1"
    " UNION ALL SELECT 'observation', observation_id, 'key' FROM l WHERE wrong_key UNION ALL SELECT 'observation', observation_id, 'hash' FROM l WHERE metric = 'search.clicks' AND route LIKE '%31'"
    " UNION ALL SELECT 'observation', observation_id, 'slice' FROM l WHERE NOT linked UNION ALL SELECT 'observation', observation_id, 'window' FROM l WHERE linked AND (start_ts >= high OR end_ts <= low)"
    " UNION ALL SELECT 'observation', observation_id, 'owner' FROM l WHERE linked AND (owner <> site_id OR source <> of_source OR site_id IS NULL)"
    " UNION ALL SELECT 'observation', observation_id, 'repeated' FROM o GROUP BY observation_id HAVING COUNT(*) > 1",
    "runs",
    "facts",
)
def _(t: Tables):
    return ops.acquisition_problems(t.runs, slices(t), observations(t))


def joined(*fields: str) -> str:
    return "sha256(" + " || chr(0) || ".join(fields) + ")"


@query(
    "integrity_audit_pages",
    f"p AS (SELECT p_partkey AS k, 's' || p_partkey % 5 AS site_id, {joined("'page-v1'", "('s' || p_partkey % 5)", "('/p/' || p_partkey)")} AS right_id FROM part),"
    " p2 AS (SELECT *, CASE WHEN k % 50 = 7 THEN sha256('/p/' || k) ELSE right_id END AS page_id FROM p),"
    " v0 AS (SELECT o_orderkey AS k, 'c' || o_orderkey % 50 AS scheme_id, CASE WHEN o_orderkey % 45 = 1 THEN 'other' WHEN o_orderkey % 3 = 0 THEN 'multilabel' ELSE 'exclusive' END AS mode FROM orders),"
    " v1 AS (SELECT *, CASE WHEN k % 40 = 5 THEN '{\"mode\":\"' || mode || '\",\"id\":' || k || '}' ELSE '{\"id\":' || k || ',\"mode\":\"' || mode || '\"}' END AS json FROM v0),"
    " v2 AS (SELECT *, CASE WHEN k % 60 = 2 THEN sha256(mode) ELSE sha256(json) END AS hash FROM v1),"
    f" v AS (SELECT *, CASE WHEN k % 70 = 3 THEN sha256(json || 'x') ELSE {joined("'scheme-v1'", 'scheme_id', 'hash')} END AS version_id FROM v2),"
    " a AS (SELECT v.version_id, right_id AS page_id, mode FROM lineitem JOIN v ON v.k = l_orderkey JOIN p ON p.k = l_suppkey % 9 + 1)"
    " SELECT 'page' AS record, page_id AS record_id, 'identity' AS problem FROM p2 WHERE page_id <> right_id"
    " UNION ALL SELECT 'version', version_id, 'json' FROM v WHERE k % 40 = 5 UNION ALL SELECT 'version', version_id, 'hash' FROM v WHERE k % 60 = 2 UNION ALL SELECT 'version', version_id, 'identity' FROM v WHERE k % 70 = 3 UNION ALL SELECT 'version', version_id, 'mode' FROM v WHERE k % 45 = 1"
    " UNION ALL SELECT 'activation', CAST(k AS VARCHAR), 'scheme' FROM v WHERE k % 55 = 4"
    " UNION ALL SELECT 'assignment', version_id || ' ' || page_id, 'overlap' FROM a WHERE mode = 'exclusive' GROUP BY version_id, page_id HAVING COUNT(*) > 1"
    " UNION ALL SELECT 'link', CAST(k AS VARCHAR), 'site' FROM p WHERE k % 35 = 6 OR k % 50 = 7",
)
def _(t: Tables):
    k = F.col("p_partkey")
    site, route = F.concat(F.lit("s"), (k % 5).cast("string")), F.concat(F.lit("/p/"), k.cast("string"))
    parts = t.base("part").select(k, site.alias("site_id"), route.alias("route"), ops.page_id(site, route).alias("right_id"))
    pages = parts.withColumn("page_id", F.when(k % 50 == 7, F.sha2("route", 256)).otherwise(F.col("right_id")))
    o = F.col("o_orderkey")
    mode = F.when(o % 45 == 1, "other").when(o % 3 == 0, "multilabel").otherwise("exclusive")
    made = t.base("orders").select(o, F.concat(F.lit("c"), (o % 50).cast("string")).alias("scheme_id"), mode.alias("mode"))
    text = F.when(o % 40 == 5, F.format_string('{"mode":"%s","id":%d}', "mode", "o_orderkey")).otherwise(F.format_string('{"id":%d,"mode":"%s"}', "o_orderkey", "mode"))
    made = made.withColumn("definition_json", text).withColumn("definition_hash", F.sha2(F.when(o % 60 == 2, F.col("mode")).otherwise(F.col("definition_json")), 256))
    versions = made.withColumn("version_id", F.when(o % 70 == 3, F.sha2(F.concat("definition_json", F.lit("x")), 256)).otherwise(ops.scheme_version_id("scheme_id", "definition_hash")))
    activations = versions.select(o.alias("activation_id"), F.when(o % 55 == 4, "c-").otherwise(F.col("scheme_id")).alias("scheme_id"), "version_id")
    lines = t.base("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 9 + 1).alias("p_partkey"))
    assignments = lines.join(versions.select("o_orderkey", "version_id"), "o_orderkey").join(parts.select("p_partkey", F.col("right_id").alias("page_id")), "p_partkey")
    links = parts.select(k.alias("link_id"), F.when(k % 35 == 6, "s9").otherwise(F.col("site_id")).alias("site_id"), F.col("right_id").alias("page_id"))
    return ops.page_problems(pages, versions, activations, assignments, links)
