"""Queries over the bulk-export lake, definitions and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from metriclake.operators import coverage, facts, lake as ops
from metriclake.operators.definitions import broken_references
from metriclake.plans.registry import query
from metriclake.sources.commits import Conflict
from metriclake.sources.derived import Tables
from metriclake.sources.shared import shared_folder

LOG = "log AS (SELECT site_id, namespace, data_date, epoch, MAX(l) AS published_at, COUNT(*) AS row_count, SUM(clicks) AS clicks, SUM(impressions) AS impressions, SUM(position_sum) AS position_sum FROM (SELECT *, l_orderkey AS l FROM bulk) GROUP BY ALL) "


def totals(rows):
    return rows.groupBy(*ops.PARTITION).agg(F.max("l_orderkey").alias("published_at"), F.count("*").alias("row_count"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("position_sum").alias("position_sum"))


def log(t: Tables):
    return totals(t.bulk)


def expected(rows):
    """Totals that the provider reported: wrong for the last epoch of one site."""
    wrong = (F.col("site_id") == "site-3") & (F.col("epoch") == 6)
    return totals(rows).withColumn("row_count", F.when(wrong, F.col("row_count") + 1).otherwise(F.col("row_count")))


def manifest(t: Tables):
    return log(t).withColumn("accepted", ~((F.col("site_id") == "site-3") & (F.col("epoch") == 6)))


MANIFEST = LOG + ", manifest AS (SELECT *, NOT (site_id = 'site-3' AND epoch = 6) AS accepted FROM log), cur AS (SELECT site_id, namespace, data_date, MAX(epoch) AS epoch FROM manifest WHERE accepted GROUP BY ALL) "


@query("bulk_latest_revision", "SELECT namespace, data_date, epoch, published_at FROM (SELECT *, row_number() OVER (PARTITION BY namespace, data_date ORDER BY epoch DESC, published_at DESC) AS k FROM (SELECT namespace, data_date, epoch, MAX(l_orderkey) AS published_at FROM bulk WHERE data_date >= DATE '1997-01-01' AND data_date < DATE '1999-01-01' GROUP BY ALL)) WHERE k = 1", "bulk")
def _(t: Tables):
    rows = t.bulk.groupBy("namespace", "data_date", "epoch").agg(F.max("l_orderkey").alias("published_at"))
    return ops.latest_revision(rows, "1997-01-01", "1999-01-01")


@query("bulk_control_totals", "SELECT site_id, namespace, COUNT(*) AS row_count, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions, CAST(SUM(position_sum) AS DOUBLE) AS position_sum, bool_and(clicks >= 0 AND impressions >= 0 AND position_sum >= 0) AS non_negative FROM bulk GROUP BY ALL", "bulk")
def _(t: Tables):
    return ops.control_totals(t.bulk, "site_id", "namespace").withColumn("position_sum", F.col("position_sum").cast("double"))


YEARLY = LOG.replace("FROM bulk", "FROM yearly").replace("log AS", "yearly AS (SELECT * REPLACE (CAST(date_trunc('year', data_date) AS DATE) AS data_date) FROM bulk), log AS", 1) + MANIFEST.removeprefix(LOG)


@query("bulk_read_partition", YEARLY + "SELECT namespace, epoch, impressions, clicks, l_orderkey FROM yearly SEMI JOIN cur USING (site_id, namespace, data_date, epoch) WHERE site_id = 'site-2' AND data_date = DATE '1998-01-01'", "bulk")
def _(t: Tables):
    """One partition of a published lake: site and date are folders, so no other files are read."""
    return ops.read_partition(ops.read_current(t.spark, published(t)[0]), "site-2", "1998-01-01").select("namespace", "epoch", "impressions", "clicks", "l_orderkey")


def published(t: Tables):
    """(folder, manifest) of a lake of all exports by years, published in two batches that started on one version: the second
    has epochs of its own, so it is committed behind the first. A third that repeats some of them is refused."""
    rows = t.bulk.withColumn("data_date", F.trunc("data_date", "year"))
    folder = f"{shared_folder(t.spark)}/lake-{uuid.uuid4().hex}"
    wanted = expected(rows)
    ops.publish(rows.filter("epoch < 4"), wanted, folder)
    manifest = ops.publish(rows.filter("epoch >= 4"), wanted, folder, base=-1)
    try:
        ops.publish(rows.filter("epoch > 1"), wanted, folder, base=-1)
    except Conflict:
        return folder, manifest
    raise AssertionError("an epoch was published twice")


@query("bulk_write_partition", YEARLY + "SELECT site_id, namespace, data_date, epoch, row_count, accepted FROM manifest", "bulk")
def _(t: Tables):
    return published(t)[1].select("site_id", "namespace", "data_date", "epoch", "row_count", "accepted")


@query("bulk_current_view", YEARLY + "SELECT site_id, namespace, data_date, epoch, COUNT(*) AS n, CAST(SUM(impressions) AS BIGINT) AS impressions FROM yearly SEMI JOIN cur USING (site_id, namespace, data_date, epoch) GROUP BY ALL", "bulk")
def _(t: Tables):
    return ops.read_current(t.spark, published(t)[0]).groupBy(*ops.PARTITION).agg(F.count("*").alias("n"), F.sum("impressions").alias("impressions"))


@query("bulk_lake_status", MANIFEST + ", d AS (SELECT site_id, data_date, COUNT(DISTINCT namespace) AS n FROM cur GROUP BY ALL) SELECT site_id, COUNT(*) AS n_dates, COUNT(*) FILTER (n = 2) AS paired, COUNT(*) FILTER (n < 2) AS unpaired, MAX(data_date) FILTER (n = 2) AS last_paired FROM d GROUP BY site_id", "bulk")
def _(t: Tables):
    return ops.lake_status(manifest(t))


@query("lake_paired_dates", "SELECT site_id, data_date, COUNT(DISTINCT namespace) = 2 AS paired FROM bulk GROUP BY ALL", "bulk")
def _(t: Tables):
    """All dates of either table of each site, with whether both have them."""
    keys = ["site_id", "data_date"]
    a = t.bulk.filter("namespace = 'url_impression'").select(*keys).distinct().withColumn("a", F.lit(True))
    b = t.bulk.filter("namespace = 'site_impression'").select(*keys).distinct().withColumn("b", F.lit(True))
    return a.join(b, keys, "full").select(*keys, (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"))


@query("bulk_verify", MANIFEST + ", r AS (SELECT site_id, namespace, data_date, epoch, COUNT(*) AS row_count FROM bulk WHERE NOT (l_orderkey = 77) GROUP BY ALL) SELECT site_id, namespace, data_date, epoch, CASE WHEN m.row_count IS NULL THEN 'undeclared' WHEN r.row_count IS NULL THEN 'no_rows' ELSE 'totals_differ' END AS problem FROM (SELECT * FROM manifest WHERE accepted) m FULL JOIN r USING (site_id, namespace, data_date, epoch) WHERE m.row_count IS DISTINCT FROM r.row_count", "bulk")
def _(t: Tables):
    return ops.verify(manifest(t), t.bulk.filter("l_orderkey <> 77"))


@query("export_log_continuity", "SELECT namespace, data_date, COUNT(*) AS n, MIN(epoch) = 0 AND MAX(epoch) = COUNT(*) - 1 AND COUNT(DISTINCT epoch) = COUNT(*) AS continuous FROM (SELECT DISTINCT namespace, data_date, epoch // 2 AS epoch FROM bulk WHERE l_orderkey % 5 <> 0 OR epoch < 6) GROUP BY ALL", "bulk")
def _(t: Tables):
    rows = t.bulk.filter("l_orderkey % 5 <> 0 OR epoch < 6").select("namespace", "data_date", F.expr("epoch DIV 2").alias("epoch")).distinct()
    return ops.check_epochs(rows)


@query(
    "bulk_sync_plan",
    MANIFEST
    + ", spine AS (SELECT site_id, namespace, CAST(m AS DATE) AS data_date FROM (SELECT DISTINCT site_id, namespace FROM bulk), (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-01', INTERVAL 1 MONTH)) AS m)), n AS (SELECT site_id, namespace, data_date, MAX(epoch) AS exported FROM log GROUP BY ALL), b AS (SELECT site_id, data_date FROM n GROUP BY ALL HAVING COUNT(DISTINCT namespace) = 2)"
    " SELECT s.site_id, s.namespace, s.data_date, CASE WHEN s.data_date < DATE '1995-06-01' THEN 'pre_activation' WHEN n.exported IS NULL OR b.site_id IS NULL THEN 'log_incomplete' WHEN c.epoch IS NULL OR c.epoch < n.exported THEN 'write' WHEN c.epoch > n.exported THEN 'refuse_downgrade' ELSE 'current' END AS action"
    " FROM spine s LEFT JOIN n USING (site_id, namespace, data_date) LEFT JOIN b USING (site_id, data_date) LEFT JOIN cur c USING (site_id, namespace, data_date)",
    "bulk",
)
def _(t: Tables):
    months = F.explode(F.expr("sequence(DATE'1995-01-01', DATE'2002-12-01', INTERVAL 1 MONTH)")).alias("data_date")
    spine = t.bulk.select("site_id", "namespace").distinct().select("site_id", "namespace", months)
    return ops.plan_sync(spine, log(t), manifest(t), "1995-06-01")


DEFINITIONS = "d AS (SELECT CAST(o_custkey AS VARCHAR) AS identity, o_orderkey AS activation_id, o_orderdate AS activated_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 60 DAYS END AS retired_at FROM orders) "


def definitions(t: Tables):
    retired = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return t.base("orders").select(F.col("o_custkey").cast("string").alias("identity"), F.col("o_orderkey").alias("activation_id"), F.col("o_orderdate").alias("activated_at"), retired.alias("retired_at"))


@query("definition_history", DEFINITIONS + "SELECT identity, activation_id FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY activated_at DESC, activation_id DESC) AS k FROM d WHERE retired_at IS NULL) WHERE k = 1")
def _(t: Tables):
    rows = definitions(t)
    retirements = rows.filter("retired_at IS NOT NULL").select("activation_id")
    last = Window.partitionBy("identity").orderBy(F.desc("activated_at"), F.desc("activation_id"))
    return rows.join(retirements, "activation_id", "left_anti").withColumn("k", F.row_number().over(last)).filter("k = 1").select("identity", "activation_id")


KIND = "CASE WHEN {p} % 10 < 6 THEN 'goal' WHEN {p} % 10 < 8 THEN 'segment' WHEN {p} % 10 = 8 THEN 'alert_rule' ELSE 'report_subscription' END"


def versions(t: Tables):
    """A version for each part but every 13th: goals made of goals in chains and some cycles, alerts and subscriptions on them."""
    p = F.col("p_partkey")

    def v(number):
        return F.concat(F.lit("v"), number.cast("string"))

    goals = F.array_compact(F.array(v(F.when((p / 10).cast("long") % 16 == 0, (p / 2).cast("long")).otherwise(p - 10)), F.when(p % 7 == 0, v(p - 20)), F.when(p % 97 == 0, v(p + 10))))
    content = F.struct(
        F.when(p % 10 < 6, goals).when(p % 10 == 9, F.array(v(p - 4), v(p - 9))).alias("goal_version_ids"),
        F.when(p % 10 == 8, v(p - 3)).alias("goal_version_id"),
        F.when(p % 10 == 8, v(F.when(p % 11 == 0, p - 4).otherwise(p - 2))).when(p % 10 == 9, v(p - 3)).alias("segment_version_id"),
    )
    return t.base("part").filter("p_partkey % 13 <> 0").select(v(p).alias("version_id"), F.expr(KIND.format(p="p_partkey")).alias("definition_type"), F.to_json(content).alias("content_json"))


@query(
    "definition_reference_check",
    f"n AS (SELECT p_partkey AS p, {KIND.format(p='p_partkey')} AS kind FROM part WHERE p_partkey % 13 <> 0),"
    " names AS (SELECT p, CASE WHEN (p // 10) % 16 = 0 THEN p // 2 ELSE p - 10 END AS r, 'goal' AS expected FROM n WHERE kind = 'goal' UNION SELECT p, p - 20, 'goal' FROM n WHERE kind = 'goal' AND p % 7 = 0 UNION SELECT p, p + 10, 'goal' FROM n WHERE kind = 'goal' AND p % 97 = 0"
    " UNION SELECT p, p - 3, 'goal' FROM n WHERE kind = 'alert_rule' UNION SELECT p, CASE WHEN p % 11 = 0 THEN p - 4 ELSE p - 2 END, 'segment' FROM n WHERE kind = 'alert_rule'"
    " UNION SELECT p, p - x, 'goal' FROM n, (SELECT unnest([4, 9]) AS x) WHERE kind = 'report_subscription' UNION SELECT p, p - 3, 'segment' FROM n WHERE kind = 'report_subscription'),"
    " named AS (SELECT names.*, n.kind AS found FROM names LEFT JOIN n ON n.p = r), paths AS (SELECT p AS a, r AS b FROM named WHERE found = expected UNION SELECT a, r FROM paths JOIN named ON p = b AND found = expected),"
    " reached AS (SELECT a, b FROM paths WHERE a <> b UNION ALL SELECT p, p FROM n)"
    " SELECT 'v' || a AS root_id, 'v' || b AS version_id, 'v' || r AS reference_id, expected, found, CASE WHEN found IS NULL THEN 'missing' ELSE 'type' END AS problem, a IN (SELECT a FROM paths WHERE a = b) AS in_cycle"
    " FROM reached JOIN named ON p = b WHERE found IS DISTINCT FROM expected",
    recursive=True,
)
def _(t: Tables):
    return broken_references(versions(t))


@query("run_ledger_counts", "SELECT COUNT(*) AS n_runs, COUNT(*) FILTER (finished_at < started_at) AS n_reversed, COUNT(*) FILTER (points_written <> real) AS n_count_differs FROM (SELECT r.*, h.n AS real FROM runs r LEFT JOIN (SELECT site_id, day, COUNT(*) AS n FROM hits WHERE event_id % 1000 <> 7 GROUP BY ALL) h USING (site_id, day))", "runs")
def _(t: Tables):
    real = t.hits.filter("event_id % 1000 <> 7").groupBy("site_id", "day").agg(F.count("*").alias("real"))
    rows = t.runs.withColumn("day", F.to_date("window_start")).join(real, ["site_id", "day"], "left")
    return rows.agg(F.count("*").alias("n_runs"), F.count_if(F.col("finished_at") < F.col("started_at")).alias("n_reversed"), F.count_if(F.col("points_written") != F.col("real")).alias("n_count_differs"))


@query("wrong_page_ids", "SELECT site_id, COUNT(*) AS n_pages, COUNT(*) FILTER (route LIKE '/s1/%7') AS n_wrong_id FROM (SELECT DISTINCT site_id, route FROM facts) GROUP BY site_id", "facts")
def _(t: Tables):
    route = F.col("dims")["route"].alias("route")
    stored = t.facts.select("site_id", route).distinct().withColumn("page_id", F.sha2(F.concat_ws("\0", "site_id", F.when(F.col("route").like("/s1/%7"), F.lit("?")).otherwise(F.col("route"))), 256))
    return stored.groupBy("site_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("page_id") != F.sha2(F.concat_ws("\0", "site_id", "route"), 256)).alias("n_wrong_id"))


@query("point_key", "SELECT sha256(length(site_id) || ':' || site_id || length(metric) || ':' || metric || length(route) || ':' || route) AS point_key, COUNT(*) AS n FROM facts GROUP BY ALL", "facts")
def _(t: Tables):
    return t.facts.withColumn("route", F.col("dims")["route"]).groupBy(facts.point_key("site_id", "metric", "route").alias("point_key")).agg(F.count("*").alias("n"))


@query("canonical_json", "SELECT DISTINCT '{\"route\":\"' || route || '\",\"search_type\":\"' || search_type || '\"}' AS dims FROM facts", "facts")
def _(t: Tables):
    from metriclake.functions.text import canonical_json

    return t.facts.select(canonical_json(F.col("dims")).alias("dims")).distinct()


@query("dims_keys", "SELECT 'route,search_type' AS keys, COUNT(*) AS n FROM facts", "facts")
def _(t: Tables):
    return t.facts.groupBy(F.array_join(F.sort_array(F.map_keys("dims")), ",").alias("keys")).agg(F.count("*").alias("n"))


@query("stream_watermark_batch", "SELECT binding_key, MAX(greatest(window_end, finished_at)) AS completed_through FROM runs WHERE status = 'success' GROUP BY binding_key", "runs")
def _(t: Tables):
    return t.runs.filter("status = 'success'").groupBy("binding_key").agg(F.max(F.greatest("window_end", "finished_at")).alias("completed_through"))


@query("top_gaps", "SELECT source, COUNT(*) AS n_missing FROM (SELECT source, day FROM (SELECT DISTINCT site_id, source FROM runs), (SELECT DISTINCT day FROM hits) EXCEPT ALL SELECT source, day FROM runs) GROUP BY source ORDER BY n_missing DESC, source LIMIT 3", "runs")
def _(t: Tables):
    bound = t.runs.select("site_id", "source").distinct()
    cells = coverage.expected_cells(bound, [{"metric": "any"}], "2024-01-01", "2024-01-30")
    missing = cells.join(t.runs.select("site_id", "source", F.to_date("window_start").alias("day")), ["site_id", "source", "day"], "left_anti")
    return missing.groupBy("source").agg(F.count("*").alias("n_missing")).orderBy(F.desc("n_missing"), "source").limit(3)


@query("date_gaps_of_exports", "SELECT site_id, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days FROM (SELECT site_id, day, day - CAST(row_number() OVER (PARTITION BY site_id ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT site_id, data_date AS day FROM bulk)) GROUP BY site_id, g", "bulk")
def _(t: Tables):
    return coverage.date_ranges(t.bulk.select("site_id", F.col("data_date").alias("day")), "site_id")
