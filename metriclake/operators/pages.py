"""The page cube, route clusters, page rankings and the index census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.catalog import COMPLETENESS

MEASURES = ("pageviews", "clicks", "impressions", "position_weight")


def materialize_page_daily(facts: DataFrame) -> DataFrame:
    """Page facts as one wide row per site, route, day, source and surface.

    Measures are null where the source doesn't have them; the weight of a position is its mean times the
    impressions; completeness is the least settled of the cell's facts.
    """

    def total(metric: str) -> Column:
        return F.sum(F.when(F.col("metric") == metric, F.col("value")))

    rank = F.array_position(F.array(*[F.lit(c) for c in COMPLETENESS]), F.col("completeness"))
    cell = facts.filter(F.col("dims")["route"].isNotNull()).groupBy("site_id", F.col("dims")["route"].alias("route"), F.to_date("start_ts").alias("day"), "source", F.coalesce(F.col("dims")["search_type"], F.lit("web")).alias("search_type"))
    out = cell.agg(
        total("web.pageviews").alias("pageviews"),
        total("search.clicks").alias("clicks"),
        total("search.impressions").alias("impressions"),
        F.avg(F.when(F.col("metric") == "search.position", F.col("value"))).alias("position"),
        F.min_by("completeness", rank).alias("completeness"),
        F.max("observed_at").alias("observed_at"),
        F.count("*").alias("n_facts"),
    )
    return out.withColumn("position_weight", F.col("position") * F.col("impressions")).drop("position")


def page_catalog(facts: DataFrame) -> DataFrame:
    """Pages by site and route with their id, first and last day and sources."""
    rows = facts.filter(F.col("dims")["route"].isNotNull()).groupBy("site_id", F.col("dims")["route"].alias("route"))
    out = rows.agg(F.to_date(F.min("start_ts")).alias("first_seen"), F.to_date(F.max("start_ts")).alias("last_seen"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.withColumn("page_id", F.sha2(F.concat_ws("\0", "site_id", "route"), 256))


def page_pivot(daily: DataFrame, *keys: str) -> DataFrame:
    """Sums per key of what each source measures; null where there was no row."""
    web, search = F.col("source") == "web", F.col("source") == "search"
    return daily.groupBy(*keys).agg(
        F.sum(F.when(web, F.col("pageviews"))).cast("double").alias("pageviews"),
        F.sum(F.when(search, F.col("clicks"))).cast("double").alias("clicks"),
        F.sum(F.when(search, F.col("impressions"))).cast("double").alias("impressions"),
        F.sum(F.when(search, F.col("position_weight"))).cast("double").alias("position_weight"),
    )


def with_ratios(metrics: DataFrame) -> DataFrame:
    """ctr and position from the sums."""
    some = F.col("impressions") > 0
    return metrics.withColumn("ctr", F.when(some, F.col("clicks") / F.col("impressions"))).withColumn("position", F.when(some, F.col("position_weight") / F.col("impressions")))


def page_metrics(catalog: DataFrame, daily: DataFrame, first: str, last: str, surface: str) -> DataFrame:
    """All pages of the catalog with their sums in the window; pages without data keep nulls."""
    inside = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & ((F.col("source") != "search") | (F.col("search_type") == surface))
    sums = page_pivot(daily.filter(inside), "site_id", "route")
    return catalog.select("site_id", "route", "page_id").join(sums, ["site_id", "route"], "left")


def index_coverage(inventory: DataFrame, status: DataFrame, cutoff: str) -> DataFrame:
    """Per site: pages, freshly inspected, of those indexed, oldest fresh day; a percentage only if complete."""
    fresh = status.filter(F.col("inspected_on") >= F.lit(cutoff).cast("date"))
    rows = inventory.join(fresh, "url_hash", "left").groupBy("site_id")
    out = rows.agg(F.count("*").alias("published"), F.count("verdict").alias("inspected"), F.count_if(F.col("indexed")).alias("indexed"), F.min("inspected_on").alias("oldest_fresh"))
    return out.withColumn("percentage", F.when(F.col("inspected") == F.col("published"), F.round(100.0 * F.col("indexed") / F.col("published"), 2)))


def pending(inventory: DataFrame, status: DataFrame, before: str, n: int) -> DataFrame:
    """The n pages to inspect next: never inspected first, then the oldest inspected before a day."""
    rows = inventory.join(status.select("url_hash", "inspected_on"), "url_hash", "left")
    due = rows.filter(F.col("inspected_on").isNull() | (F.col("inspected_on") < F.lit(before).cast("date")))
    return due.orderBy(F.col("inspected_on").isNotNull(), "inspected_on", "url_hash").limit(n)


def top_pages(metrics: DataFrame, sort: str, limit: int, offset: int = 0, min_impressions: int = 0) -> DataFrame:
    """A page of the ranking by one measure; unknown values come last, ties by site and route."""
    some = metrics.filter(F.coalesce("impressions", F.lit(0)) >= min_impressions)
    return some.orderBy(F.col(sort).desc_nulls_last(), "site_id", "route").offset(offset).limit(limit)


def ctr_opportunities(metrics: DataFrame, min_impressions: int, max_ctr: float, pool: int, limit: int) -> DataFrame:
    """Of the pages with most impressions, those with a low click-through rate."""
    rows = metrics.filter(F.col("impressions") >= min_impressions).orderBy(F.desc("impressions"), "site_id", "route").limit(pool)
    return rows.filter(F.col("ctr") <= max_ctr).orderBy(F.desc("impressions"), "site_id", "route").limit(limit)


def cluster_rollup(metrics: DataFrame, clusters: Column, exclusive: bool = True) -> DataFrame:
    """Sums per cluster id (an array column per page) and the share of all impressions if clusters exclude
    each other."""
    rows = metrics.withColumn("cluster_id", F.explode(clusters))
    out = rows.groupBy("cluster_id").agg(F.count("*").alias("n_pages"), *[F.sum(c).alias(c) for c in MEASURES])
    whole = F.sum("impressions").over(Window.partitionBy())  # a row per cluster
    return out.withColumn("impression_share", F.col("impressions") / whole if exclusive else F.lit(None).cast("double"))


def active_versions(activations: DataFrame, versions: DataFrame) -> DataFrame:
    """The version of each scheme that was activated last."""
    order = Window.partitionBy("scheme_id").orderBy(F.desc("activated_at"), F.desc("activation_id"))
    last = activations.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("scheme_id", "version_id", "activated_at")
    return last.join(versions, ["scheme_id", "version_id"])


def ranked_sites(rows: DataFrame, value: str) -> DataFrame:
    """Rows (one per site) with their share of the total and their length relative to the largest."""
    everything = Window.partitionBy()  # a row per site
    return rows.withColumn("share", F.col(value) / F.sum(value).over(everything)).withColumn("bar", F.col(value) / F.max(value).over(everything)).orderBy(F.desc(value), "site_id")


def heatmap_levels(cells: DataFrame, value: str, levels: int = 5) -> DataFrame:
    """cells with level: null stays null, zero is 0, others 1 to `levels` relative to the largest value."""
    rows = cells.withColumn("_top", cells.agg(F.max(value)).scalar())
    level = F.when(F.col(value).isNull(), None).when((F.col(value) <= 0) | (F.col("_top") <= 0), 0).otherwise(F.greatest(F.lit(1), F.ceil(levels * F.col(value) / F.col("_top")).cast("int")))
    return rows.withColumn("level", level).drop("_top")
