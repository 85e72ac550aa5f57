"""The metric catalog: how each metric is summed up, where it comes from and which dimensions it may carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: metric, source, unit, aggregation, its dimension sets (keys joined by commas), inputs that its coverage needs.
METRICS = (
    ("search.impressions", "search", "count", "sum", ("route,search_type", ""), ("search.impressions",)),
    ("search.clicks", "search", "count", "sum", ("route,search_type", ""), ("search.clicks",)),
    ("search.position", "search", "rank", "weighted", ("route,search_type", ""), ("search.position", "search.impressions")),
    ("search.ctr", "search", "ratio", "weighted", ("",), ("search.clicks", "search.impressions")),
    ("web.pageviews", "web", "count", "sum", ("route,search_type", ""), ("web.pageviews",)),
    ("web.visitors", "web", "count", "daily-unique", ("",), ("web.visitors",)),
    ("shop.orders", "shop", "count", "window", ("",), ("shop.orders",)),
    ("shop.open_orders", "shop", "count", "latest", ("",), ("shop.open_orders",)),
)
COLUMNS = "metric string, source string, unit string, aggregation string, dimension_sets array<string>, inputs array<string>"
#: Versions of point identity that are current for each source; facts of other versions are stale.
IDENTITY_VERSIONS = (("search", 1), ("web", 1), ("shop", 1))
#: Ranks of completeness, from least to most settled.
COMPLETENESS = ("unknown", "realtime", "provisional", "final")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """One row per metric; a fixed small table, safe to broadcast."""
    return spark.createDataFrame([(m, s, u, a, list(d), list(i)) for m, s, u, a, d, i in METRICS], COLUMNS)


def identity_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IDENTITY_VERSIONS, "source string, identity_version int")
