"""Reading, trusting and summing up metric facts.

A fact is a row (client_id, site_id, source, metric, unit, start_ts, end_ts, grain, value, dims, completeness,
observed_at, identity_version); its interval is half open. Nothing turns an unknown value into zero.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest number of digits of a count that is still exact in a decimal sum.
DIGITS = 38


def scan_facts(facts: DataFrame, versions: DataFrame, client: str, sites: list[str], metrics: list[str], start: str, end: str) -> DataFrame:
    """Facts of a client's sites and metrics that lie inside the window and have their source's current version."""
    inside = (F.col("start_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("end_ts") <= F.lit(end).cast("timestamp_ntz"))
    some = facts.filter((F.col("client_id") == client) & F.col("site_id").isin(sites) & F.col("metric").isin(metrics) & inside)
    return some.join(F.broadcast(versions), ["source", "identity_version"], "left_semi")


def supported_points(facts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Facts whose site is bound to their source, from the binding's first observed day on (a total may straddle it).

    bindings: site_id, source, observation_start date or null.
    """
    first = bindings.groupBy("site_id", "source").agg(F.max("observation_start").alias("_first"))
    begin = F.col("_first").cast("timestamp_ntz")
    late = F.col("_first").isNull() | (F.col("start_ts") >= begin) | ((F.col("grain") == "total") & (F.col("end_ts") > begin))
    return facts.join(first, ["site_id", "source"]).filter(late).drop("_first")


def usable_for_window(facts: DataFrame, level: str, always_provisional: tuple[str, ...] = ()) -> DataFrame:
    """Facts complete enough for a level (final, provisional, any); some sources never get beyond provisional."""
    if level == "any":
        return facts
    enough = ["final"] if level == "final" else ["final", "provisional"]
    settled = F.col("completeness").isin(enough)
    if always_provisional:
        settled = settled | (F.col("source").isin(list(always_provisional)) & (F.col("completeness") == "provisional"))
    return facts.filter(settled)


def filter_surface(facts: DataFrame, surface: str, without_position: tuple[str, ...] = ("image",)) -> DataFrame:
    """Facts of one search surface (a missing one is web); positions go where the surface has none."""
    on = facts.filter((F.col("source") != "search") | (F.coalesce(F.col("dims")["search_type"], F.lit("web")) == surface))
    return on.filter("metric <> 'search.position'") if surface in without_position else on


def surfaces(facts: DataFrame) -> DataFrame:
    """(surface, default): the surfaces of search facts; the default is web, else the first by name."""
    found = facts.filter("source = 'search'").select(F.coalesce(F.col("dims")["search_type"], F.lit("web")).alias("surface")).distinct()
    rank = F.row_number().over(Window.orderBy((F.col("surface") != "web"), "surface"))  # a few surfaces
    return found.select("surface", (rank == 1).alias("is_default"))


def filter_dims(facts: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return reduce(lambda df, kv: df.filter(F.col("dims")[kv[0]] == kv[1]), sorted(wanted.items()), facts)


def validate_points(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """facts with reject_reason: unknown_metric, wrong_unit, wrong_source, wrong_dimensions, or null."""
    known = catalog.select("metric", F.col("unit").alias("_unit"), F.col("source").alias("_source"), "dimension_sets")
    keys = F.array_join(F.sort_array(F.map_keys("dims")), ",")
    reason = (
        F.when(F.col("_unit").isNull(), "unknown_metric")
        .when(F.col("unit") != F.col("_unit"), "wrong_unit")
        .when(F.col("source") != F.col("_source"), "wrong_source")
        .when(~F.array_contains("dimension_sets", keys), "wrong_dimensions")
    )
    return facts.join(F.broadcast(known), "metric", "left").withColumn("reject_reason", reason).drop("_unit", "_source", "dimension_sets")


def check_fact_shape(facts: DataFrame) -> DataFrame:
    """facts with shape_error: empty_id, empty_interval, no_value, empty_dimension, or null."""
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c) == "", F.lit(True)) for c in ("client_id", "site_id", "source", "metric")])
    blank = F.exists(F.concat(F.map_keys("dims"), F.map_values("dims")), lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
    error = F.when(empty, "empty_id").when(~F.coalesce(F.col("start_ts") < F.col("end_ts"), F.lit(False)), "empty_interval").when(F.col("value").isNull(), "no_value").when(blank, "empty_dimension")
    return facts.withColumn("shape_error", error)


def check_slices(slices: DataFrame) -> DataFrame:
    """Acquisition slices with slice_error: raw rows are accepted or rejected, final ones reject none, and
    every one read a page."""
    error = (
        F.when(F.col("raw_rows") != F.col("accepted_rows") + F.col("rejected_rows"), "rows_do_not_add_up")
        .when((F.col("completeness") == "final") & (F.col("rejected_rows") > 0), "final_with_rejects")
        .when(F.col("pages_fetched") < 1, "no_page")
    )
    return slices.withColumn("slice_error", error)


def slice_totals(slices: DataFrame, *keys: str) -> DataFrame:
    return slices.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("pages_fetched", "raw_rows", "accepted_rows", "rejected_rows")])


def compile_segment(definition: str | dict, columns: dict[str, Column]) -> Column:
    """A row filter from a tree of all / any / not and leaves {dimension, operator, value(s)}.

    Operators: equals, not_equals, in, not_in, starts_with, ends_with, contains, matches, exists, missing. A
    comparison with a missing dimension is false, also under not_equals and not_in. Definitions are validated:
    an unknown dimension, operator or node raises ValueError.
    """
    node = json.loads(definition) if isinstance(definition, str) else definition
    if len(node) == 1 and next(iter(node)) in ("all", "any", "not"):
        kind, inner = next(iter(node.items()))
        if kind == "not":
            return ~compile_segment(inner, columns)
        if not inner:
            raise ValueError(f"{kind} needs at least one condition")
        parts = [compile_segment(x, columns) for x in inner]
        return reduce((lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b), parts)
    if node.get("dimension") not in columns:
        raise ValueError(f"unknown dimension {node.get('dimension')!r}")
    c, value = columns[node["dimension"]], node.get("value")
    leaves = {
        "equals": lambda: c == value,
        "not_equals": lambda: c != value,
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~c.isin(list(value)),
        "starts_with": lambda: c.startswith(value),
        "ends_with": lambda: c.endswith(value),
        "contains": lambda: c.contains(value),
        "matches": lambda: c.rlike(value),
        "exists": lambda: c.isNotNull(),
        "missing": lambda: c.isNull(),
    }
    if node.get("operator") not in leaves:
        raise ValueError(f"unknown operator {node.get('operator')!r}")
    return F.coalesce(leaves[node["operator"]](), F.lit(False))


def agg_sum(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.sum("value").alias("value"))


def agg_latest(facts: DataFrame, *keys: str) -> DataFrame:
    """The value of the latest interval, then of the latest observation (then the largest)."""
    return facts.groupBy(*keys).agg(F.max_by("value", F.struct("end_ts", "observed_at", "value")).alias("value"))


def agg_window_exact(facts: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Only facts without dimensions whose interval is the window itself; the latest observation counts."""
    same = (F.col("start_ts") == F.lit(start).cast("timestamp_ntz")) & (F.col("end_ts") == F.lit(end).cast("timestamp_ntz"))
    return facts.filter(same & (F.size("dims") == 0)).groupBy(*keys).agg(F.max_by("value", F.struct("observed_at", "value")).alias("value"))


def bounded_sum(column: Column, digits: int) -> Column:
    """The exact sum of whole non-negative counts, null if any of them or the sum is out of bounds."""
    whole = column.isNotNull() & (column >= 0) & (column == F.floor(column)) & (column < F.lit(10**digits).cast(f"decimal({DIGITS},0)"))
    total = F.try_sum(F.when(whole, column.cast(f"decimal({DIGITS},0)")))
    return F.when(F.bool_and(whole) & (total < F.lit(10**digits).cast(f"decimal({DIGITS},0)")), total)


def weighted_ctr(cells: DataFrame, *keys: str) -> DataFrame:
    """clicks / impressions of cells (keys, impressions, clicks); null if a cell with impressions lacks clicks."""
    missing = F.count_if((F.col("impressions") > 0) & F.col("clicks").isNull())
    return cells.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.when((missing == 0) & (F.sum("impressions") > 0), F.sum("clicks").cast("double") / F.sum("impressions").cast("double")).alias("ctr")
    )


def weighted_position(cells: DataFrame, *keys: str) -> DataFrame:
    """Mean position by impressions, over cells that have both; the weights are summed exactly."""
    both = F.col("position").isNotNull() & (F.col("impressions") > 0)
    weight = F.when(both, F.col("position") * F.col("impressions").cast("decimal(18,0)"))
    impressions = F.sum(F.when(both, F.col("impressions")))
    return cells.groupBy(*keys).agg(F.sum(weight).cast("double").alias("position_weight"), (F.sum(weight).cast("double") / impressions.cast("double")).alias("position"))


def daily_series(facts: DataFrame, *keys: str) -> DataFrame:
    """Values per key and day: counts add up inside a day, ratios are made of the day's sums."""
    day = F.to_date("start_ts").alias("day")

    def total(metric: str) -> Column:
        return F.sum(F.when(F.col("metric") == metric, F.col("value")))

    cell = facts.groupBy(*keys, *({"client_id"} - set(keys)), day, F.col("dims")["route"].alias("route"), F.col("dims")["search_type"].alias("search_type")).agg(
        total("search.impressions").alias("impressions"), total("search.clicks").alias("clicks"), F.max(F.when(F.col("metric") == "search.position", F.col("value"))).alias("position"), total("web.pageviews").alias("pageviews")
    )
    weight = F.when(F.col("position").isNotNull() & F.col("impressions").isNotNull(), F.col("position") * F.col("impressions"))
    return cell.groupBy(*keys, "day").agg(
        F.sum("impressions").cast("double").alias("impressions"),
        F.sum("clicks").cast("double").alias("clicks"),
        F.sum("pageviews").cast("double").alias("pageviews"),
        (F.sum("clicks").cast("double") / F.sum("impressions").cast("double")).alias("ctr"),
        (F.sum(weight).cast("double") / F.sum(F.when(weight.isNotNull(), F.col("impressions"))).cast("double")).alias("position"),
    )


def prefer_native(native: DataFrame, fixture: DataFrame, *keys: str) -> DataFrame:
    """Native rows, and fixture rows only where the keys have no native row."""
    return native.unionByName(fixture.join(native.select(*keys).distinct(), list(keys), "left_anti"))


def point_key(*columns: str) -> Column:
    """A content-addressed id: SHA-256 of the fields, each with its length before it."""
    parts = [F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def upsert_facts(current: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """One row per key, that observed last; at equal times the new one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("observed_at"), F.desc("_new"), F.desc("value")))
    return both.withColumn("_k", last).filter("_k = 1").drop("_k", "_new")


def stale_keys(history: DataFrame, batch: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Keys of the scope in history that a fresh final batch no longer has; a batch that isn't final retires none.

    batch has the scope's columns, the key, completeness. Scopes are compared by equality.
    """
    settled = batch.groupBy(*scope).agg(F.bool_and(F.col("completeness") == "final").alias("_final")).filter("_final").drop("_final")
    return history.join(settled, scope, "left_semi").join(batch.select(*scope, key).distinct(), [*scope, key], "left_anti")


def publish_snapshot(current: DataFrame, batch: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Current facts after a batch: stale keys of its scopes go, its rows replace those with the same key."""
    gone = stale_keys(current, batch, scope, key).select(*scope, key)
    return upsert_facts(current.join(gone, [*scope, key], "left_anti"), batch, *scope, key)


def apply_retention(facts: DataFrame, now: str, hourly_days: int, daily_days: int) -> DataFrame:
    """Hour facts up to hourly_days old, day facts up to daily_days old, and all others."""
    at = F.lit(now).cast("timestamp_ntz")

    def old(days: int) -> Column:
        return F.col("end_ts") < at - F.expr(f"INTERVAL {int(days)} DAYS")

    return facts.filter(~((F.col("grain") == "hour") & old(hourly_days)) & ~((F.col("grain") == "day") & old(daily_days)))


def freshness(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source").agg(F.max("end_ts").alias("last_end"), F.max("observed_at").alias("last_observed"), F.count("*").alias("n_facts"))


def to_points(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per measure that has a value."""
    return wide.unpivot(keys, measures, "measure", "value").filter("value IS NOT NULL")


def sum_collisions(rows: DataFrame, *keys: str, digits: int = 15) -> DataFrame:
    """Rows that are normalised to one key, summed exactly; too large sums are rejected."""
    out = rows.groupBy(*keys).agg(bounded_sum(F.col("value"), digits).alias("value"), F.count("*").alias("n_rows"))
    return out.withColumn("rejected", F.col("value").isNull())


def geo_rollup(rows: DataFrame, code: str, threshold: int) -> DataFrame:
    """Totals of each code of at least the threshold, and how many were withheld."""
    totals = rows.filter(F.col(code) != "").groupBy(F.col(code).alias("code")).agg(F.sum("value").alias("value"))
    withheld = totals.agg(F.count_if(F.col("value") < threshold)).scalar()
    return totals.filter(F.col("value") >= threshold).withColumn("n_withheld", withheld)
