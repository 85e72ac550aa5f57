"""Web-metrics tables derived from the star-schema tables: one data set for examples, tests and benchmarks.

Each function is a plain DataFrame transformation, so reading it costs the columns it names.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metriclake.sources.shared import dealt

FACTS = "client_id, site_id, source, metric, unit, start_ts, end_ts, grain, value, dims, completeness, observed_at, identity_version"


class Tables:
    """The base tables in a folder and what is derived from them, each built once per query."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def hits(self) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return self.base("events").select(
            "event_id",
            "ts",
            F.to_date("ts").alias("day"),
            "user_id",
            "event_type",
            "value",
            k.alias("k"),
            F.concat(F.lit("client-"), (F.col("user_id") % 2).cast("string")).alias("client_id"),
            F.concat(F.lit("site-"), (F.col("user_id") % 7).cast("string")).alias("site_id"),
            F.concat(F.lit("/s"), (k % 5).cast("string"), F.lit("/"), k.cast("string")).alias("route"),
            F.when(k % 10 == 0, "image").otherwise("web").alias("search_type"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        """One row per client, site, route, surface and day with the provider's numbers."""

        def n(kind: str):
            return F.count_if(F.col("event_type") == kind)

        position = F.min(F.when(F.col("event_type") == "view", F.col("value").cast("decimal(18,2)")))
        return self.hits.groupBy("client_id", "site_id", "route", "search_type", "day").agg(
            n("view").alias("impressions"), n("click").alias("clicks"), position.alias("position"), n("purchase").alias("pageviews"), F.max("ts").alias("observed_at")
        )

    @cached_property
    def facts(self) -> DataFrame:
        """The long fact table: one row per metric, cell and provider."""
        return self.measured.filter("value > 0")

    @cached_property
    def measured(self) -> DataFrame:
        """facts with positions of zero too: a position is a measured value wherever a cell has one, a count of zero is no row."""
        cells = self.cells
        wide = cells.select(
            "client_id",
            "site_id",
            F.col("day").cast("timestamp_ntz").alias("start_ts"),
            F.date_add("day", 1).cast("timestamp_ntz").alias("end_ts"),
            F.lit("day").alias("grain"),
            F.create_map(F.lit("route"), F.col("route"), F.lit("search_type"), F.col("search_type")).alias("dims"),
            F.when(F.col("day") >= F.lit("2024-01-29").cast("date"), "provisional").otherwise("final").alias("completeness"),
            "observed_at",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(source).alias("source"), F.lit(metric).alias("metric"), F.lit(unit).alias("unit"), value.cast("decimal(18,4)").alias("value"))
                        for source, metric, unit, value in (
                            ("search", "search.impressions", "count", F.col("impressions")),
                            ("search", "search.clicks", "count", F.col("clicks")),
                            ("search", "search.position", "rank", F.col("position")),
                            ("web", "web.pageviews", "count", F.col("pageviews")),
                        )
                    ]
                )
            ).alias("m"),
        )
        out = wide.select("*", "m.*").filter("value > 0 OR metric = 'search.position' AND value IS NOT NULL")
        stale = (F.dayofmonth("start_ts") == 13) & (F.col("source") == "web")
        return out.withColumn("identity_version", F.when(stale, 0).otherwise(1)).selectExpr(*FACTS.split(", "))

    @cached_property
    def runs(self) -> DataFrame:
        """The run ledger: one run per site, source and day; every sixth day has none, bad days failed."""
        days = self.hits.groupBy("site_id", "day").agg(F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
        source = F.explode(F.array(F.lit("search"), F.lit("web"))).alias("source")
        out = days.filter("dayofmonth(day) % 6 != 0").select("site_id", source, "day", "last_ts", "errors", "n")
        return out.select(
            F.concat_ws("|", "site_id", "source", F.date_format("day", "yyyy-MM-dd")).alias("run_id"),
            F.concat_ws("|", "site_id", "source").alias("binding_key"),
            "site_id",
            "source",
            F.col("day").cast("timestamp_ntz").alias("window_start"),
            F.date_add("day", 1).cast("timestamp_ntz").alias("window_end"),
            F.col("day").cast("timestamp_ntz").alias("started_at"),
            F.col("last_ts").alias("finished_at"),
            F.when(F.col("errors") * 4 > F.col("n"), "failed").otherwise("success").alias("status"),
            F.col("n").alias("points_written"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """runs with what they brought and how far it reaches, among runs of three days, of whole months and of years: on
        every sixth day two days are fetched again, or proven empty; each month had a run that failed, and a run of years
        ended before all others. Every fifth day's run reaches to noon only."""
        daily = self.runs.select(
            "run_id", "binding_key", "site_id", "source", "window_start", "window_end", "started_at", "finished_at", "status",
            F.lit("data").alias("result_kind"),
            F.when(F.dayofmonth("window_start") % 5 == 0, F.col("window_start") + F.expr("INTERVAL 12 HOURS")).alias("data_through"),
        )
        days = self.hits.groupBy("site_id", "day").agg(F.max("ts").alias("finished_at"))
        again = days.filter("dayofmonth(day) % 6 = 0").withColumn("source", F.explode(F.array(F.lit("search"), F.lit("web"))))
        start, long_ago = F.col("day").cast("timestamp_ntz"), F.lit("2015-01-01").cast("timestamp_ntz")
        kinds = F.explode(
            F.array(
                F.struct(F.lit("again").alias("kind"), F.date_sub("day", 2).cast("timestamp_ntz").alias("low"), start.alias("begun"), F.lit("success").alias("status"), F.when(F.dayofmonth("day") % 12 == 0, "data").otherwise("empty").alias("result_kind")),
                F.struct(F.lit("month").alias("kind"), F.trunc("day", "month").cast("timestamp_ntz").alias("low"), start.alias("begun"), F.lit("failed").alias("status"), F.lit("data").alias("result_kind")),
                F.struct(F.lit("years").alias("kind"), long_ago.alias("low"), long_ago.alias("begun"), F.lit("success").alias("status"), F.lit("data").alias("result_kind")),
            )
        )
        more = again.select("*", kinds.alias("r")).select(
            F.concat_ws("|", "site_id", "source", "r.kind", F.date_format("day", "yyyy-MM-dd")).alias("run_id"),
            F.concat_ws("|", "site_id", "source").alias("binding_key"),
            "site_id",
            "source",
            F.col("r.low").alias("window_start"),
            F.date_add("day", 1).cast("timestamp_ntz").alias("window_end"),
            F.col("r.begun").alias("started_at"),
            F.when(F.col("r.kind") == "years", F.lit("2023-12-31").cast("timestamp_ntz")).otherwise(F.col("finished_at")).alias("finished_at"),
            F.col("r.status").alias("status"),
            F.col("r.result_kind").alias("result_kind"),
            F.lit(None).cast("timestamp_ntz").alias("data_through"),
        )
        return daily.unionByName(more)

    @cached_property
    def pair(self) -> DataFrame:
        """Daily values of two providers for the same sites; not every day has both."""
        a, b = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
        days = self.hits.filter("k % 10 < 6").groupBy("site_id", "day").agg(a.alias("a"), b.alias("b"))
        return days.select("site_id", "day", F.when(F.dayofmonth("day") % 9 != 0, F.col("a")).alias("a"), F.when(F.dayofmonth("day") % 7 != 0, F.col("b")).alias("b"))

    @cached_property
    def forms(self) -> DataFrame:
        """Form submissions: an order is a submission of its customer's nation's site."""
        status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
        customers = self.base("customer").select("c_custkey", "c_nationkey")
        orders = self.base("orders").select("o_orderkey", "o_custkey", "o_orderdate", status.alias("status"), "o_orderpriority")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("c_nationkey").alias("site"), F.trunc("o_orderdate", "month").alias("month"), F.to_date("o_orderdate").alias("day"), "status", F.substring("o_orderpriority", 1, 1).alias("form_id"), "o_orderkey"
        )

    @cached_property
    def route_edges(self) -> DataFrame:
        """Link occurrences between routes: a user's steps with a large value, by time."""
        step = Window.partitionBy("user_id").orderBy("ts", "event_id")
        layer = F.expr("CASE event_type WHEN 'view' THEN 'contextual' WHEN 'click' THEN 'related' WHEN 'signup' THEN 'action' WHEN 'error' THEN 'utility' ELSE 'menu' END")
        steps = self.hits.withColumn("before", F.lag("route").over(step))
        return steps.filter("before IS NOT NULL AND value > 25 AND before <> route").select(F.col("event_id").alias("link_id"), F.col("before").alias("src"), F.col("route").alias("dst"), layer.alias("layer"), "day", "value")

    @cached_property
    def n_lines(self) -> int:
        """Rows of lineitem; part_edges has fewer."""
        return self.base("lineitem").count()

    @cached_property
    def part_edges(self) -> DataFrame:
        """Links between parts that follow each other in an order; a graph that grows with the data.

        All lines are read. Lines of one order, number and part follow each other, in any order of theirs: a link has nothing of a line but its part.
        """
        line = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_partkey"))
        lines = self.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        steps = dealt(lines, self.n_lines, "l_orderkey").withColumn("before", F.lag("l_partkey").over(line))
        layer = F.expr("element_at(array('menu', 'contextual', 'related', 'action', 'utility', 'breadcrumb'), CAST(l_partkey % 6 AS INT) + 1)")
        return steps.filter("before IS NOT NULL AND before <> l_partkey").select(F.col("before").alias("src"), F.col("l_partkey").alias("dst"), layer.alias("layer"))

    @cached_property
    def bulk(self) -> DataFrame:
        """Rows of a revisioned bulk export: site, date, epoch and the counts of the row."""
        return self.base("lineitem").select(
            F.concat(F.lit("site-"), (F.col("l_suppkey") % 5).cast("string")).alias("site_id"),
            F.when(F.col("l_linenumber") % 2 == 0, "url_impression").otherwise("site_impression").alias("namespace"),
            F.trunc("l_shipdate", "month").alias("data_date"),
            (F.col("l_linenumber") - 1).cast("int").alias("epoch"),
            F.col("l_quantity").cast("long").alias("impressions"),
            (F.col("l_quantity").cast("long") % 7).alias("clicks"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("position_sum"),
            "l_orderkey",
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """Published pages of each site."""
        return self.base("documents").select(F.col("source").alias("site_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"), "doc_id")

    @cached_property
    def url_status(self) -> DataFrame:
        """Inspections: a labelled page passed or failed; every fifth label is old."""
        labels = self.base("labels")
        return labels.select(
            F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"),
            F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"),
            (F.col("quality") == 1).alias("indexed"),
            F.date_sub(F.lit("2024-02-01").cast("date"), F.when(F.col("doc_id") % 5 == 0, 40).otherwise((F.col("doc_id") % 20).cast("int"))).alias("inspected_on"),
        )

    @cached_property
    def lanes(self) -> DataFrame:
        """Route candidates of three evidence lanes, by page number."""
        ids = self.base("pages").select("page_id", F.concat(F.lit("/p/"), (F.col("page_id") % 97).cast("string"), F.lit("/")).alias("route"))
        source = ids.filter("page_id % 2 = 0").select(F.lit("source").alias("lane"), "route", F.when(F.col("page_id") % 11 == 0, "redirect").otherwise("source-only").alias("state"), "page_id")
        artifact = ids.filter("page_id % 3 = 0").select(F.lit("artifact").alias("lane"), "route", F.when(F.col("page_id") % 13 == 0, "excluded").otherwise("artifact-only").alias("state"), "page_id")
        rendered = ids.filter("page_id % 5 = 0").select(F.lit("rendered").alias("lane"), "route", F.when(F.col("page_id") % 17 == 0, "missing").otherwise("rendered-only").alias("state"), "page_id")
        return reduce(DataFrame.unionByName, (source, artifact, rendered))
