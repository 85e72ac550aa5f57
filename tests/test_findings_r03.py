"""Queries against their SQL on small tables made by hand that hold what the given ones hold only at larger sizes."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest

from metriclake.plans import registry
from test_oracles import rows


def equal(spark, folder, name, **tables):
    """Write the tables (rows, schema) in a folder and compare the query with its SQL there."""
    connection = duckdb.connect()
    for table, (given, schema) in tables.items():
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df, result = registry.queries()[name](spark, str(folder)), connection.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    found = rows(df.columns, df.collect())
    assert found == rows(columns, result.fetchall())
    return found


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_a_position_of_zero_is_a_measured_one(spark, tmp_path):
    at = datetime(2024, 1, 3, 12)
    given = [(1, at, 7, "view", 0.0, '{"k": 3}'), (2, at, 7, "view", 8.0, '{"k": 4}'), (3, at, 7, "click", 5.0, '{"k": 4}'), (4, at, 7, "error", 0.0, '{"k": 5}')]
    assert [r[5] for r in equal(spark, tmp_path, "daily_series", events=(given, EVENTS))] == [4.0]


@pytest.mark.parametrize("cut", ["a &amp; b&amp", "a &lt", "&quot;a&#x27", "&amp;amp; &ampx;", "1&copy=2"])
def test_references_that_are_not_closed_stay_as_they_are(spark, tmp_path, cut):
    page = f"<html><head><title>{cut}</title></head><body><h1>{cut}</h1><p><a href=\"/x?a={cut}\">{cut}</a></p></body></html>"
    equal(spark, tmp_path, "html_page_facts", pages=([(1, "https://x.example/a", page)], "page_id long, url string, html string"))
    equal(spark, tmp_path / "links", "json_ld_types", documents=([(1, f"{cut}</script>", "en", cut)], "doc_id long, text string, lang string, source string"))


def test_ways_over_two_links_are_summed_in_parts_of_their_number(spark, monkeypatch):
    from collections import Counter

    from metriclake.operators import graph
    from metriclake.sources import shared

    monkeypatch.setattr(shared, "ROWS", 100)
    links = [(i % 13, i * i % 17) for i in range(300)]
    ways = Counter((a, d) for a, b in links for c, d in links if b == c)
    found = graph.neighbour_pairs(spark.createDataFrame(links, "src long, dst long"))
    assert {(r.src, r.dst): r.n for r in found.collect()} == ways
    assert found.rdd.getNumPartitions() == -(-sum((Counter(x[1] for x in set(links))[m] * Counter(x[0] for x in set(links))[m]) for m in range(17)) // 100) > 4
    assert graph.neighbour_pairs(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_links_of_parts_are_sorted_in_parts_of_their_number(spark, monkeypatch):
    from metriclake.sources import shared
    from metriclake.sources.derived import Tables

    want = Tables(spark, "/root/testdata/sf0.001").part_edges
    monkeypatch.setattr(shared, "ROWS", 500)
    edges = Tables(spark, "/root/testdata/sf0.001").part_edges
    assert edges.rdd.getNumPartitions() > 4 and edges.exceptAll(want).isEmpty() and want.exceptAll(edges).isEmpty()


def test_two_hops_look_for_repeats_near_the_page_only(spark):
    from metriclake.operators import graph

    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (3, 4), (5, 1), (5, 5), (6, 7)], "src long, dst long")
    found = graph.two_hop(edges, 1)
    assert sorted(r.node for r in found.collect()) == [2, 3, 5]
    sums = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert len(sums) == 1, sums  # of the nodes found


def test_ranges_of_nodes_fall_in_buckets_of_their_own(spark):
    from metriclake.operators import graph
    from pyspark.sql import functions as F

    nodes = spark.range(1000).select(F.col("id").alias("node"))
    found = graph.node_ranges(nodes, 4).groupBy("range", F.pmod(F.hash("range"), F.lit(4)).alias("bucket")).agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(found) == 4 and len({r.bucket for r in found}) == 4
    assert all(r.n == r.high - r.low + 1 for r in found)


def test_links_of_components_are_made_once(spark):
    found = registry.queries()["component_edges_large"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def test_batches_of_several_files_close_the_same_runs(spark, monkeypatch):
    import pandas as pd

    from metriclake.plans import streams
    from metriclake.sources import shared
    from metriclake.streaming import jobs, progress

    at_once, read = [], jobs.read_files
    monkeypatch.setattr(shared, "ROWS", 1000)
    monkeypatch.setattr(streams, "LEAST", 100)
    monkeypatch.setattr(jobs, "read_files", lambda *a, **k: at_once.append(k["at_once"]) or read(*a, **k))
    connection = duckdb.connect()
    connection.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.1/events.parquet')")
    df = registry.queries()["stream_watermark"](spark, "/root/testdata/sf0.1")
    result = connection.execute(registry.oracle_sql()["stream_watermark"])
    columns = [c[0] for c in result.description]
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall()) and at_once[0] > 1
    many = pd.DataFrame({"binding_key": "b", "run_id": ["r", "s"] * 500, "kind": "fact", "end": range(1000), "expected": 0, "arrived": pd.Timestamp("2024-01-01")})
    assert [(r.run_id, r.n, r.end) for r in next(progress.summed(iter([many]))).itertuples()] == [("r", 500, 998), ("s", 500, 999)]


def test_quoted_values_are_looked_for_once(spark):
    from metriclake.functions import text

    line = """href: "/a" to='/b' push(`/c`) xhref: "/no" url = { "/no" action={'/d'} href: {"/no"} to: "/e" to: "/f" replace ( "" [t](/g) url : "/h" url: "/no" """
    found = text.source_links(spark.createDataFrame([(1, 0, line)], "doc_id long, line int, text string"))
    assert sorted((r.source, r.value) for r in found.collect()) == [("jsx-literal", "/b"), ("jsx-literal", "/d"), ("markdown", "/g"), ("object-field", "/a"), ("object-field", "/e"), ("object-field", "/f"), ("object-field", "/h"), ("router-literal", "/c")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
