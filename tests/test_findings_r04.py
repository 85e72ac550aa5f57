"""What a run over much larger tables found: steps that moved more than their input."""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import datetime

import pytest


def ways_of(links):
    after = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
    return Counter((a, d) for a, b in links if b is not None for d in after.get(b, ()))


def test_pairs_of_two_steps_are_made_where_they_are_summed(spark):
    from metriclake.operators import graph

    links = [(i % 50, (i * 7 + i // 50) % 50) for i in range(1000)]
    found = graph.neighbour_pairs(spark.createDataFrame(links, "src long, dst long"))
    assert {(r.src, r.dst): r.n for r in found.collect()} == ways_of(links)
    nodes = [x.strip(" :+-*(0123456789)") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    nodes = [x for x in nodes if x.startswith(("Repartition", "Join"))]
    assert nodes[0].startswith("Repartition") and nodes[1].startswith("Join")
    moved = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert moved.count("posexplode") == 2  # below it come middles, not pairs


@pytest.mark.parametrize("rows, chunk", [(20, 3), (200, 3), (200, 1024), (5000, 16)])
def test_pairs_of_hubs_and_of_nodes_without_a_name_are_whole(spark, monkeypatch, rows, chunk):
    from metriclake.operators import graph
    from metriclake.sources import shared

    some = random.Random(4)
    links = [(some.randrange(60), some.randrange(60)) for _ in range(400)] + [(7, x) for x in range(60)] + [(x, 7) for x in range(60)] + [(x, 11) for x in range(0, 60, 3)]
    links += [(None, 3), (None, 3), (3, None), (4, None), (5, 5), (5, 5)]
    monkeypatch.setattr(shared, "ROWS", rows)
    monkeypatch.setattr(graph, "CHUNK", chunk)
    found = graph.neighbour_pairs(spark.createDataFrame(links, "src long, dst long")).collect()
    assert len(found) == len({(r.src, r.dst) for r in found}) and {(r.src, r.dst): r.n for r in found} == ways_of(links)


def test_rounds_of_authority_shuffle_sums_only(spark, monkeypatch):
    from metriclake.operators import graph

    edges = spark.createDataFrame([(i % 40, (i * i + 3) % 41) for i in range(400)], "src long, dst long").filter("src <> dst").distinct()
    plans, write = [], graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    found = {r.node: r.score for r in graph.authority(graph.nodes_of(edges), edges, rounds=9, write_every=5).collect()}
    for plan, written in zip(plans[-2:], (False, True)):
        moved = [x for x in plan.splitlines() if "Exchange" in x and "partitioning(" in x]
        assert moved and all(re.search(r"Exchange hashpartitioning\(range#[0-9]+, 4\)", x) for x in moved), moved
        # what is written is dealt to its buckets once, else only sums are
        assert written or all("REPARTITION_BY_NUM" in x for x in moved), moved
    links, nodes = {(r.src, r.dst) for r in edges.collect()}, set(found)
    score, degree = dict.fromkeys(nodes, 1 / len(nodes)), Counter(a for a, _ in links)
    for _ in range(9):
        lost, got = sum(score[x] for x in nodes if not degree[x]) / len(nodes), Counter()
        for a, b in links:
            got[b] += score[a] / degree[a]
        score = {x: 0.15 / len(nodes) + 0.85 * (got[x] + lost) for x in nodes}
    assert found == pytest.approx(score)


def test_different_links_are_found_in_parts_of_their_number(spark, monkeypatch):
    from metriclake.operators import graph
    from metriclake.sources import shared

    links = [(i % 13, i * i % 17) for i in range(600)]
    monkeypatch.setattr(shared, "ROWS", 100)
    found = graph.build_graph(spark.createDataFrame(links, "src long, dst long"), rows=600)
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted({(a, b) for a, b in links if a != b}) and found.rdd.getNumPartitions() == 6


@pytest.mark.parametrize("name", ["graph_neighbor_join", "internal_authority", "degrees"])
def test_lines_that_differ_in_nothing_but_what_no_link_has_make_the_same_links(spark, tmp_path, name):
    from test_findings_r03 import equal

    at = datetime(2024, 1, 3)
    given = [(o, 1 + i // 2, (o * 7 + i * i) % 9, (i * 5) % 4, at, float(i * 3 % 5)) for o in range(40) for i in range(6)]
    given += [(1, 2, 5, 3 - k, at, 4.0 - k) for k in range(4)] + [(2, None, 5, 3, at, 1.0), (2, 1, None, 3, at, 1.0), (2, 1, None, 2, at, 2.0), (None, 1, 3, 1, at, 1.0), (None, 2, 4, 1, at, 1.0)]
    equal(spark, tmp_path, name, lineitem=(given, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double"))
