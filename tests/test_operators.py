"""Single behaviours of operators on rows made by hand."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metriclake.functions import text as fn
from metriclake.functions import windows
from metriclake.operators import coverage, facts, graph, lake, reports
from metriclake.operators.pages import heatmap_levels


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_weighted_ctr_is_void_if_a_cell_with_impressions_lacks_clicks(spark):
    cells = spark.createDataFrame([("a", 10, 2), ("a", 30, 6), ("b", 10, None), ("b", 5, 1), ("c", 0, None)], "k string, impressions long, clicks long")
    assert {r.k: r.ctr for r in facts.weighted_ctr(cells, "k").collect()} == {"a": 0.2, "b": None, "c": None}


def test_bounded_sum_refuses_parts_negatives_and_large_totals(spark):
    rows = spark.createDataFrame([("a", "3"), ("a", "4"), ("b", "1.5"), ("c", "-1"), ("d", "60"), ("d", "60"), ("e", None)], "k string, v string").withColumn("v", F.col("v").cast("decimal(18,4)"))
    found = {r.k: r.s for r in rows.groupBy("k").agg(facts.bounded_sum(F.col("v"), 2).alias("s")).collect()}
    assert (found["a"], found["b"], found["c"], found["d"], found["e"]) == (7, None, None, None, None)


RUNS = "run_id string, site_id string, source string, binding_key string, status string, result_kind string, window_start timestamp_ntz, window_end timestamp_ntz, data_through timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz"
FACTS = "id int, site_id string, source string, start_ts timestamp_ntz, end_ts timestamp_ntz, observed_at timestamp_ntz"


def attributed(rows, runs, bindings):
    """Each fact with its run, by comparing all with all."""
    out = []
    ok = [r for r in runs if r[4] == "success" and r[10] is not None and r[5] in ("data", "empty")]
    for f in rows:
        holds = [r for r in ok if (r[1], r[2]) == (f[1], f[2]) and f[3] and r[6] <= f[3] and min(r[7], r[8] or r[7]) >= f[4]]
        under = [r for r in holds if r[5] == "data" and f[5] and r[9] <= f[5] <= r[10]]
        if len(under) == 1 and under[0] == max(holds, key=lambda r: (r[10], r[0])) and under[0][3] in bindings:
            out.append((f[0], under[0][0]))
    return sorted(out)


@pytest.mark.parametrize(("slice_", "held"), [(200_000, 1 << 20), (7, 5), (1, 1)])
def test_attribution_equals_brute_force(spark, monkeypatch, slice_, held):
    """Runs of hours and of years, one moment with many facts, slices of all sizes: runs cross the borders of tasks."""
    import random

    from metriclake.operators import sweep

    monkeypatch.setattr(sweep, "SLICE", slice_)
    monkeypatch.setattr(sweep, "HELD", held)
    rng = random.Random(4)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    runs, rows = [], []
    for i in range(120):
        begun = rng.randrange(0, 100)
        low = rng.choice([begun - rng.randrange(0, 9)] * 9 + [rng.randrange(-9000, 0)])
        runs.append((f"r{i}", f"s{i % 2}", "x", f"b{i % 5}", rng.choice(["success"] * 4 + ["failed"]), rng.choice(["data", "data", "empty", None]), at(low), at(low + rng.choice([2, 4, 8, 30])), rng.choice([None, None, at(80)]), at(begun), rng.choice([at(begun + rng.randrange(0, 4)), at(begun + 1), None])))
    for i in range(300):
        seen = rng.choice([50, rng.randrange(0, 105)])
        start = seen - rng.randrange(0, 7)
        rows.append((i, f"s{rng.choice([0, 0, 1, 2])}", "x", at(start), at(start + rng.choice([0, 1, 1, 24])), at(seen)))
    rows += [(900, "s0", "x", None, at(3), at(4)), (901, None, "x", at(2), at(3), at(4)), (902, "s0", "x", at(2), at(3), None)]
    bindings = {"b0", "b1", "b2", "b3"}
    want = attributed(rows, runs, bindings)
    assert len(want) > 10
    found = coverage.attribute(spark.createDataFrame(rows, FACTS), spark.createDataFrame(runs, RUNS), spark.createDataFrame([(b,) for b in bindings], "binding_key string"))
    assert sorted((r.id, r.run_id) for r in found.collect()) == want
    assert coverage.attribute(spark.createDataFrame([], FACTS), spark.createDataFrame(runs, RUNS), spark.createDataFrame([("b1",)], "binding_key string")).count() == 0


def test_divergence_exactly_half_is_unknown(spark):
    days = [("half", 1, 100, 100), ("half", 2, 100, 200), ("one", 1, 100, 300), ("fine", 1, 120, 100), ("same", 1, 500, 500), ("low", 1, 3, 9), ("gap", 1, 100, None)]
    rows = spark.createDataFrame(days, "k string, day int, a long, b long")
    states = {r.k: r.state for r in coverage.divergence(coverage.pair_dates(rows), "k").collect()}
    assert states == {"half": "unknown", "one": "isolated_divergence", "fine": "within_expected_variation", "same": "aligned", "low": "low_volume", "gap": "non_comparable"}


def test_missing_ranges_break_where_the_reason_changes(spark):
    rows = spark.createDataFrame([("k", date(2024, 1, d), r) for d, r in ((1, "a"), (2, "a"), (3, "b"), (5, "b"))], "k string, day date, reason string")
    found = sorted((r.reason, r.first_day.day, r.last_day.day, r.n_days) for r in coverage.missing_ranges(rows, ["k"], "reason").collect())
    assert found == [("a", 1, 2, 2), ("b", 3, 3, 1), ("b", 5, 5, 1)]


def test_zero_only_where_proven(spark):
    cells = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "k string, covered boolean")
    values = spark.createDataFrame([("c", 5.0)], "k string, value double")
    assert {r.k: r.value for r in coverage.fill_zero(cells, values, ["k"]).collect()} == {"a": 0.0, "b": None, "c": 5.0}


def test_local_days_of_23_and_25_hours(spark):
    rows = spark.createDataFrame([(date(2024, 3, 31),), (date(2024, 10, 27),), (date(2024, 7, 1),)], "d date")
    bounds = fn.local_day_bounds(F.col("d"), "Europe/Berlin")
    hours = [r[0] for r in rows.select((F.unix_timestamp(bounds["end"].cast("timestamp")) - F.unix_timestamp(bounds["start"].cast("timestamp"))) / 3600).collect()]
    assert hours == [23.0, 25.0, 24.0]


@pytest.mark.parametrize(
    ("url", "route"),
    [
        ("https://a.org/x/y/", "/x/y"),
        ("https://a.org", "/"),
        ("http://A.org/x?b=2&a=1&c=3", "/x?a=1&b=2"),
        ("/x/../y", None),
        ("https://other.org/x", None),
        ("https://u:p@a.org/x", None),
        ("/x%2Fy", None),
        ("/x%zz", None),
        ("/mail/jo@example.org", None),
        ("/session/abcdef1234567890", None),
        ("/resource/product-guide-help", "/resource/product-guide-help"),
        ("mailto:a@b.de", None),
        ("/secret/x", None),
        ("", None),
        (None, None),
        ("/caf%C3%A9 bar+x", "/caf%C3%A9%20bar+x"),
    ],
)
def test_normalize_route(spark, url, route):
    got = column(spark, [url], lambda c: fn.normalize_route(c, "a.org", ("a", "b"), ("/secret",)))[0]
    assert got == route


def test_canonical_route_classes(spark):
    urls = ["https://a.org/x", "/x//y.html", "#top", "mailto:a@b", "https://b.org/", "/x?q=1", "/x/./y", None]
    found = column(spark, urls, lambda c: fn.canonical_route(c, "https://a.org"))
    assert [(r["route"], r["class"]) for r in found] == [("/x/", "topology"), ("/x/y.html", "topology"), ("", "fragment"), ("", "action"), ("", "external"), ("", "unresolved"), ("", "unresolved"), ("", "unresolved")]


def test_segment_definitions_are_validated():
    with pytest.raises(ValueError, match="unknown dimension"):
        facts.compile_segment({"dimension": "x", "operator": "equals", "value": 1}, {})


def test_missing_dimension_is_false_in_both_directions(spark):
    for operator, expected in (("equals", [True, False, False]), ("not_equals", [False, True, False]), ("missing", [False, False, True])):
        got = column(spark, ["a", "b", None], lambda c, o=operator: facts.compile_segment({"dimension": "d", "operator": o, "value": "a"}, {"d": c}))
        assert got == expected


def test_reconciled_states(spark):
    sets = [["source-only", "artifact-only"], ["missing", "source-only"], ["redirect", "source-only"], ["redirect", "rendered-only"], ["excluded"], []]
    assert column(spark, sets, lambda c: fn.reconciled_state(c, F.lit(False)), "array<string>") == ["confirmed-page", "contradicted", "redirect", "contradicted", "excluded", "unchecked"]


def test_components_of_cycles_and_tails(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r.node: r.component for r in graph.scc(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.node: r.component for r in graph.weak_components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}


def test_authority_sums_to_one_and_finds_the_sink(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "src string, dst string")
    found = {r.node: r.score for r in graph.authority(graph.nodes_of(edges), edges).collect()}
    assert sum(found.values()) == pytest.approx(1.0) and max(found, key=found.get) == "d"


def test_no_downgrade_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("s", "n", date(2024, 1, 1), e, 1, 2, 3) for e in (0, 0, 1)], "site_id string, namespace string, data_date date, epoch int, clicks long, impressions long, position_sum long")
    expected = spark.createDataFrame([("s", "n", date(2024, 1, 1), 0, 2, 2, 4), ("s", "n", date(2024, 1, 1), 1, 9, 1, 2)], "site_id string, namespace string, data_date date, epoch int, row_count long, clicks long, impressions long")
    manifest = lake.publish(rows, expected, str(tmp_path / "lake"))
    assert {r.epoch: r.accepted for r in manifest.collect()} == {0: True, 1: False}
    assert [r.epoch for r in lake.current_partitions(manifest).collect()] == [0]
    assert lake.read_current(spark, str(tmp_path / "lake")).count() == 2
    assert spark.read.parquet(str(tmp_path / "lake/data")).filter("accepted = 'false'").count() == 1


def test_publishing_again_changes_nothing(spark, tmp_path, monkeypatch):
    kind = "site_id string, namespace string, data_date date, epoch int, clicks long, impressions long, position_sum long"
    rows = spark.createDataFrame([("s", "n", date(2024, 1, 1), e, 1, 2, 3) for e in (0, 0, 1)], kind)
    expected = spark.createDataFrame([("s", "n", date(2024, 1, 1), 0, 2, 2, 4), ("s", "n", date(2024, 1, 1), 1, 9, 1, 2)], "site_id string, namespace string, data_date date, epoch int, row_count long, clicks long, impressions long")
    folder = str(tmp_path / "lake")
    # a try that dies after its data, before its commit, leaves nothing to be read
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(lake.Log, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        lake.publish(rows, expected, folder)
    assert lake.read_current(spark, folder).count() == 0
    for _ in range(2):
        manifest = lake.publish(rows, expected, folder)
        assert lake.read_current(spark, folder).count() == 2
    lake.publish(rows, expected.withColumn("row_count", F.when(F.col("epoch") == 1, 1).otherwise(F.col("row_count"))), folder)
    assert [(r.epoch, r.impressions) for r in lake.read_current(spark, folder).collect()] == [(1, 2)]


def test_two_publishers_on_one_version(spark, tmp_path):
    """Both saw an empty folder. Of those with a partition in common one is refused; others are committed one behind the other."""
    kind = "site_id string, namespace string, data_date date, epoch int, clicks long, impressions long, position_sum long"
    rows = spark.createDataFrame([("s", "n", date(2024, 1, 1), e, 1, 2, 3) for e in (0, 0, 1, 2)], kind)
    expected = lake.control_totals(rows, *lake.PARTITION)
    folder = str(tmp_path / "lake")
    lake.publish(rows.filter("epoch = 0"), expected, folder, base=-1)
    with pytest.raises(lake.Conflict):
        lake.publish(rows.filter("epoch < 2"), expected, folder, base=-1)
    manifest = lake.publish(rows.filter("epoch = 1"), expected, folder, base=-1)
    lake.publish(rows.filter("epoch >= 1"), expected, folder, base=1)
    assert sorted((r.epoch, r.version, r.row_count) for r in manifest.collect()) == [(0, 0, 2), (1, 1, 1)]
    assert [lake.read_current(spark, folder, v).count() for v in (0, 1, 2)] == [2, 1, 1]
    assert lake.read_current(spark, folder).first().epoch == 2
    log = lake.Log(spark, folder)
    assert log.latest() == 2 and not log.put(2, "other") and log.put(3, "other", source=5)
    assert [(r.version, r.source) for r in log.read(after=2).collect()] == [(3, 5)]


def test_publishers_at_once_number_all_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def commit(i):
        log, version = lake.Log(spark, str(tmp_path)), 0
        while not log.put(version, f"n{i}"):
            version += 1
        return version

    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(commit, range(40)))
    found = lake.Log(spark, str(tmp_path)).read().collect()
    assert sorted(r.version for r in found) == sorted(versions) == list(range(40))
    assert {r.name for r in found} == {f"n{i}" for i in range(40)}


def test_deltas_merge_on_read(spark, tmp_path):
    """Batches write their own rows only; reads take the first of a key; repeats of a batch, compactions and lookups."""
    from metriclake.streaming.deltas import DeltaTable

    order = lambda: [F.desc("at")]
    table = DeltaTable(spark, str(tmp_path / "t"), ["k"], order, share=0.5, least=4)
    batches = [[(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (3, 0, "older")], [(2, 2, "d"), (3, 0, "late")], [(4, 3, "e")], [(None, 1, "n"), (2, 2, "same time, later batch")], [(9, 9, "z")]]
    frames = [spark.createDataFrame(b, "k int, at int, v string") for b in batches]
    assert table.read() is None and table.log.latest() == -1
    for n in (0, 1, 1, 2, 2):
        table.append(frames[n], n)
    assert sorted(map(tuple, table.read().collect())) == [(1, 1, "a"), (2, 2, "d"), (3, 1, "c"), (4, 3, "e")]
    assert [r.n for r in table.files().orderBy("version").collect()] == [3, 2, 1]
    for n in (3, 3, 4):
        table.append(frames[n], n)
    rows = [(None, 1, "n"), (1, 1, "a"), (2, 2, "same time, later batch"), (3, 1, "c"), (4, 3, "e"), (9, 9, "z")]
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(rows, key=repr)
    assert table.log.read().filter("kind = 'base'").count() >= 1
    assert sorted(map(tuple, table.read(version=1).collect())) == [(1, 1, "a"), (2, 2, "d"), (3, 1, "c")]
    assert sorted((r.v, r.current) for r in table.history().filter("k = 2").collect()) == [("b", False), ("d", False), ("same time, later batch", True)]
    assert [tuple(r) for r in table.lookup(spark.createDataFrame([(2,), (77,)], "k int")).collect()] == [(2, 2, "same time, later batch")]


def test_lookups_read_only_files_that_can_hold_the_keys(spark, tmp_path):
    from metriclake.streaming.deltas import DeltaTable

    table = DeltaTable(spark, str(tmp_path / "t"), ["k", "s"], lambda: [F.desc("at")], least=99)
    for n in range(12):  # all files have the same range of keys: only Bloom filters tell them apart
        some = spark.range(3000).select((F.col("id") * 12 + n).alias("k"), F.lit("x").alias("s"), F.lit(n).alias("at"))
        table.append(some, n)
    keys = spark.createDataFrame([(12 * i + 5, "x") for i in range(5, 45)], "k long, s string")
    found = table.lookup(keys)
    assert found.count() == 40 and {r.at for r in found.collect()} == {5}
    files = table.candidates(keys).count()
    assert 1 <= files <= 3
    table.append(keys.withColumn("at", F.lit(99)), 12)
    assert table.files().filter("version = 12").agg(F.sum("n")).first()[0] == 40
    assert {r.at for r in table.lookup(keys).collect()} == {99}
    assert table.lookup(spark.createDataFrame([(10**9, "x")], "k long, s string")).count() == 0


def test_heatmap_keeps_unknown_apart_from_zero(spark):
    cells = spark.createDataFrame([(1, None), (2, 0), (3, 1), (4, 10)], "k int, v int")
    assert {r.k: r.level for r in heatmap_levels(cells, "v").collect()} == {1: None, 2: 0, 3: 1, 4: 5}


def test_json_facts_of_broken_text_are_none(spark):
    texts = spark.createDataFrame([("nonsense",), (None,), ('{"points": [{"resource_id": "r", "date": "2024-01-02", "metric": "m", "unit": "u", "value": 1.5, "dimensions": {"a": "b"}}]}',)], "t string")
    assert [(r.resource_id, float(r.value), r.dimensions) for r in reports.json_facts(texts, F.col("t")).collect()] == [("r", 1.5, {"a": "b"})]


def test_report_windows():
    now = datetime.fromisoformat("2024-03-31T22:30:00+00:00")
    assert windows.report_window("Europe/Berlin", 7, 1, now=now) == (date(2024, 3, 25), date(2024, 4, 1))
    assert windows.previous_window(date(2024, 1, 8), date(2024, 1, 15)) == (date(2024, 1, 1), date(2024, 1, 8))
    with pytest.raises(ValueError, match="neither"):
        windows.report_window("UTC", 7, start=date(2024, 1, 1))


@given(st.text(alphabet="ab*?.[/", max_size=8), st.text(alphabet="ab./[", max_size=8))
@settings(max_examples=200, deadline=None)
def test_globs_match_like_shell_patterns_without_classes(glob, name):
    import re

    def match(g: str, n: str) -> bool:
        if not g:
            return not n
        if g[0] == "*":
            return match(g[1:], n) or bool(n) and match(g, n[1:])
        return bool(n) and (g[0] in ("?", n[0])) and match(g[1:], n[1:])

    assert bool(re.match(fn.glob_to_regex(glob), name)) == match(glob, name)


def test_source_links_of_whole_texts(spark):
    from metriclake.functions.text import source_links

    lines = [
        """<Link href="/a">x</Link> <Form action={'/b'} to=`/c`> <a data-x="/no">""",
        """{ path: "/no", slug: "/no", href: '/d', url: "https://e.example/" , to : " /f " }""",
        """router.push("/g"); redirect('/h'); permanentRedirect( `/i` ); push(name)""",
        "see [the guide](/j) and [](/k \"t\"), [the guide](/j) again",
        """href="/mixed' no links here""",
    ]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line int, text string")
    got = sorted((r.line, r.source, r.value, r.label) for r in source_links(rows).collect())
    assert got == sorted(
        [(0, "jsx-literal", v, "") for v in ("/a", "/b", "/c")]
        + [(1, "object-field", v, "") for v in ("/d", "https://e.example/", "/f")]
        + [(2, "router-literal", v, "") for v in ("/g", "/h", "/i")]
        + [(3, "markdown", "/j", "the guide"), (3, "markdown", "/k", "")]
    )


EVIDENCE = """<html><head><title> A  &amp; B </title><meta name="Robots" content="follow, NOINDEX"><link rel="canonical" href="https://s.example/a/">
<script type="application/ld+json">{"@graph": [{"@type": ["Article", "NewsArticle"], "author": {"@type": "Person", "name": "</b>"}}, {"@type": 7}]}</script>
<script type="application/ld+json">{"@type": "Broken"</script></head><body>
<header><a href='/menu'>Menu</a></header><nav aria-label="Breadcrumb"><ol><li><a href="/">Home</a></ol></nav>
<main><h1>One <i>title</i></h1><h1>Other</h1><p>See <a class=x rel="nofollow UGC" HREF=/b?x=1#top>the <b>b</b>
page</a> or <a href="https://other.example/c">out</a>, <a href="mailto:me@s.example">mail</a> <a name="none">no link</a>
<div data-related-content><a href="d.html">d</a></div><a data-cta href="/buy">Buy</a><a data-link-layer="utility" href="//s.example/e">e</a>
<form action="/send"><button formaction="/other">Go</button></form></main><footer><a href="/imprint">Imprint</a></footer></body></html>"""


def test_pages_are_read_with_what_stands_around_links(spark):
    from metriclake.operators import evidence

    pages = spark.createDataFrame([(1, EVIDENCE), (2, None), (3, "<a href='/x'>never closed <p>")], "page_id long, html string")
    read = evidence.read_pages(pages)
    facts = {r.page_id: r for r in evidence.page_facts(read).collect()}
    assert facts[1][1:] == ("A & B", "One title", "https://s.example/a/", False, ["Article", "NewsArticle", "Person"], 9, 1, 1)
    assert facts[2][1:] == ("", "", "", True, [], 0, 0, 0) and facts[3].n_anchors == 1
    rows = evidence.link_occurrences(read.filter("page_id = 1"), F.lit("/a/"), ("s.example",)).orderBy("ordinal").collect()
    assert [(r.destination, r.anchor_text, r.layer, r.landmark) for r in rows] == [
        ("/menu/", "Menu", "menu", "navigation"),
        ("/", "Home", "breadcrumb", "navigation"),
        ("/b/", "the b page", "contextual", "main"),
        ("https://other.example/c", "out", "contextual", "main"),
        ("mailto:me@s.example", "mail", "contextual", "main"),
        ("/a/d.html", "d", "related", "main"),
        ("/buy/", "Buy", "action", "main"),
        ("/e/", "e", "utility", "utility"),
        ("/imprint/", "Imprint", "utility", "footer"),
    ]
    assert [r.nofollow for r in rows] == [False, False, True] + [False] * 6 and [r.ordinal for r in rows if r.fragment] == [2]
    assert [r.action_kind for r in rows if r.action_kind] == ["mailto", "cta"] and [r.ordinal for r in rows if r.external] == [3]
    assert [r.repeated_template for r in rows] == [True, False, False, False, False, False, False, True, True]


def test_every_anchor_is_found_in_linear_time(spark):
    import time

    from metriclake.operators import evidence

    page = "<a href=/a>A<a href=/b>B</a></i><nav><p><a href=/c>C<img><br></nav><a href=/d>D"
    links = evidence.read_pages(spark.createDataFrame([(1, page)], "page_id long, html string")).first().links
    assert [(x.href, x.label, x.ancestors) for x in links] == [("/a", "A", []), ("/b", "B", []), ("/c", "C", ["nav"]), ("/d", "D", [])]
    for html in ("<br>" * 12_000 + "<a href=x>y</a>" * 1000, ("<p><a href=x>y</a>") * 3000, "<nav>" * 3000 + "<a href=x>" * 3000, "<b></i>" * 20_000, "<h1><title>" * 3000 + "x" * 3000):
        began = time.process_time()
        assert len([e for e in evidence.Listing(html).found if e["tag"] == "a"]) == html.count("<a ")
        assert time.process_time() - began < 1
    assert evidence.types_in('{"@type": "A", "x": [{"@type": ["B", 3, null, {"@type": "C"}]}], "\\"@type\\"": "no", "s": "\\"@type\\":\\"no\\""}') == {"A", "B", "C"}
    assert evidence.types_in("[" * 10**6) == evidence.types_in("no") == set()


def test_redirect_lines(spark):
    from metriclake.operators import evidence

    lines = ["# comment", "", "/old /new 302", "  /a/b.html   https://S.Example/x?q=1#t  ", "/only", "old /new", "//host/x /new", "/x javascript:alert(1)", "/y https://u@s.example/", "/z /w 301!", "/q \\\\bad", "/e /%zz"]
    rows = evidence.redirects(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k int, line string")).collect()
    assert {r.k: tuple(r[1:]) for r in rows} == {
        2: ("/old/", "/new", 302, None),
        3: ("/a/b.html", "https://s.example/x#t", 301, None),
        4: (None, None, None, "unparsed"),
        5: (None, None, None, "unparsed"),
        6: (None, None, None, "unparsed"),
        7: ("/x/", None, 301, "unsafe"),
        8: ("/y/", None, 301, "unsafe"),
        9: ("/z/", "/w", 301, None),
        10: ("/q/", None, 301, "unsafe"),
        11: ("/e/", None, 301, "unsafe"),
    }


def test_broken_references_over_chains_and_cycles(spark):
    import json

    from metriclake.operators import definitions

    goal = lambda *ids: json.dumps({"goal_version_ids": ids})
    rows = [(f"g{i}", "goal", goal(f"g{i + 1}")) for i in range(10)] + [("g10", "goal", goal("gone", "s"))]
    rows += [("c1", "goal", goal("c2")), ("c2", "goal", goal("c3")), ("c3", "goal", goal("c1", "lost")), ("s", "segment", '{"goal_version_ids": ["no field of segments"]}')]
    rows += [("a", "alert_rule", '{"goal_version_id": "s", "segment_version_id": "s"}'), ("r", "report_subscription", '{"goal_version_ids": ["c1", "g9", null], "segment_version_id": "c1"}')]
    rows += [("bad", "goal", "{no json"), ("none", "goal", None), ("s", "segment", "{}")]
    df = spark.createDataFrame(rows, "version_id string, definition_type string, content_json string")
    got = {tuple(r) for r in definitions.broken_references(df).collect()}
    want = {(f"g{i}", "g10", x, "goal", k, p, False) for i in range(11) for x, k, p in (("gone", None, "missing"), ("s", "segment", "type"))}
    want |= {(f"c{i}", "c3", "lost", "goal", None, "missing", True) for i in (1, 2, 3)}
    want |= {("a", "a", "s", "goal", "segment", "type", False), ("r", "r", "c1", "segment", "goal", "type", False), ("r", "c3", "lost", "goal", None, "missing", False)}
    want |= {("r", "g10", "gone", "goal", None, "missing", False), ("r", "g10", "s", "goal", "segment", "type", False)}
    assert got == want
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert definitions.closure(chain).count() == 200 * 201 // 2
    assert definitions.broken_references(df.limit(0)).count() == 0


def test_runs_close_when_all_facts_are_there_or_by_timer(spark, tmp_path):
    """Runs before, after and without their facts; late and too late ones; no state of a closed run is left."""
    from metriclake.streaming import jobs, progress

    at = lambda d, h=0: datetime(2024, 1, d, h)
    kind = "binding_key string, run_id string, kind string, end timestamp_ntz, expected long, arrived timestamp_ntz"
    files = [
        [("b", "full", "fact", at(1, 5), None, at(1)), ("b", "full", "run", at(2), 2, at(1)), ("b", "short", "run", at(3), 9, at(1)), ("b", "short", "fact", at(2, 7), None, at(1)), ("b", "never", "run", at(9), 3, at(1)), ("c", "empty", "run", at(4), 0, at(1)), ("c", "orphan", "fact", at(8), None, at(1))],
        [("b", "full", "fact", at(1, 9), None, at(2)), ("b", "short", "fact", at(2, 8), None, at(2)), ("c", "window", "run", at(5), 1, at(2)), (None, "x", "run", at(5), 1, at(2))],
        [("c", "window", "fact", at(7), None, at(3)), ("d", "open", "run", at(6), 5, at(10))],
        [("b", "short", "fact", at(2, 20), None, at(10)), ("d", "open", "fact", at(5), None, at(10, 1))],
        [("b", "short", "fact", at(2, 21), None, at(11))],
    ]
    folder = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    got = progress.closed_runs(jobs.read_files(spark, folder), "3 DAYS", str(tmp_path / "work"))
    want = {("b", "full", at(1, 9), False), ("b", "short", at(2, 20), True), ("c", "empty", at(4), False), ("c", "window", at(5), False)}
    found = {(r.binding_key, r.run_id, r.data_through, r.by_timer) for r in got.collect()}
    # the last file but one still finds `short` open: its timer fires after the rows of the batch whose watermark passed it
    assert found == want
    spark.conf.set(progress.STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        state = spark.read.format("statestore").option("path", str(tmp_path / "work" / "checkpoint")).option("stateVarName", "open").load()
        assert {(r.key[0], r.user_map_key[0]) for r in state.collect()} <= {("d", "open"), ("b", "short")}
    finally:
        spark.conf.unset(progress.STORE)


def test_a_repeated_identity_in_one_batch_is_an_error(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from metriclake.streaming import jobs

    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    rows = [("a", 1), ("b", 1)]
    for part in (rows, rows[:1]):
        spark.createDataFrame(part, "k string, at int").coalesce(1).write.mode("append").parquet(once)
    assert jobs.upsert(jobs.read_files(spark, once), ["k"], "at", strict=True).count() == 2
    spark.createDataFrame([*rows, ("a", 2)], "k string, at int").coalesce(1).write.parquet(twice)
    with pytest.raises(StreamingQueryException, match="twice"):
        jobs.upsert(jobs.read_files(spark, twice), ["k"], "at", strict=True)


def test_components_by_contraction(spark):
    """A long path in few rounds, links that fall; a random graph against union-find, with names as nodes."""
    import random

    n, report = 100_000, []
    mixed = (F.col("id") * 7919) % n  # a path whose neighbours have numbers far apart
    path = spark.range(n - 1).select(mixed.alias("src"), (((F.col("id") + 1) * 7919) % n).alias("dst"))
    found = graph.weak_components(graph.nodes_of(path), path, report)
    assert found.agg(F.count("*"), F.max("component")).first()[:] == (n, 0)
    assert len(report) <= 24 and report == sorted(report, reverse=True) and report[0] == n - 1
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [("hub", f"n{i}") for i in range(0, 90, 3)]
    nodes = {x for p in pairs for x in p} | {"alone"}
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = graph.weak_components(spark.createDataFrame([(x,) for x in nodes], "node string"), df)
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in nodes}
    assert graph.weak_components(graph.nodes_of(df.limit(0)), df.limit(0)).count() == 0


def test_authority_shuffles_no_links(spark, monkeypatch, tmp_path):
    """Hubs in several parts give the same scores; the joined plan has no exchange above the table of links."""
    rows = [(i % 40, (i * i + 3) % 41) for i in range(400)] + [(0, i) for i in range(1, 41)]
    edges = graph.build_graph(spark.createDataFrame(rows, "src int, dst int").withColumn("layer", F.lit("menu")))
    nodes = graph.nodes_of(edges)
    want = {r.node: round(r.score, 12) for r in graph.authority(nodes, edges, rounds=7).collect()}
    assert abs(sum(want.values()) - 1) < 1e-9
    monkeypatch.setattr(graph, "HUB", 7)
    assert {r.node: round(r.score, 12) for r in graph.authority(nodes, edges, rounds=7).collect()} == want
    links = graph.bucketed_links(edges, "links_of_test")
    try:
        assert links.agg(F.max("part")).first()[0] >= 4
        joined = spark.range(41).select(F.col("id").cast("int").alias("src"), (F.col("id") % 5).cast("int").alias("part")).repartition(3).hint("merge").join(links, ["src", "part"])
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Exchange" not in plan[plan.rindex("Range (") : plan.index("links_of_test")], plan
    finally:
        spark.sql("DROP TABLE links_of_test")
