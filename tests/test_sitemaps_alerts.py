"""Sitemap trees and alert rules on rows made by hand."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from metriclake.operators import alerts, sitemaps
from metriclake.plans.alerts import RULE

INDEX = "<sitemapindex>{}</sitemapindex>"
SET = '<?xml version="1.0" encoding="UTF-8"?><!-- a --><s:urlset xmlns:s="http://x">{}</s:urlset>'


def listed(shell, *locations):
    return shell.format("".join(f"<x><loc>{x}</loc></x>" if shell is INDEX else f"<s:url><s:loc> {x} </s:loc></s:url>" for x in locations))


def test_contents_of_documents():
    assert sitemaps.contents(listed(SET, "http://a/1", "http://a/2?x=1&amp;y=2")) == ("urlset", ["http://a/1", "http://a/2?x=1&y=2"])
    assert sitemaps.contents(listed(INDEX)) == ("index", [])
    for broken in (None, "", "text", "<urlset><loc>http://a/1</loc>", "<html><loc>http://a/1</loc></html>", "<!DOCTYPE x><urlset/>", "<urlset/><urlset/>"):
        assert sitemaps.contents(broken) == ("invalid", [])
    assert len(sitemaps.contents(listed(SET, *[f"http://a/{i}" for i in range(50_000)]))[1]) == 50_000


def test_tree_with_circles_repeats_foreign_hosts_and_depth(spark):
    documents = [
        ("https://a.org/sitemap.xml", listed(INDEX, "https://A.org/one.xml", "https://a.org/one.xml", "https://a.org/deep-1.xml", "https://a.org/gone.xml")),
        ("https://a.org/one.xml", listed(SET, "https://a.org/p#x", "https://a.org/p", "https://b.org/q")),
        ("https://a.org/one.xml", "<zzz/>"),
        *[(f"https://a.org/deep-{i}.xml", listed(INDEX, f"https://a.org/deep-{i + 1}.xml", "https://a.org/sitemap.xml", f"https://a.org/set-{i}.xml")) for i in range(1, 6)],
        *[(f"https://a.org/set-{i}.xml", listed(SET, f"https://a.org/d{i}", "https://a.org/p")) for i in range(1, 6)],
        ("https://c.org/sitemap.xml", listed(SET)),
        (None, listed(SET, "https://a.org/never")),
    ]
    sites = [("a", "https://a.org/sitemap.xml"), ("a", "https://a.org/sitemap.xml"), ("c", "https://c.org/sitemap.xml"), ("d", "https://d.org/sitemap.xml"), ("e", None)]
    tree = sitemaps.sitemap_tree(spark.createDataFrame(sites, "site_id string, root_url string"), spark.createDataFrame(documents, "url string, xml string"))
    found = {(r.site_id, r.url.rpartition("/")[2]): (r.level, r.kind, r.problem) for r in tree.collect()}
    assert tree.count() == len(found)
    want = {("a", "sitemap.xml"): (0, "index", None), ("a", "gone.xml"): (1, "missing", "missing"), ("c", "sitemap.xml"): (0, "urlset", None), ("d", "sitemap.xml"): (0, "missing", "missing")}
    want |= {("a", f"deep-{i}.xml"): (i, "index", "too_deep" if i == 4 else None) for i in range(1, 5)} | {("a", f"set-{i}.xml"): (i + 1, "urlset", None) for i in range(1, 4)}
    want["a", "one.xml"] = (1, "invalid", "invalid")  # of two contents the smaller: invalid before urlset
    assert found == want
    pages = sitemaps.inventory(tree).collect()
    assert sorted((r.site_id, r.level, r.complete) for r in pages) == [("a", 2, False), ("a", 2, False), ("a", 3, False), ("a", 4, False)]  # p, d1, d2, d3
    empty = sitemaps.sitemap_tree(spark.createDataFrame([], "site_id string, root_url string"), spark.createDataFrame([], "url string, xml string"))
    assert empty.count() == 0 and sitemaps.inventory(empty).count() == 0


def rule(name, kind, **fields):
    base = dict(site_ids=None, source=None, metric=None, goal_version_id=None, threshold=None, comparison=None, minimum_baseline=0, maturity_lag_days=0, quiet_periods=None) | fields
    return (name, kind, *[base[c.split()[0]] for c in RULE.split(", ")[2:]])


def evaluated(spark, rules, values=(), runs=(), bindings=(), goals=(), n=12, hour=9):
    """values: (source, day number, value); the states and values of each rule by day number."""
    start = date(2024, 1, 1)

    def on(i):
        return start + timedelta(days=i)

    days = spark.createDataFrame([("s", on(i), datetime(2024, 1, 1, hour) + timedelta(days=i)) for i in range(n)], "site_id string, day date, at timestamp_ntz")
    cells = spark.createDataFrame([("s", k, "m", on(i), v, v is not None) for k, i, v in values], "site_id string, source string, metric string, day date, value double, complete boolean")
    ran = spark.createDataFrame([(str(j), "s", "a", s, datetime(2024, 1, 1, 5) + timedelta(days=i), datetime(2024, 1, 1) + timedelta(days=i)) for j, (i, s) in enumerate(runs)], "run_id string, site_id string, source string, status string, finished_at timestamp_ntz, window_end timestamp_ntz")
    bound = spark.createDataFrame([("s", "a", on(i), None if j is None else on(j)) for i, j in bindings], "site_id string, source string, bound_from date, bound_to date")
    reached = spark.createDataFrame([("g", "s", on(i), v, v is not None) for i, v in goals], "goal_version_id string, site_id string, day date, value double, complete boolean")
    out: dict = {}
    for r in alerts.evaluate(spark.createDataFrame(rules, RULE), days, cells, ran, bound, reached, baseline_days=3).collect():
        out.setdefault(r.rule, {})[(r.day - start).days] = (r.state, r.value, r.incident and (r.incident - start).days)
    return out


def states(found, name):
    return [found[name][i][0] for i in sorted(found[name])]


def test_zero_and_goal_compare_over_gaps(spark):
    values = [("a", 0, 5.0), ("a", 1, None), ("a", 4, 0.0), ("a", 5, 0.0), ("a", 6, 2.0)]
    goals = [(0, 10.0), (1, None), (5, 14.0), (6, 14.0)]
    rules = [rule("zero", "zero_after_nonzero", source="a", metric="m", comparison=1.0, minimum_baseline=1), rule("goal", "goal_change", goal_version_id="g", comparison=25.0, minimum_baseline=1)]
    found = evaluated(spark, rules, values, goals=goals, n=7)
    assert states(found, "zero") == ["insufficient_baseline", "suppressed_incomplete", "suppressed_incomplete", "suppressed_incomplete", "triggered", "clear", "clear"]
    assert states(found, "goal") == ["insufficient_baseline", *["suppressed_incomplete"] * 4, "triggered", "clear"]


def test_runs_bindings_and_incidents(spark):
    runs = [(1, "success"), (2, "failed"), (3, "failed"), (6, "success"), (7, "failed")]
    rules = [rule("fail", "sync_failure", source="a", threshold=2.0), rule("stale", "stale_data", source="a", threshold=3.0), rule("bound", "missing_binding", source="a", threshold=2.0), rule("never", "missing_binding", source="b", threshold=2.0)]
    found = evaluated(spark, rules, runs=runs, bindings=[(0, 3), (8, None)], n=10)
    assert states(found, "fail") == ["suppressed_incomplete", "clear", "clear", *["triggered"] * 3, *["clear"] * 4]
    assert [found["fail"][i][2] for i in range(10)] == [None] * 3 + [3] * 3 + [None] * 4
    assert [found["stale"][i][1] for i in range(1, 10)] == [1, 2, 3, 4, 5, 1, 2, 3, 4]
    assert [found["bound"][i][1] for i in range(10)] == [0, 0, 0, 0, 1, 2, 3, 4, 0, 0]
    assert states(found, "never") == ["triggered"] * 10 and {x[2] for x in found["never"].values()} == {0}


def test_thresholds_quiet_periods_lag_divergence_and_coverage(spark):
    values = [("a", i, None if i in (6, 7, 8) else float(i)) for i in range(10)] + [("b", i, 4.0) for i in range(10)]
    rules = [
        rule("high", "absolute_threshold", source="a", metric="m", threshold=5.0),
        rule("late", "absolute_threshold", source="a", metric="m", threshold=5.0, maturity_lag_days=2),
        rule("quiet", "absolute_threshold", source="a", metric="m", threshold=5.0, quiet_periods=["23:00-09:01"]),
        rule("loud", "absolute_threshold", source="a", metric="m", threshold=5.0, quiet_periods=["23:00-09:00"]),
        rule("apart", "cross_provider_divergence", metric="m", threshold=50.0),
        rule("cover", "coverage_drop", source="a", threshold=60.0, minimum_baseline=3),
        rule("change", "relative_change", source="a", metric="m", comparison=100.0, minimum_baseline=3),
        rule("both", "absolute_threshold", source="a", metric="m"),
        rule("odd", "no_such_type", threshold=1.0),
    ]
    found = evaluated(spark, rules, values, n=10)
    none = "suppressed_incomplete"
    assert states(found, "high") == ["clear"] * 5 + ["triggered"] + [none] * 3 + ["triggered"]
    assert states(found, "late") == [none] * 2 + ["clear"] * 5 + ["triggered"] + [none] * 2
    assert states(found, "quiet")[5] == "suppressed_quiet" and states(found, "loud")[5] == "triggered"
    assert states(found, "apart") == ["triggered"] * 3 + ["clear"] * 3 + [none] * 3 + ["triggered"]
    assert states(found, "cover") == ["insufficient_baseline"] * 5 + ["clear"] * 2 + ["triggered"] * 2 + ["clear"]
    assert states(found, "change") == ["insufficient_baseline"] * 3 + ["triggered", "triggered", "clear"] + [none] * 3 + ["insufficient_baseline"]
    assert set(states(found, "both")) == set(states(found, "odd")) == {"error"}
