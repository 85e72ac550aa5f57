"""Audits on rows made by hand and against plain counting."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from metriclake.operators import audits

ROWS = "site string, id long, value string, extra int"


def differences(spark, before, now, leaves=8):
    frames = [spark.createDataFrame(x, ROWS) for x in (before, now)]
    found = audits.locate_differences(*frames, "site", ["id"], ["site", "id", "value"], leaves).collect()
    assert len(found) == len({(r.part, r.id) for r in found})
    return {(r.part, r.id): r.problem for r in found}


def plainly(before, now):
    sides = [defaultdict(Counter), defaultdict(Counter)]
    for side, rows in zip(sides, (before, now), strict=True):
        for site, identity, value, _ in rows:
            side[site, identity][value] += 1
    out = {}
    for k in {*sides[0], *sides[1]}:
        was, now_ = (s[k].total() for s in sides)
        word = "lost" if not now_ else "added" if not was else "doubled" if now_ > was else "thinned" if now_ < was else "changed" if sides[0][k] != sides[1][k] else None
        if word:
            out[k] = word
    return out


def test_differences_equal_plain_counting(spark):
    chance = random.Random(5)
    before = [(chance.choice(["a", "b", "c", "", None]), chance.choice([None, *range(150)]), chance.choice(["", None, "x", "y"]), i) for i in range(400)]
    now = [(s, i, chance.choice(["z", "", None]) if chance.random() < 0.1 else v, -1) for s, i, v, _ in before if chance.random() > 0.05]
    now += [chance.choice(now) for _ in range(10)] + [("new", 1, "x", 0)]
    chance.shuffle(now)
    want = plainly(before, now)
    assert {*want.values()} == {"lost", "added", "doubled", "thinned", "changed"}
    for leaves in (1, 8, 1024):
        assert differences(spark, before, now, leaves) == want
    assert differences(spark, before, before[::-1]) == {} == differences(spark, [], [])
    assert {*differences(spark, before, []).values()} == {"lost"}


def test_null_is_not_empty_and_swaps_are_seen(spark):
    assert differences(spark, [("a", 1, "", 0)], [("a", 1, None, 0)]) == {("a", 1): "changed"}
    assert differences(spark, [("a", 1, "x", 0), ("a", 2, "y", 0)], [("a", 1, "y", 0), ("a", 2, "x", 0)]) == {("a", 1): "changed", ("a", 2): "changed"}


def test_only_leaves_that_differ_are_read(spark):
    rows = spark.range(2000).select((F.col("id") % 4).cast("string").alias("site"), "id", F.lit("v").alias("value"))
    now = rows.withColumn("value", F.when(F.col("id") == 77, "w").otherwise(F.col("value")))
    prints = [audits.fingerprints(x, "site", ["id"], ["id", "value"], 16) for x in (rows, now)]
    assert prints[0].count() == 64
    assert [r.part for r in audits.differing_leaves(*prints).collect()] == ["1"]


def recorded(spark, runs, slices, observations):
    made = spark.createDataFrame(slices, "run_id string, binding_key string, slice_key string, start_ts int, end_ts int").withColumn("slice_id", audits.record_hash("run_id", "binding_key", "slice_key"))
    made = made.withColumn("record_hash", audits.record_hash(*audits.SLICE))
    keys = made.select("slice_key", "slice_id")
    seen = spark.createDataFrame(observations, "slice_key string, site_id string, source string, metric string, start_ts int, end_ts int, value string, dims string").join(keys, "slice_key", "left")
    seen = seen.withColumn("slice_id", F.coalesce("slice_id", F.lit("none"))).withColumn("point_key", audits.record_hash(*audits.POINT)).withColumn("observation_id", audits.record_hash("slice_id", "point_key"))
    seen = seen.withColumn("record_hash", audits.record_hash(*audits.OBSERVATION))
    return spark.createDataFrame(runs, "run_id string, site_id string, source string, binding_key string, window_start int, window_end int"), made, seen


def found(df):
    return Counter((r.record, r.problem) for r in df.collect())


def test_acquisition(spark):
    runs = [("r1", "a", "web", "b1", 0, 10), ("r2", "b", "web", "b2", 0, 10)]
    good = [("r1", "b1", "k1", 0, 10), ("r2", "b2", "k2", 9, 30)]
    seen = [("k1", "a", "web", "m", 0, 1, "3", None), ("k2", "b", "web", "m", 29, 30, "", "{}")]
    assert found(audits.acquisition_problems(*recorded(spark, runs, good, seen))) == {}
    assert found(audits.acquisition_problems(*recorded(spark, [], [], []))) == {}
    bad = [*good, ("r1", "b2", "k3", 3, 4), ("r2", "b2", "k4", 10, 12), ("r9", "b1", "k5", 0, 1)]
    more = [*seen, ("k1", "b", "web", "m", 0, 1, "3", None), ("k1", "a", "web", "m", 10, 11, "3", None), ("zz", "a", "web", "m", 0, 1, "3", None), ("k1", "a", "web", "m", 0, 1, "3", None), ("k5", "a", "web", "m", 0, 1, "1", None)]
    want = {("slice", "binding"): 1, ("slice", "window"): 1, ("slice", "run"): 1, ("observation", "owner"): 2, ("observation", "window"): 1, ("observation", "slice"): 1, ("observation", "repeated"): 1}
    tables = recorded(spark, runs, bad, more)
    assert found(audits.acquisition_problems(*tables)) == want
    runs_, slices, observations = tables
    changed = observations.withColumn("value", F.lit("4"))
    assert found(audits.acquisition_problems(runs_, slices, changed))["observation", "hash"] == len(more)
    nulls = slices.withColumn("record_hash", F.lit(None).cast("string")).withColumn("extra", F.lit(1))
    assert found(audits.acquisition_problems(runs_, nulls, observations))["slice", "hash"] == len(bad)


def test_pages(spark):
    pages = spark.createDataFrame([("a", "/"), ("b", "/x")], "site_id string, route string").withColumn("page_id", audits.page_id("site_id", "route"))
    texts = [("s", '{"mode":"exclusive","rules":[{"a":1,"b":"é"}]}'), ("s", '{"mode":"multilabel"}'), ("t", '{"mode":"other"}'), ("t", '{"rules":1,"mode":"exclusive"}'), ("t", "{broken"), ("t", None)]
    versions = spark.createDataFrame(texts, "scheme_id string, definition_json string").withColumn("definition_hash", F.sha2("definition_json", 256)).withColumn("version_id", audits.scheme_version_id("scheme_id", "definition_hash"))
    ids = {r.definition_json: r.version_id for r in versions.collect()}
    exclusive, many = ids[texts[0][1]], ids[texts[1][1]]
    activations = spark.createDataFrame([("1", "s", exclusive), ("2", "t", exclusive), ("3", "s", "none")], "activation_id string, scheme_id string, version_id string")
    assignments = spark.createDataFrame([(v, p, c) for v in (exclusive, many, "none") for p in ("p", "q") for c in ("x", "y")[: 1 + (p == "p")]], "version_id string, page_id string, cluster string")
    links = pages.select(F.concat(F.lit("l"), "site_id").alias("link_id"), F.lit("a").alias("site_id"), "page_id")
    got = found(audits.page_problems(pages, versions, activations, assignments, links))
    want = {("version", "json"): 3, ("version", "mode"): 3, ("version", "hash"): 1, ("activation", "scheme"): 2, ("assignment", "overlap"): 1, ("link", "site"): 1}
    assert got == want
    wrong = pages.withColumn("page_id", F.sha2("page_id", 256))
    assert found(audits.page_problems(wrong, versions.limit(0), activations.limit(0), assignments.limit(0), links.limit(0))) == {("page", "identity"): 2}
