"""Audits of written tables: which rows differ from what was recorded, and whether records and links hold together.

A table is compared by fingerprints that don't depend on the order of rows: sums of row digests over the leaves of a
part (a slice of the keys), and over parts. Only leaves whose fingerprints differ are read row by row. All functions
return one row per problem; no problem, no row. Null fields are hashed apart from empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "high", "low")
MODES = ("exclusive", "multilabel")


def record_hash(*columns: str | Column) -> Column:
    """SHA-256 of the fields' text, each with its length before it; a null is a single "-"."""

    def field(c: str | Column) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _number(digest: Column, start: int) -> Column:
    """60 bits of a digest as a number."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def with_leaf(rows: DataFrame, key: Sequence[str], leaves: int) -> DataFrame:
    return rows.withColumn("_leaf", (_number(record_hash(*key), 1) % leaves).cast("int"))


def fingerprints(rows: DataFrame, part: str, key: Sequence[str], columns: Sequence[str], leaves: int = 1024) -> DataFrame:
    """A row per part and leaf: rows and the sums of two 60-bit pieces of their digests. A doubled row counts twice, so a
    sum tells it, which an exclusive or would not. Sums are taken before the shuffle; a table's size is parts x leaves,
    so choose leaves for about 100,000 rows each."""
    digest = with_leaf(rows, key, leaves).select(F.col(part).alias("part"), "_leaf", record_hash(*columns).alias("d"))
    return digest.groupBy("part", "_leaf").agg(F.count("*").alias("n"), F.sum(_number(F.col("d"), 1)).alias("high"), F.sum(_number(F.col("d"), 16)).alias("low"))


def _unequal(before: DataFrame, now: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys whose sums differ between two tables of fingerprints, or that one of them lacks."""
    sides = before.select(*on, *SUMS, F.lit(1).alias("side")).unionByName(now.select(*on, *SUMS, F.lit(-1).alias("side")))
    rest = sides.groupBy(*on).agg(F.count("*").alias("sides"), *[F.sum(F.col(c) * F.col("side")).alias(c) for c in SUMS])
    return rest.filter("n <> 0 OR high <> 0 OR low <> 0").select(*on)


def differing_leaves(before: DataFrame, now: DataFrame) -> DataFrame:
    """(part, _leaf) that differ: roots of parts are compared first, then the leaves of those that differ."""

    def roots(leaves: DataFrame) -> DataFrame:
        return leaves.groupBy("part").agg(*[F.sum(c).alias(c) for c in SUMS])

    parts = _unequal(roots(before), roots(now), ["part"]).withColumnRenamed("part", "p")
    held = [x.join(parts, F.col("part").eqNullSafe(F.col("p")), "left_semi") for x in (before, now)]
    return _unequal(*held, ["part", "_leaf"])


def locate_differences(before: DataFrame, now: DataFrame, part: str, key: Sequence[str], columns: Sequence[str], leaves: int = 1024) -> DataFrame:
    """(part, key columns, problem) of keys whose rows are lost, added, doubled, thinned out or changed since before.

    Keys may repeat on both sides: their rows are counted and their digests summed, so a key of any size is one row after
    partial aggregation. Null keys are keys like others."""
    wanted = differing_leaves(*(fingerprints(x, part, key, columns, leaves) for x in (before, now)))
    wanted = wanted.select(F.col("part").alias("_p"), F.col("_leaf").alias("_l"))

    def read(rows: DataFrame, side: int) -> DataFrame:
        here = F.col(part).eqNullSafe(F.col("_p")) & (F.col("_leaf") == F.col("_l"))
        found = with_leaf(rows, key, leaves).join(wanted, here, "left_semi")
        digest = record_hash(*columns)
        return found.select(F.col(part).alias("part"), *key, F.lit(side).alias("_side"), _number(digest, 1).alias("_high"), _number(digest, 16).alias("_low"))

    both = read(before, 0).unionByName(read(now, 1))
    signed = F.when(F.col("_side") == 1, 1).otherwise(-1)
    sums = both.groupBy("part", *key).agg(
        F.count_if(F.col("_side") == 0).alias("_was"), F.count_if(F.col("_side") == 1).alias("_is"), *[F.sum(F.col(c) * signed).alias(c) for c in ("_high", "_low")]
    )
    problem = F.expr(
        "CASE WHEN _is = 0 THEN 'lost' WHEN _was = 0 THEN 'added' WHEN _is > _was THEN 'doubled' WHEN _is < _was THEN 'thinned' WHEN _high <> 0 OR _low <> 0 THEN 'changed' END"
    )
    return sums.withColumn("problem", problem).filter("problem IS NOT NULL").select("part", *key, "problem")


def _problems(rows: DataFrame, record: str, identity: str, tests: dict[str, Column]) -> DataFrame:
    """(record, record_id, problem) for each test that holds in a row; a test that is null counts as holding."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in tests.items()]))
    return rows.select(F.lit(record).alias("record"), F.col(identity).alias("record_id"), F.explode(found).alias("problem"))


def _repeated(rows: DataFrame, record: str, identity: str) -> DataFrame:
    """An identity that more than one record has."""
    return rows.groupBy(F.col(identity).alias("record_id")).count().filter("count > 1").select(F.lit(record).alias("record"), "record_id", F.lit("repeated").alias("problem"))


def _apart(start: str, end: str, low: str, high: str) -> Column:
    return (F.col(start) >= F.col(high)) | (F.col(end) <= F.col(low))


SLICE = ("slice_id", "run_id", "binding_key", "slice_key", "start_ts", "end_ts")
OBSERVATION = ("observation_id", "slice_id", "point_key", "site_id", "source", "metric", "start_ts", "end_ts", "value", "dims")
POINT = ("site_id", "source", "metric", "start_ts", "end_ts", "dims")


def acquisition_problems(runs: DataFrame, slices: DataFrame, observations: DataFrame) -> DataFrame:
    """Slices of runs and observations of slices that don't hold together, recomputed from their fields.

    Slices: identity, hash, run (none), binding, window (no overlap with the run's). Observations: identity, key, hash,
    slice (none), window, owner (another site or source than the run's; also where the slice has no run). Both: repeated.
    A run or slice that repeats is taken once, by its smallest fields. Observations meet slices in one equality join on
    slice_id, so a slice with very many of them is left to the adaptive split of skewed joins."""

    def once(rows: DataFrame, key: str, *fields: str) -> DataFrame:
        low = F.min(F.struct(*fields)).alias("f")
        return rows.groupBy(key).agg(low).select(key, "f.*")

    held = once(runs, "run_id", "site_id", "source", "binding_key", "window_start", "window_end").select(
        F.col("run_id").alias("r_id"), F.col("site_id").alias("r_site"), F.col("source").alias("r_source"), F.col("binding_key").alias("r_binding"), "window_start", "window_end"
    )
    of_runs = slices.select(*SLICE, "record_hash").join(held, F.col("run_id") == F.col("r_id"), "left")
    known = F.col("r_id").isNotNull()
    slice_tests = {
        "identity": F.col("slice_id") != record_hash("run_id", "binding_key", "slice_key"),
        "hash": F.col("record_hash") != record_hash(*SLICE),
        "run": ~known,
        "binding": known & (F.col("binding_key") != F.col("r_binding")),
        "window": known & _apart("start_ts", "end_ts", "window_start", "window_end"),
    }
    of_slices = once(of_runs, "slice_id", "start_ts", "end_ts", "r_site", "r_source").select(
        F.col("slice_id").alias("s_id"), F.col("start_ts").alias("s_start"), F.col("end_ts").alias("s_end"), "r_site", "r_source"
    )
    seen = observations.select(*OBSERVATION, "record_hash").join(of_slices, F.col("slice_id") == F.col("s_id"), "left")
    linked = F.col("s_id").isNotNull()
    observation_tests = {
        "identity": F.col("observation_id") != record_hash("slice_id", "point_key"),
        "key": F.col("point_key") != record_hash(*POINT),
        "hash": F.col("record_hash") != record_hash(*OBSERVATION),
        "slice": ~linked,
        "window": linked & _apart("start_ts", "end_ts", "s_start", "s_end"),
        "owner": linked & ((F.col("site_id") != F.col("r_site")) | (F.col("source") != F.col("r_source"))),
    }
    found = [
        _problems(of_runs, "slice", "slice_id", slice_tests),
        _repeated(slices, "slice", "slice_id"),
        _problems(seen, "observation", "observation_id", observation_tests),
        _repeated(observations, "observation", "observation_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def page_id(site: str | Column, route: str | Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("page-v1"), site, route), 256)


def scheme_version_id(scheme: str | Column, content: str | Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("scheme-v1"), scheme, content), 256)


def page_problems(pages: DataFrame, versions: DataFrame, activations: DataFrame, assignments: DataFrame, links: DataFrame) -> DataFrame:
    """Page ids, scheme versions, activations, assignments and index links that don't hold together.

    Pages: identity. Versions: json (not the compact form with sorted keys, or none), hash, identity, mode. Activations:
    scheme (another scheme's version, or none). Assignments: overlap (a page twice in a version that is exclusive; record_id
    is version and page joined by a blank). Links: site (another site's page, or none)."""
    json = F.col("definition_json")
    sorted_json = F.to_json(F.try_parse_json(json))  # the fields of a variant are in order
    mode = F.get_json_object(json, "$.mode")
    version_tests = {
        "json": sorted_json != json,
        "hash": F.col("definition_hash") != F.sha2(json, 256),
        "identity": F.col("version_id") != scheme_version_id("scheme_id", "definition_hash"),
        "mode": ~mode.isin(*MODES),
    }
    # versions and pages are one row an id here; the first by value where they repeat
    schemes = versions.groupBy("version_id").agg(F.min("scheme_id").alias("v_scheme"), F.min(mode).alias("mode"))
    activated = activations.select("activation_id", "scheme_id", "version_id").join(schemes, "version_id", "left")
    twice = assignments.groupBy("version_id", "page_id").count().filter("count > 1")
    overlaps = twice.join(schemes.filter("mode = 'exclusive'"), "version_id", "left_semi")
    homes = pages.groupBy("page_id").agg(F.min("site_id").alias("p_site"))
    linked = links.select("link_id", "site_id", "page_id").join(homes, "page_id", "left")
    found = [
        _problems(pages, "page", "page_id", {"identity": F.col("page_id") != page_id("site_id", "route")}),
        _problems(versions, "version", "version_id", version_tests),
        _problems(activated, "activation", "activation_id", {"scheme": F.col("scheme_id") != F.col("v_scheme")}),
        overlaps.select(F.lit("assignment").alias("record"), F.concat_ws(" ", "version_id", "page_id").alias("record_id"), F.lit("overlap").alias("problem")),
        _problems(linked, "link", "link_id", {"site": F.col("site_id") != F.col("p_site")}),
    ]
    return reduce(DataFrame.unionByName, [x.withColumn("record_id", F.col("record_id").cast("string")) for x in found])
