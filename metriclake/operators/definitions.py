"""Versions of definitions that name other versions: what they reach, and which of it is missing or of another type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.sources.shared import materialised

# Which fields of a definition's JSON name versions of which type.
NAMES = (
    ("goal", "goal_version_ids", "goal"),
    ("alert_rule", "goal_version_id", "goal"),
    ("alert_rule", "segment_version_id", "segment"),
    ("report_subscription", "goal_version_ids", "goal"),
    ("report_subscription", "segment_version_id", "segment"),
)
CONTENT = "goal_version_ids array<string>, goal_version_id string, segment_version_id string"


def references(versions: DataFrame) -> DataFrame:
    """versions (version_id, definition_type, content_json) -> version_id, reference_id, expected: each version that the JSON
    names, once. Broken JSON and null fields name none."""
    read = versions.select("version_id", "definition_type", F.from_json("content_json", CONTENT).alias("c"))
    each = []
    for kind, field, expected in NAMES:
        named = F.col(f"c.{field}") if field.endswith("ids") else F.array(f"c.{field}")
        each.append(F.when(F.col("definition_type") == kind, F.arrays_zip(named.alias("id"), F.array_repeat(F.lit(expected), F.size(named)).alias("expected"))))
    none = F.array().cast("array<struct<id:string,expected:string>>")
    every = F.explode(F.array_distinct(reduce(F.concat, [F.coalesce(e.cast("array<struct<id:string,expected:string>>"), none) for e in each])))
    return read.select("version_id", every.alias("r")).filter("r.id IS NOT NULL").select("version_id", F.col("r.id").alias("reference_id"), F.col("r.expected").alias("expected"))


def closure(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> all different (a, b) with a path from a to b; (a, a) tells that a is on a cycle.

    Paths double: what a round found new is joined with all paths so far, so a chain of n edges takes log2 n rounds. Each
    round's pairs are written, and only new ones go on; rounds end when there are none.
    """
    edges = edges.select("a", "b").na.drop().distinct()
    new = paths = materialised(edges)
    while True:
        longer = new.select("a", F.col("b").alias("_via")).join(paths.select(F.col("a").alias("_via"), "b"), "_via").select("a", "b").distinct()
        new = materialised(longer.join(paths, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return paths
        paths = materialised(paths.unionByName(new))


def broken_references(versions: DataFrame) -> DataFrame:
    """root_id, version_id, reference_id, expected, found, problem, in_cycle: each broken reference that each version reaches.

    problem is `missing` if no such version exists (found is null), else `type`. version_id is the one that names it: the root
    or a version that the root reaches over whole references. in_cycle: the root reaches itself. A version that is listed twice
    counts once; if its types differ, the smallest holds.
    """
    known = versions.groupBy("version_id").agg(F.min("definition_type").alias("found"))
    named = materialised(references(versions).distinct().join(known.withColumnRenamed("version_id", "reference_id"), "reference_id", "left"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("expected"), "type")
    broken = named.withColumn("problem", problem).filter("problem IS NOT NULL")
    whole = named.filter("found = expected").select(F.col("version_id").alias("a"), F.col("reference_id").alias("b"))
    paths = closure(whole)
    itself = known.select(F.col("version_id").alias("root_id"), "version_id")
    reached = paths.filter("a <> b").select(F.col("a").alias("root_id"), F.col("b").alias("version_id")).unionByName(itself)
    cycles = paths.filter("a = b").select(F.col("a").alias("root_id"), F.lit(True).alias("_cycle"))
    found = reached.join(broken, "version_id").join(cycles, "root_id", "left").withColumn("in_cycle", F.coalesce("_cycle", F.lit(False)))
    return found.select("root_id", "version_id", "reference_id", "expected", "found", "problem", "in_cycle")
