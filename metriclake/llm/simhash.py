"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made per document, then only different fingerprints are compared. Their 64 bits are put into
partitions of correlated bits; thresholds e_i (-1 to the whole distance) with sum(e_i) = distance - m + 1
guarantee that two fingerprints within the distance lie within e_i in some partition i, and dynamic programming
picks the cheapest by candidate counts estimated on a bounded sample. Each partition is probed with all values
within e_i, and candidates are verified. A value that many fingerprints hold would give all pairs of them, so
its fingerprints are linked through the values at half the distance instead, which is as exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import U, signed, slices
from metriclake.llm.components import with_components
from metriclake.llm.shared import row_key, written

SEED = 42
#: Fingerprints in the sample that bit groups and thresholds are chosen on; the choice never changes results.
SAMPLE = 4096
#: A partition value held or probed by more fingerprints than this is linked without forming its pairs.
CROWD = 64


def fingerprints(documents: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns (as long) and fingerprint long of each row of documents (these, text).

    A bit is set if it is set in over half of the XXH64 of the shingles, repeats included. Fewer words than
    a shingle count as one shingle; a text without words, or null, has fingerprint 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches, text=0):
            values, counts = [], []
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                w = (text or b"").lower().split()
                grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)] * bool(w)
                n = max(len(w) - shingle + 1, min(1, len(w)))
                values.append(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=U, count=n))
                counts.append(n)
            out = np.zeros(len(counts), dtype=U)
            n = np.array(counts)
            some = np.flatnonzero(n)
            if len(some):
                bits = np.unpackbits(np.concatenate(values).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                starts = (np.cumsum(n) - n)[some]
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(signed(out))], names=[*carried, "fingerprint"])

    rows = documents.select(F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in carried])
    return rows.mapInArrow(hashed, ", ".join(f"{c} long" for c in (*carried, "fingerprint")))


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal size, each grown from the bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=U)) & U(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    like = np.abs(bits.T @ bits) / np.outer(norm, norm)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [min(free)]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: like[b, group].mean())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The cheapest (cost, e_1..e_m) with e_i in -1..distance that sum to distance - m + 1; costs[i][e + 1]."""
    best = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for e in range(-1, distance + 1):
                new = cost + own[e + 1]
                if total + e not in step or new < step[total + e][0]:
                    step[total + e] = (new, [*chosen, e])
        best = step
    return best[distance - len(costs) + 1]


def partition(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest partitioning of n fingerprints like the sample."""
    found = []
    for parts in range(2, distance + 3):
        groups = bit_groups(sample, parts)
        costs = []
        for group in groups:
            mask = U(sum(1 << b for b in group))
            some = sample[: min(len(sample), 1024)] & mask
            apart = np.bitwise_count(some[:, None] ^ (sample & mask)[None, :])
            own = [0.0]
            for e in range(distance + 1):
                probes = sum(len(list(combinations(range(len(group)), k))) if k else 1 for k in range(e + 1))
                near = max(0.0, float((apart <= e).mean()) - 1 / max(1, len(sample)))
                own.append(n * probes + n * n * near)
            costs.append(own)
        cost, chosen = thresholds(costs, distance)
        found.append((cost, [(g, e) for g, e in zip(groups, chosen, strict=True) if e >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _flips(group: list[int], most: int) -> list[int]:
    """Masks that change up to `most` of the bits."""
    return [_long(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(group, k)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """prints (fingerprint, each once) -> links (a, b) that connect exactly what lies within the distance.

    Two fingerprints within the distance are linked, or each is linked to a third through which both are
    connected by steps within the distance.
    """
    spark = prints.sparkSession
    rows = prints.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).collect()
    sample = np.array([r[0] for r in rows], dtype=np.int64).view(U)
    if len(sample) < 2:
        return spark.createDataFrame([], "a long, b long")
    chosen = partition(sample, prints.count(), distance)
    held = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(_long(sum(1 << b for b in g)))).alias("value")) for i, (g, _) in enumerate(chosen)]))
    keys = prints.select("fingerprint", held.alias("k")).select("fingerprint", "k.part", "k.value")
    masks = spark.createDataFrame([(i, [int(m) for m in _flips(g, e)]) for i, (g, e) in enumerate(chosen)], "part int, masks array<long>")
    probes = keys.join(F.broadcast(masks), "part").select("fingerprint", "part", F.explode("masks").alias("mask"), "value")
    probes = probes.select("fingerprint", "part", F.expr("value ^ mask").alias("value"))
    exact = all(e == 0 for _, e in chosen)
    seen = (keys if exact else probes).groupBy("part", "value").agg(F.count("*").alias("n"))
    crowded = written(seen.filter(F.col("n") > CROWD).select("part", "value"), "crowds")
    calm_keys = keys.join(crowded, ["part", "value"], "left_anti")
    calm_probes = (keys if exact else probes).withColumnRenamed("fingerprint", "other").join(crowded, ["part", "value"], "left_anti")
    pairs = calm_keys.join(calm_probes, ["part", "value"]).filter(F.col("fingerprint") < F.col("other") if exact else F.col("fingerprint") != F.col("other"))
    pairs = pairs.filter(F.bit_count(F.expr("fingerprint ^ other")) <= distance).select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
    crowd = (keys if exact else probes).join(crowded, ["part", "value"], "left_semi").select("fingerprint").distinct()
    return pairs.unionByName(_through_middles(crowd, distance))


def _through_middles(prints: DataFrame, distance: int) -> DataFrame:
    """Links by shared values at half the distance: a value has a bounded number of fingerprints near it.

    For an even distance 2h, two fingerprints within it share a value within h of each; whoever shares one
    is within the distance. For an odd one, the value is within h of one and h + 1 of the other; then what
    shares a value is verified against the smallest that is nearest to it.
    """
    half = distance // 2
    masks = _flips(list(range(64)), half + distance % 2)
    near = prints.select("fingerprint", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    near = near.select("fingerprint", F.expr("fingerprint ^ mask").alias("middle"), F.bit_count("mask").alias("far"))
    if distance % 2:  # pairs with one end at half: the nearest are few (at most 1 + 64 for half = 1)
        inner = near.filter(F.col("far") <= half).select(F.col("fingerprint").alias("a"), "middle")
        return inner.join(near.select(F.col("fingerprint").alias("b"), "middle"), "middle").filter("a != b").select("a", "b")
    groups = near.groupBy("middle").agg(F.collect_set("fingerprint").alias("all")).filter(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a != b")


def near_duplicates(documents: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of documents (doc_id, text).

    component_id is the smallest doc_id reachable by links of at most `distance` differing bits; nulls in
    doc_id are ignored for it unless the component has no other. Rows that are repeated come out repeated.
    Other columns are not read.
    """
    prints = written(fingerprints(documents, shingle), "fingerprints")
    each = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    each = written(each, "prints")
    joined = written(with_components(each, links(each.select("fingerprint"), distance), "fingerprint"), "components")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "component").select("fingerprint", "component_id")
    out = prints.join(of, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def row_groups(documents: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """_k1, _k2, group of each row of documents (doc_id, text, and these keys): rows of one group are near-duplicates, that is, their
    fingerprints are connected by links of at most `distance` differing bits."""
    prints = written(fingerprints(documents.select("doc_id", "text", "_k1", "_k2"), shingle, ("doc_id", "_k1", "_k2")), "fingerprints")
    each = prints.select("fingerprint").distinct()
    joined = with_components(each, links(each, distance), "fingerprint")
    return prints.join(joined, "fingerprint").select("_k1", "_k2", F.col("component").alias("group"))


def one_of_each(documents: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """documents with one row of each group of near-duplicates: that of the smallest doc_id (a null counts
    as largest; then by a hash of the row). All columns stay; of rows with one doc_id and text one stays."""
    keyed = row_key(documents)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").cast("long").alias("doc_id"), "_k1", "_k2")
    rows = keyed.select("doc_id", "_k1", "_k2").join(row_groups(keyed, distance, shingle), ["_k1", "_k2"])
    keep = rows.groupBy("group").agg(F.min(order).alias("least")).select("least._k1", "least._k2")
    return keyed.join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
