"""Near copies by an exact join of shingle sets: Jaccard similarity of five-word shingles of 0.8 or more.

Documents of one set are taken together first. Sets are ordered by how common their shingles are (counted in
hashed buckets; any order gives the same result), and two sets that are similar enough share a shingle among
the rarest fifth of each (prefix filter). The holders of a shingle are not paired with each other at once: all
are compared with one of them, and what that connects counts as one. Only holders that are still apart from the
largest component of the shingle's holders are then compared with the others, so every pair is either compared
or already connected. Pairs are compared first by parity bitmaps, whose distance never exceeds that of the sets,
then by the sets of their whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.llm.arrays import LOWER, U, give_back, mix, signed, slices, utf8, window_hashes, word_hashes, words
from metriclake.llm.components import with_components
from metriclake.llm.shared import row_key, shuffle_partitions, written

SHINGLE = 5
#: Buckets in which shingles are counted for their order; the order never changes results.
BUCKETS = 1 << 18
#: Parts in which the counts are summed, each by one task.
COUNTED = 256
#: Shortest and longest parity bitmap, in bits.
SMALL, BITMAP = 512, 1 << 16


def shingle_sets(texts: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different shingles of each text, offsets), by weight of their bucket, then hash.

    Case (A-Z) is folded. Fewer words than a shingle are one shingle; a text without words has none.
    """
    data, offsets = utf8(texts)
    data = LOWER[data]
    start, end, first = words(data, offsets)
    codes = word_hashes(data, start, end)
    count = np.diff(first)
    n = np.maximum(count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    hashes = mix(window_hashes(np.concatenate([codes, np.zeros(SHINGLE - 1, U)]), SHINGLE)[begin])
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():  # one shingle of fewer words
        own = codes[first[i] : first[i + 1]]
        hashes[np.searchsorted(doc, i)] = mix(window_hashes(own, len(own)) + U(len(own)))[0]
    order = np.lexsort((hashes, doc) if weights is None else (hashes, weights[bucket(hashes)], doc))
    hashes = hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of texts (text) fall in each bucket."""

    size = BUCKETS // COUNTED

    def rows(parts: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([np.minimum(t, 0xFFFFFFFF).astype("<u4").tobytes() for t in totals], pa.binary())], names=["part", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches, text=0):
            total += np.bincount(bucket(shingle_sets(batch.column(0))[0]), minlength=BUCKETS)
        yield rows(np.arange(COUNTED), total.reshape(COUNTED, size))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, dtype="<u4").astype(np.int64)
        yield rows(np.array(list(total), dtype=np.int32), np.array(list(total.values())))

    schema = "part int, counts binary"
    found = texts.mapInArrow(counted, schema).repartition("part").mapInArrow(summed, schema).collect()  # BUCKETS counts in all
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], dtype="<u4")
    return out


def bitmaps(hashes: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Per set a bitmap of at least as many bits as it has shingles (a power of two, up to BITMAP): the parity of
    the shingles that fall on each bit. Halves of a bitmap joined by XOR are the bitmap of half the bits."""
    n = np.diff(offsets)
    bits = np.minimum(1 << np.ceil(np.log2(np.maximum(n, SMALL))).astype(np.int64), BITMAP)
    base = np.concatenate(([0], np.cumsum(bits)))
    at = (mix(hashes) & np.repeat(bits - 1, n).astype(U)).astype(np.int64) + np.repeat(base[:-1], n)
    parity = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(base // 64, pa.int32()), pa.array(np.packbits(parity, bitorder="little").view("<i8")))


PRINTS = "k1 long, k2 long, doc_id long, s1 long, s2 long, n long, prefix array<long>, bits array<long>"


def prefixes(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """k1, k2, doc_id, two hashes of the set, n (its shingles), prefix and bitmap of rows (text, k1, k2, doc_id)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0):
            hashes, offsets = shingle_sets(batch.column(0), weights)
            n = np.diff(offsets)
            ids = []
            for seed in (0, 1):
                sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ U(seed * 0x5851F42D4C957F2D)), dtype=U)))
                ids.append(pa.array(signed(mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(U)))))
            most = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            at = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))), pa.int32()), pa.array(signed(hashes[at < np.repeat(most, n)])))
            out = [batch.column(1), batch.column(2), batch.column(3), *ids, pa.array(n, pa.int64()), lists, bitmaps(hashes, offsets)]
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in PRINTS.split(", ")])
        give_back()

    return rows.select("text", "k1", "k2", "doc_id").mapInArrow(found, PRINTS)


def possible(n_x: np.ndarray, at_x: np.ndarray, n_y: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Whether sets can be similar if this is their first common shingle: what is left is enough, and what stands
    before it in either is not too much."""
    return (9 * np.minimum(n_x - at_x, n_y - at_y) >= 4 * (n_x + n_y)) & (9 * (at_x + at_y) <= n_x + n_y)


def holders(sets: DataFrame) -> DataFrame:
    """token, sid, n, pos, lead, near, border: the sets that hold a shingle of their prefix with others.

    Shingles are range-partitioned with their sets, so that one that many sets hold takes several tasks; of each
    task's sets with a shingle, one in which it stands first is the lead there (what is rarer comes of edits, so that is
    a set in the middle of its near copies), and near tells whether the lead can be similar. border
    marks the leads of a task's first and last shingle, whose other holders may be in the tasks beside it.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = lead_row = None  # token, and the lead's sid, n and pos; a lead is shown with the second holder
        shown, first = True, None

        def out(token, sid, n, pos, of, near, border):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((token, sid, n, pos, of, near, border), kinds, strict=True)], names=["token", "sid", "n", "pos", "lead", "near", "border"])

        for batch in batches:
            if not batch.num_rows:
                continue
            token, at, sid = (batch.column(i).to_numpy() for i in range(3))
            n, pos = at & 0xFFFFFFFF, at >> 32
            if first is None:
                first = int(token[0])
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = token[0] != lead
            start = np.flatnonzero(new)
            of = np.cumsum(new) - 1  # -1: the lead is from the batch before
            if len(start):
                leads = [np.append(x[start], r) for x, r in zip((sid, n, pos), lead_row or (0, 0, 0), strict=True)]
            else:
                leads = [np.array([r]) for r in lead_row]
            mine = np.flatnonzero(~new)
            if lead is not None and not shown and (len(mine) and of[mine[0]] == -1):
                yield out([lead], [lead_row[0]], [lead_row[1]], [lead_row[2]], [lead_row[0]], [False], [lead == first])
                shown = True
            if lead is not None and not shown and len(start) and lead == first:
                yield out([lead], [lead_row[0]], [lead_row[1]], [lead_row[2]], [lead_row[0]], [False], [True])
            multiple = np.unique(of[mine])
            multiple = multiple[multiple >= 0]
            show = start[multiple]
            rows = np.sort(np.concatenate([show, mine]))
            if len(rows):
                who = of[rows]
                is_lead = new[rows]
                near = possible(n[rows], pos[rows], leads[1][who], leads[2][who]) & ~is_lead
                yield out(token[rows], sid[rows], n[rows], pos[rows], leads[0][who], near, is_lead & (token[rows] == first))
            if len(start):
                last = start[-1]
                lead, lead_row = int(token[last]), (int(sid[last]), int(n[last]), int(pos[last]))
                shown = bool(len(multiple)) and multiple[-1] == len(start) - 1
                if len(start) > 1 and first == int(token[start[0]]) and not (len(multiple) and multiple[0] == 0) and new[0]:
                    a = start[0]
                    yield out([token[a]], [sid[a]], [n[a]], [pos[a]], [sid[a]], [False], [True])
        if lead is not None and not (shown and lead == first):
            yield out([lead], [lead_row[0]], [lead_row[1]], [lead_row[2]], [lead_row[0]], [False], [True])

    tokens = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", F.expr("(CAST(pos AS long) << 32) | n").alias("at"), "sid")
    dealt = tokens.repartitionByRange(2 * shuffle_partitions(sets.sparkSession), "token", "at", "sid").sortWithinPartitions("token", "at", "sid")
    return dealt.mapInArrow(held, "token long, sid long, n int, pos int, lead long, near boolean, border boolean")


def similar(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets (sid, k1, k2, n, bits) that have a Jaccard similarity of 0.8 or more; rows (k1, k2, text)
    has their texts. Only texts of pairs whose bitmaps are near enough are read into sets."""
    of = sets.select("sid", "n", "bits")
    both = pairs.join(of.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(of.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")

    def halved(x: str) -> Column:
        return F.expr(f"zip_with(slice({x}, 1, size({x}) DIV 2), slice({x}, 1 + size({x}) DIV 2, size({x}) DIV 2), (x, y) -> x ^ y)")

    one = F.when(F.expr("size(bits_a) > size(bits_b)"), halved("bits_a")).otherwise(F.col("bits_a"))
    two = F.when(F.expr("size(bits_b) > size(bits_a)"), halved("bits_b")).otherwise(F.col("bits_b"))
    both = both.filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", one.alias("x"), two.alias("y"))
    close = written(both.filter("9 * aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0L, (s, v) -> s + v) <= n_a + n_b").select("a", "b"), "close")
    asked = close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = written(rows.join(sets.select("sid", "k1", "k2").join(asked, "sid", "left_semi"), ["k1", "k2"]).select("sid", "text"), "asked")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=2, limit=1 << 19):
            (x, at_x), (y, at_y) = (shingle_sets(batch.column(i)) for i in (2, 3))
            same = np.array([len(np.intersect1d(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]], assume_unique=True)) for i in range(batch.num_rows)])
            yield batch.select([0, 1]).filter(pa.array(9 * same >= 4 * (np.diff(at_x) + np.diff(at_y))))
        give_back()

    ready = close.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    return ready.select("a", "b", "text_a", "text_b").mapInArrow(judged, "a long, b long")


def links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """sets (sid, k1, k2, n, prefix, bits; one row a set), rows (k1, k2, text) -> links (a, b) that connect exactly the similar sets."""
    members = written(holders(sets), "members")
    stars = members.filter("near").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    borders = members.filter("border").select("token", "sid").distinct()  # a few rows a task
    least = borders.withColumn("a", F.min("sid").over(Window.partitionBy("token"))).filter("a != sid").select("a", F.col("sid").alias("b"))
    stars = written(stars.unionByName(least).distinct(), "stars")
    found = written(similar(stars, sets, rows), "links")
    others = written(with_components(members.select("token", "sid", "n", "pos").distinct(), found.select("a", "b"), "sid"), "others")
    sizes = others.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most")).filter("parts > 1")
    words = SMALL // 64
    folded = [F.expr(f"aggregate(sequence({i}, size(bits) - 1, {words}), 0L, (s, k) -> s ^ bits[k])").alias(f"b{i}") for i in range(words)]
    split = others.join(largest.select("token", F.col("most.component").alias("main")), "token")
    split = written(split.join(sets.select("sid", *folded), "sid"), "split")
    x, y = split.filter("component != main").alias("x"), split.alias("y")
    near = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(words))
    likely = f"x.component != y.component AND 9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n) AND 9 * (x.pos + y.pos) <= x.n + y.n AND 9 * ({near}) <= x.n + y.n"
    apart = x.join(y, F.expr(f"x.token = y.token AND {likely}")).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
    rest = written(apart.join(stars, ["a", "b"], "left_anti"), "rest")
    return found.unionByName(similar(rest, sets, rows))


def one_of_each(documents: DataFrame, groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """documents with one row of each group connected by similar sets: that of the smallest doc_id (a null
    counts as largest; then by a hash of the row). Texts without words are one group. All columns stay; of rows
    with one doc_id and text one stays. groups gives (_k1, _k2, group) of documents with row keys: what another method has found to
    belong together is connected too, and this join adds what it missed."""
    keyed = row_key(documents)
    rows = keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")
    prints = written(prefixes(rows, bucket_counts(rows.select("text"))), "prefixes")
    each = prints.groupBy("s1", "s2").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    sets = written(each.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "least", "least.k1", "least.k2", "n", "prefix", "bits"), "sets")
    found = links(sets, rows.select("k1", "k2", "text"))
    if groups is not None:
        of = prints.select("k1", "k2", "s1", "s2").join(sets.select("s1", "s2", "sid"), ["s1", "s2"])
        grouped = written(of.join(groups(keyed).withColumnsRenamed({"_k1": "k1", "_k2": "k2"}), ["k1", "k2"]).select("group", "sid").distinct(), "grouped")
        firsts = grouped.groupBy("group").agg(F.min("sid").alias("a"))
        found = found.unionByName(grouped.join(firsts, "group").filter("a != sid").select("a", F.col("sid").alias("b")))
    joined = with_components(sets.select("sid", "least"), found, "sid")
    keep = joined.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.k1").alias("_k1"), F.col("least.k2").alias("_k2"))
    return keyed.join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
