"""Link graphs as DataFrames of edges (src, dst, layer). Iterations write what they carry on, so plans stay short."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.sources import shared
from metriclake.sources.shared import dealt, materialised, new_path, parts_of

LAYERS = ("menu", "breadcrumb", "contextual", "related", "action", "utility")
SHELL = ("menu", "utility")


def build_graph(links: DataFrame, layers: tuple[str, ...] | None = None, rows: int = 0) -> DataFrame:
    """Different edges (src, dst) of the layers, all by default, without links to themselves. rows: as many as there are links, or more, where
    that is known."""
    some = links if layers is None else links.filter(F.col("layer").isin(*layers))
    return dealt(some.filter("src <> dst").select("src", "dst"), rows, "src", "dst").distinct()


def nodes_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").na.fill(0, ["out_degree", "in_degree"])


def distances(edges: DataFrame, roots: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, distance) of all nodes that a breadth-first search from the roots reaches, in steps.

    Each level is written once, as a part of one table.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    edges = materialised(edges.select(F.col(a).alias("node"), F.col(b).alias("next")))
    spark, folder = edges.sparkSession, new_path(edges.sparkSession)
    frontier, level = roots.select("node").distinct().withColumn("distance", F.lit(0)), 0
    kind = frontier.schema
    while True:
        frontier.write.parquet(f"{folder}/{level}")
        frontier = spark.read.schema(kind).parquet(f"{folder}/{level}")
        seen = spark.read.schema(kind).parquet(*[f"{folder}/{k}" for k in range(level + 1)])
        if frontier.isEmpty():
            return seen
        level += 1
        new = frontier.join(edges, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = new.withColumn("distance", F.lit(level))


def goal_distance(nodes: DataFrame, edges: DataFrame, goals: DataFrame) -> DataFrame:
    """Steps from each node to the nearest goal, -1 where none is reached."""
    return nodes.join(distances(edges, goals, reverse=True), "node", "left").na.fill(-1, ["distance"])


#: Links of one node that are kept together; a node with more is split.
HUB = 1_000_000


def node_ranges(nodes: DataFrame, buckets: int) -> DataFrame:
    """node, range: the nodes in as many ranges of their order as there are buckets; each range's number falls in a bucket of its own."""
    numbers = nodes.sparkSession.range(64 * buckets).select(F.col("id").cast("int").alias("range")).groupBy(F.pmod(F.hash("range"), F.lit(buckets)).alias("bucket")).agg(F.min("range").alias("range"))
    return nodes.repartitionByRange(buckets, "node").select("node", F.spark_partition_id().alias("bucket")).join(F.broadcast(numbers), "bucket").select("node", "range")


def range_of(node: str, buckets: int) -> Column:
    """The range in which a part of a node's links is kept: the first in the node's, the others of a hub in any."""
    return F.when(F.col("part") == 0, F.col("range")).otherwise(F.pmod(F.xxhash64(node, "part"), F.lit(buckets)).cast("int")).alias("range")


def bucketed(df: DataFrame, name: str, by: tuple[str, ...], order: tuple[str, ...], buckets: int) -> DataFrame:
    """df as a table in buckets."""
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*order).option("path", new_path(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_links(edges: DataFrame, name: str, ranges: DataFrame | None = None, buckets: int | None = None, rows: int = 0) -> DataFrame:
    """src, part, dst, degree as a table in buckets of (src, part), or, with range and the range of dst (to), in buckets of the ranges of nodes
    (node, range), so that rounds of joins by these shuffle no link. A node with more than HUB links has several parts. rows: the number of
    edges, where that is known."""
    buckets = buckets or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    if ranges is not None:
        out = out.join(ranges.withColumnRenamed("node", "src"), "src")
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / HUB)).cast("int")
    links = dealt(edges, rows, "src").join(out, "src").withColumn("part", part)
    if ranges is None:
        return bucketed(links.select("src", "part", "dst", "degree"), name, ("src", "part"), ("src", "part"), buckets)
    links = links.select(range_of("src", buckets), "src", "part", "dst", "degree")
    links = dealt(links, rows, "dst").join(ranges.select(F.col("node").alias("dst"), F.col("range").alias("to")), "dst")
    return bucketed(links, name, ("range",), ("range", "src"), buckets)


def authority(nodes: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, write_every: int = 5) -> DataFrame:
    """(node, score) by rounds of shares along the edges; nodes without any share with all. Scores sum to one. Edges are read several times.

    Nodes and the links that leave them are put in buckets by the range of the node once; no round shuffles one, or a score. A round shuffles, from
    each bucket to the buckets of the nodes that its links lead to, one row a node: as links mostly lead to near nodes (of one site, of one batch
    of ids), that is few more rows than nodes; never more than links. A hub's links have parts in other buckets too, which get its score by
    a broadcast: of one row for each HUB links at most.
    """
    spark, stamp = nodes.sparkSession, uuid.uuid4().hex
    nodes = materialised(nodes.select("node"))
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    n_links = edges.count()
    buckets = parts_of(spark, n_links // 4)  # a round reads a bucket's links as they come and holds its nodes only
    ranges = materialised(node_ranges(nodes, buckets))
    links = bucketed_links(edges, f"links_{stamp}", ranges, buckets, n_links)
    parts = links.groupBy(F.col("src").alias("node")).agg((F.max("part") + 1).alias("parts"))
    nodes = bucketed(ranges.join(parts, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(0))), f"nodes_{stamp}", ("range",), ("range", "node"), buckets)
    hubs = not nodes.filter("parts > 1").isEmpty()
    score = nodes.withColumn("score", F.lit(1.0 / n))
    together = "spark.sql.requireAllClusterKeysForCoPartition"  # joins by range and node are dealt by the range alone
    before = spark.conf.get(together)
    spark.conf.set(together, "false")

    def sums(shares: DataFrame) -> DataFrame:
        return shares.groupBy("range", "to", "dst").agg(F.sum(F.col("score") / F.col("degree")).alias("got"))

    try:
        for k in range(1, rounds + 1):
            lost = score.agg(F.coalesce(F.sum(F.when(F.col("parts") == 0, F.col("score"))), F.lit(0.0))).scalar()
            own = score.filter("parts > 0").select("range", F.col("node").alias("src"), "score")
            given = sums(links.filter("part = 0").join(own.hint("shuffle_hash"), ["range", "src"]))
            if hubs:
                far = F.broadcast(score.filter("parts > 1").select(F.col("node").alias("src"), "score"))
                given = given.unionByName(sums(links.filter("part > 0").join(far, "src")))
            got = given.select(F.col("to").alias("range"), F.col("dst").alias("node"), "got").repartition(buckets, "range")
            got = got.groupBy("range", "node").agg(F.sum("got").alias("got"))
            new = nodes.join(got.hint("shuffle_hash"), ["range", "node"], "left").withColumn("lost", lost)
            score = new.select("node", "range", "parts", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
            if k % write_every == 0 or k == rounds:
                score = materialised(score)
    finally:
        spark.conf.set(together, before)
    for name in ("links", "nodes"):
        spark.sql(f"DROP TABLE {name}_{stamp}")
    return score.select("node", "score")


def weak_components(nodes: DataFrame, edges: DataFrame, report: list[int] | None = None) -> DataFrame:
    """(node, component): the smallest node that is connected, by contraction.

    In each round every node is merged into that of its neighbours, or itself, which has the least random number of the round; links go on between
    what is left, without loops and repeats. So nodes fall to half or less in a round (as expected), links with them, and a path of n
    nodes takes about log2 n rounds. report gets the number of links of each round. Merges are written by round and
    followed back from the last to the first, over tables that double.
    """
    links = materialised(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    merges: list[DataFrame] = []
    while n := links.count():
        if report is not None:
            report.append(n)
        chance = F.xxhash64(F.lit(len(merges)), "node")
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = F.min(F.struct(F.xxhash64(F.lit(len(merges)), "other").alias("chance"), F.col("other").alias("node")))
        merged = both.groupBy("node").agg(near.alias("near")).select("node", F.least("near", F.struct(chance.alias("chance"), "node"))["node"].alias("into"))
        merged = materialised(merged)
        merges.append(merged)
        ends = links.join(merged.select(F.col("node").alias("a"), F.col("into").alias("x")), "a").join(merged.select(F.col("node").alias("b"), F.col("into").alias("y")), "b")
        links = materialised(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = nodes.select("node", F.col("node").alias("root"))
    if merges:
        found = merges[-1].withColumnRenamed("into", "root")
        for merged in reversed(merges[:-1]):  # where what a node went into went on, else itself
            onward = found.select(F.col("node").alias("into"), "root")
            found = materialised(merged.join(onward, "into", "left").select("node", F.coalesce("root", "into").alias("root")))
        roots = materialised(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components by their smallest node.

    Rounds of colouring: nodes with no way in or out are their own component and go first; then the smallest
    label is passed forward, and what leads back to its label's node along equal labels is that node's component.
    """
    left, rest = materialised(nodes.select("node")), materialised(edges.select("src", "dst").filter("src <> dst").distinct())
    done = None

    def settle(part: DataFrame) -> None:
        nonlocal done, left, rest
        part = materialised(part)
        done = part if done is None else done.unionByName(part)
        gone = part.select("node")
        left = materialised(left.join(gone, "node", "left_anti"))
        rest = materialised(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))

    while not left.isEmpty():
        while True:  # trimming
            ways_out, ways_in = rest.select(F.col("src").alias("node")).distinct(), rest.select(F.col("dst").alias("node")).distinct()
            inner = left.join(ways_out, "node", "left_semi").join(ways_in, "node", "left_semi")
            trimmed = materialised(left.join(inner, "node", "left_anti"))
            if trimmed.isEmpty():
                break
            settle(trimmed.select("node", F.col("node").alias("component")))
        if left.isEmpty():
            break
        colour = materialised(left.select("node", F.col("node").alias("component")))
        while True:
            got = rest.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("got"))
            new = materialised(colour.join(got, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("got", "component")).alias("component")))
            if new.filter("component <> old").isEmpty():
                break
            colour = new.select("node", "component")
        own = rest.join(colour.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").filter("a = b").select("src", "dst")
        back = distances(own, colour.filter("node = component").select("node"), reverse=True)
        settle(colour.join(back, "node", "left_semi"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def component_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, src, dst) of edges whose ends are in one component."""
    a = components.select(F.col("node").alias("src"), "component")
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    return edges.join(a, "src").join(b, "dst").filter("component = _b").select("component", "src", "dst")


def two_hop(edges: DataFrame, page) -> DataFrame:
    """Nodes within two undirected steps of a page. Edges, which may repeat, are read twice, and only those that touch the page or its
    neighbours are looked at for repeats."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    one = materialised(both.filter(F.col("src") == F.lit(page)).select(F.col("dst").alias("node")).distinct())
    two = both.join(one.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"))
    return one.unionByName(two).distinct().filter(F.col("node") != F.lit(page))


#: Nodes that follow a middle and are sent in one row, about.
CHUNK = 1024


def neighbour_pairs(edges: DataFrame, rows: int = 0) -> DataFrame:
    """src, dst, n: in how many ways two steps along the edges (src, dst, repeated ones counted) lead from src to dst.

    Sources are put in ranges of about as many ways each (cells); what follows a middle is sent once to each cell with a source that leads to it, and
    the pairs are made and summed there. So no pair is shuffled, and what a cell gets is at most a number a way, far less where near nodes share
    their middles. The number of ways over all middles tells how many parts there are, so a task sums about as many whatever the size. Pairs
    of a source with more ways than a cell may hold (hubs) are dealt one by one. rows: as many as there are edges, or more, where that is known.
    """
    links = materialised(dealt(edges.select("src", "dst"), rows, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    out = links.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("n_out"))
    into = links.groupBy(F.col("dst").alias("mid")).agg(F.count("*").alias("n_in"))
    ways = into.join(out, "mid").agg(F.coalesce(F.sum(F.col("n_in") * F.col("n_out")), F.lit(0))).first()[0]
    n = links.count()
    parts, most = max(parts_of(links.sparkSession, ways), 1), 2 * shared.ROWS
    first = dealt(links.select("src", F.col("dst").alias("mid"), "n"), n, "mid").join(out, "mid")
    first = materialised(first.repartitionByRange(parts, "src").select(F.spark_partition_id().alias("range"), "src", "mid", "n", "n_out"))
    sources = materialised(first.groupBy("range", "src").agg(F.sum("n_out").alias("ways")))
    hubs = sources.filter(F.col("ways") > most).select("src", "ways")  # at most one in so many ways
    from_hubs = hubs.agg(F.coalesce(F.sum("ways"), F.lit(0))).first()[0]
    if from_hubs:
        hub, is_hub = F.broadcast(hubs.select(F.col("src").alias("hub"))), F.col("src").eqNullSafe(F.col("hub"))
        first, of_hubs = first.join(hub, is_hub, "left_anti"), first.join(hub, is_hub, "left_semi")
    # a row for each range, as many as parts at most; those with many ways are split by source
    ranges = sources.filter(F.col("ways") <= most).groupBy("range").agg(F.ceil(F.sum("ways") / most).alias("cells"))
    ranges = ranges.withColumn("begin", F.sum("cells").over(Window.orderBy("range")) - F.col("cells"))
    chunks = F.ceil(F.col("n_out") / CHUNK).cast("int")
    cell = (F.col("begin") + F.pmod(F.xxhash64("src"), F.col("cells"))).alias("cell")
    lead = first.join(F.broadcast(ranges), "range").select(cell, "src", "mid", "n", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    follow = dealt(links.select(F.col("src").alias("mid"), "dst", "n"), n, "mid").join(out, "mid").withColumn("chunk", F.pmod(F.xxhash64("dst"), chunks).cast("int"))
    tasks = max(parts_of(links.sparkSession, n), parts_of(links.sparkSession, ways // 8))
    lead = lead.repartition(tasks, "mid", "chunk").groupBy("mid", "chunk", "cell").agg(F.collect_list(F.struct("src", "n")).alias("a"))
    follow = follow.repartition(tasks, "mid", "chunk").groupBy("mid", "chunk").agg(F.collect_list(F.struct("dst", "n")).alias("b"))
    # arrays of numbers are half as large as those of structs
    lead = lead.select("mid", "chunk", "cell", F.col("a.src").alias("sources"), F.col("a.n").alias("ns"))
    follow = follow.select("mid", "chunk", F.col("b.dst").alias("targets"), F.col("b.n").alias("ms"))
    sent = lead.join(follow, ["mid", "chunk"]).select((F.col("cell") % parts).cast("int").alias("part"), "sources", "ns", "targets", "ms").repartitionById(parts, "part")
    pairs = sent.select("part", "ns", "targets", "ms", F.posexplode("sources").alias("i", "src"))
    pairs = pairs.select("part", "src", F.col("ns")[F.col("i")].alias("n"), "ms", F.posexplode("targets").alias("j", "dst"))
    found = pairs.groupBy("part", "src", "dst").agg(F.sum(F.col("n") * F.col("ms")[F.col("j")]).alias("n")).drop("part")
    if not from_hubs:
        return found
    b = dealt(links.select(F.col("src").alias("mid"), "dst", F.col("n").alias("m")), n, "mid")
    pairs = dealt(of_hubs, n, "mid").join(b, "mid").select("src", "dst", (F.col("n") * F.col("m")).alias("n"))
    return found.unionByName(dealt(pairs, from_hubs, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n")))


def aggregate_edges(links: DataFrame) -> DataFrame:
    """Occurrences as different edges (src, dst, layer) with their number and first evidence."""
    return links.groupBy("src", "dst", "layer").agg(F.count("*").alias("occurrences"), F.min("link_id").alias("first_link"), F.max("link_id").alias("last_link"))


def findings(nodes: DataFrame, links: DataFrame, root, goals: list, selected: tuple[str, ...] = ("contextual", "related")) -> DataFrame:
    """(finding, node): true_orphan, contextual_orphan, contextual_dead_end, menu_dependence,
    homepage_dependence, global_shell_dependence."""
    links = links.filter("src <> dst")
    into = links.groupBy(F.col("dst").alias("node")).agg(
        F.max((F.col("layer").isin(*selected)).cast("int")).alias("by_selected"), F.min(F.col("layer").isin(*SHELL).cast("int")).alias("only_shell"), F.min((F.col("src") == F.lit(root)).cast("int")).alias("only_root")
    )
    out = links.filter(F.col("layer").isin(*selected)).select(F.col("src").alias("node"), F.lit(1).alias("leads_on")).distinct()
    start = nodes.filter(F.col("node") == F.lit(root))
    reached = distances(build_graph(links), start).select("node")
    without = distances(build_graph(links.filter("layer <> 'menu'")), start).select("node")
    menu = reached.join(without, "node", "left_anti").withColumn("needs_menu", F.lit(1))
    all_ = nodes.join(into, "node", "left").join(out, "node", "left").join(menu, "node", "left")
    other = F.col("node") != F.lit(root)
    tests = {
        "true_orphan": other & F.col("by_selected").isNull(),
        "contextual_orphan": other & (F.col("by_selected") == 0),
        "contextual_dead_end": ~F.col("node").isin(goals) & F.col("leads_on").isNull(),
        "menu_dependence": F.col("needs_menu").isNotNull(),
        "homepage_dependence": other & (F.col("only_root") == 1),
        "global_shell_dependence": other & (F.col("only_shell") == 1),
    }
    return all_.select("node", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("finding")).select("finding", "node")


def snapshot_diff(current: DataFrame, previous: DataFrame, *keys: str) -> DataFrame:
    """Keys with change: added, removed, unchanged."""
    a = current.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = previous.select(*keys).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("unchanged")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"))


def resolve_destinations(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with the page's route that their destination names, as a route or as a canonical URL; the first
    route by name where several do, null where none does."""
    keys = destination_candidates(pages).groupBy("destination").agg(F.min("route").alias("resolved"))
    return links.join(keys, "destination", "left")


def destination_candidates(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("route").alias("destination"), "route").unionAll(pages.select(F.col("canonical_url").alias("destination"), "route"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each site and the one before with other content."""
    order = Window.partitionBy("site_id").orderBy("taken_at", "snapshot_id")
    changed = snapshots.withColumn("_before", F.lag("content").over(order)).filter("NOT (content <=> _before)")
    last = Window.partitionBy("site_id").orderBy(F.desc("taken_at"), F.desc("snapshot_id"))
    rows = changed.withColumn("k", F.row_number().over(last)).filter("k <= 2")
    return rows.groupBy("site_id").agg(F.max(F.when(F.col("k") == 1, F.col("snapshot_id"))).alias("latest"), F.max(F.when(F.col("k") == 2, F.col("snapshot_id"))).alias("previous"))


def redirect_aliases(redirects: DataFrame) -> DataFrame:
    """(alias, target) of redirects with one target only."""
    return redirects.groupBy(F.col("source").alias("alias")).agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).filter("n = 1").drop("n")


def reconcile_links(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """links (link_id, src, dst) with the state of both ends: missing ones make a link unresolved, contradicted
    ones make it contradicted. candidates: route, state."""
    a = candidates.select(F.col("route").alias("src"), F.col("state").alias("_a"))
    b = candidates.select(F.col("route").alias("dst"), F.col("state").alias("_b"))
    out = links.join(a, "src", "left").join(b, "dst", "left")
    state = F.when(F.col("_a").isNull() | F.col("_b").isNull() | F.col("_b").isin("missing"), "unresolved").when((F.col("_a") == "contradicted") | (F.col("_b") == "contradicted"), "contradicted").otherwise("resolved")
    return out.withColumn("state", state).drop("_a", "_b")
