"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Rates stay as close to one as they can, in relative entropy, while each source's words meet its target and no rate
passes `most`: that makes a rate exp(lambda * size / mean size), cut off at `most`, with one lambda a source. The
lambdas minimise a convex dual; each Newton step sums its gradient and curvature over a histogram of sizes in Spark.
Rates become whole copies by running totals, so a source's words miss its target by a few words, not by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriclake.llm.shared import written

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
#: A source as columns that are never null, and with them a class: the documents of one source and size.
SOURCE = ["_none", "_source"]
CLASS = [*SOURCE, "size"]
#: Rows that one explode makes of a repeated row at most (more make more of them).
CHUNK = 4096


def exact_sum(x: Column) -> Column:
    """Sum that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, _none, _source, size, m: the different (doc_id, source, size) and how many rows have them; written."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"), size.alias("size"))
    return written(rows.groupBy("doc_id", *CLASS).agg(F.count("*").alias("m")), "sizes")


def targets(classes: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """classes (_none, _source, size, n) -> one row a source: source_size, target, mean (words of its documents that have
    any). Sources by code point, null last,
    weigh `weights` in turn. They share `share` of all words; no target passes `most` times its source's words: what
    is over is shared again by weight. Its windows hold a row a source."""
    full = F.when(F.col("size") > 0, F.col("n"))
    own = classes.groupBy(*SOURCE).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.coalesce(F.sum(full), F.lit(1)).alias("_full"))
    nth = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weighed = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    room = F.col("source_size") * most
    order, every = Window.orderBy(room / F.col("weight"), *SOURCE), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(room).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * share - filled) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = weighed.withColumns({"_nth": F.row_number().over(order), "_level": level})
    fits = F.when(F.col("_level") * F.col("weight") <= room, F.struct("_nth", "_level"))
    whole = ranked.withColumn("_level", F.min(fits).over(every)["_level"])
    target = F.least(room.cast("double"), F.coalesce(F.col("weight") * F.col("_level"), F.lit(0.0)))
    return whole.select(*SOURCE, "source_size", target.alias("target"), (F.col("source_size") / F.col("_full")).alias("mean"))


def tilts(classes: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """The lambda of each source whose target is neither nothing nor all it can give; written.

    A Newton step that leaves the bracket of the root is replaced by the bracket's middle, so rounds end. Sums don't
    depend on the order of rows, so neither do the lambdas."""
    words = classes.filter("size > 0").join(aims.filter(f"target > 0 AND target < {most} * source_size"), SOURCE)
    words = written(words.select(*SOURCE, "n", (F.col("size") / F.col("mean")).alias("x"), (F.col("target") / F.col("mean")).alias("aim")), "words")
    shortest, given = F.min("x"), exact_sum(F.col("n") * F.col("x"))
    low, high = F.least(F.log(F.first("aim") / given) / shortest, F.lit(0.0)), F.log(F.lit(float(most))) / shortest
    state = words.groupBy(*SOURCE).agg(F.first("aim").alias("aim"), F.max(F.lit(0.0)).alias("tilt"), low.alias("low"), high.alias("high"))
    state = written(state.withColumn("done", F.lit(False)), "tilts")
    while not state.filter("NOT done").isEmpty():
        rate = F.least(F.exp(F.col("tilt") * F.col("x")), F.lit(float(most)))
        weight = F.col("n") * F.col("x") * rate
        bend = F.when(rate < most, weight * F.col("x")).otherwise(0.0)
        sums = words.drop("aim").join(state.filter("NOT done"), SOURCE).groupBy(*SOURCE).agg(exact_sum(weight).alias("_sum"), exact_sum(bend).alias("_bend"))
        found = state.join(sums, SOURCE, "left")
        over = F.col("_sum") - F.col("aim")  # null where it is done
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("_bend") > 0, F.col("tilt") - over / F.col("_bend"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(over) <= F.col("aim") * 1e-9) | (high - low <= 1e-14 * F.greatest(F.abs(low), F.abs(high)))
        state = written(found.select(*SOURCE, "aim", F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")), "tilts")
    return state.select(*SOURCE, "tilt")


def plan(classes: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """classes with source_size, target, rate and k, the copies that the class's n documents take together; written.

    Copies follow the running total of rates by falling size, which misses a target by less than the source's largest
    document; then the one class that comes nearest to what is missing gives or takes copies. Windows hold a row a class
    of a source, of which there are less than sqrt(2 x words)."""
    aims = written(targets(classes, share, most, weights), "targets")
    whole = classes.join(aims, SOURCE).join(tilts(classes, aims, most), SOURCE, "left")
    full = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(most))
    rated = whole.withColumn("rate", full.otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(most)))))
    total = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy(*SOURCE).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    k = F.floor(total + 0.5) - F.floor(F.coalesce(F.lag("_total").over(Window.partitionBy(*SOURCE).orderBy(F.desc("size"))), F.lit(0.0)) + 0.5)
    rounded = rated.withColumn("_total", total).withColumn("k", F.greatest(F.lit(0), F.least(k, F.col("n") * most)))
    source = Window.partitionBy(*SOURCE)
    missing = rounded.withColumn("_missing", F.col("target") - F.sum(F.col("k") * F.col("size")).over(source))
    more = F.greatest(-F.col("k"), F.least(F.round(F.col("_missing") / F.col("size")), F.col("n") * most - F.col("k")))
    given = missing.withColumn("_more", F.when(F.col("size") > 0, more).otherwise(0).cast("long"))
    choice = F.struct(F.abs(F.col("_missing") - F.col("_more") * F.col("size")).alias("left"), F.abs("_more").alias("by"), F.col("size").alias("size"))
    last = given.withColumn("_last", F.min(choice).over(source)["size"])
    k = F.when(F.col("size") == F.col("_last"), F.col("k") + F.col("_more")).otherwise(F.col("k"))
    return written(last.select(*CLASS, "n", "source_size", "target", "rate", k.alias("k")), "plan")


def shares(documents: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes with their class's plan and k, the copies that the m rows take together.

    The documents of a class stand in the order of their ids' hashes; the j first of n take j * k div n copies. Their
    numbers are counted in parts of a class, whose sizes are summed first, so no class meets in one task."""
    keys = sizes(documents).withColumn("_hash", F.xxhash64("doc_id")).withColumn("_part", F.shiftright("_hash", 52))
    parts = written(keys.groupBy(*CLASS, "_part").agg(F.sum("m").alias("_rows")), "parts")
    plans = plan(parts.groupBy(*CLASS).agg(F.sum("_rows").alias("n")), share, most, weights)
    before = F.sum("_rows").over(Window.partitionBy(*CLASS).orderBy("_part")) - F.col("_rows")
    begun = parts.withColumn("_before", before).drop("_rows").join(plans, CLASS)
    nth = F.col("_before") + F.sum("m").over(Window.partitionBy(*CLASS, "_part").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    numbered = keys.join(begun, [*CLASS, "_part"]).withColumn("_nth", nth.cast("decimal(19,0)"))
    taken = F.expr("(_nth * CAST(k AS DECIMAL(19,0))) DIV n - ((_nth - m) * CAST(k AS DECIMAL(19,0))) DIV n")
    return numbered.withColumn("k", taken).drop("_hash", "_part", "_before", "_nth", "n")


def mix(documents: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """documents (doc_id, text, source) -> a row for each: doc_id, source, size, source_size, target, rate, copies, taken.

    A document's size is its words (null text: 0); copies is a whole number up to `most`, taken is copies * size. A
    null source is a source of its own, the last. Rows alike in id, source and size are dealt the copies in no order,
    as nothing here tells them apart; a null id is one id. Sources without words, and empty tables, take nothing; empty documents take one
    copy. Other columns are left out. Reruns agree, however rows are dealt to tasks.
    """
    more = F.expr("k - (k DIV m) * m")
    kinds = F.array(F.struct((F.expr("k DIV m") + 1).alias("copies"), more.alias("times")), F.struct(F.expr("k DIV m").alias("copies"), (F.col("m") - more).alias("times")))
    rows = shares(documents, share, most, weights).withColumn("_kind", F.explode(F.filter(kinds, lambda x: x["times"] > 0)))
    rows = rows.withColumn("_times", F.col("_kind.times")).withColumn("_at", F.explode(F.expr(f"sequence(0, (_times - 1) DIV {CHUNK})")))
    rows = rows.withColumn("_one", F.explode(F.expr(f"sequence(1, least({CHUNK}, _times - _at * {CHUNK}))")))
    source = F.when(~F.col("_none"), F.col("_source"))
    return rows.select("doc_id", source.alias("source"), "size", "source_size", "target", "rate", F.col("_kind.copies").cast("int").alias("copies"), (F.col("_kind.copies") * F.col("size")).alias("taken"))


def mixture(documents: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: documents with all their columns, each row as often as the mix takes it. Only rows alike in id,
    source and size are numbered together; texts are shuffled once."""
    id_key, own = ["_id", "_no", *CLASS], [c for c in documents.columns]
    dealt = shares(documents, share, most, weights).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_no"), *CLASS, "m", "k")
    source, size = F.col("_row.source").cast("string"), F.coalesce(F.regexp_count("_row.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    rows = rows.select("_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("_row.doc_id").isNull().alias("_no"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source"), size.alias("size"))
    alike = Window.partitionBy(*id_key).orderBy(F.lit(0))
    numbered = rows.join(dealt, id_key).withColumn("_nth", F.row_number().over(alike))
    copies = F.expr("CAST(k DIV m + CASE WHEN _nth <= k - (k DIV m) * m THEN 1 ELSE 0 END AS INT)")
    return numbered.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")
