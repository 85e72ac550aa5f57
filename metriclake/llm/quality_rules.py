"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are Spark expressions. Sequential covering learns an ordered list of rules from
labelled statistics: each rule grows as a conjunction of thresholds on one part of the sample, is pruned on the
other, and takes what it covers out of both. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the list is learned on at most, taken by hash of doc_id.
SAMPLE = 8192
SPACE = r"[\\x20\\x09-\\x0D]"
WINDOW = 8
FEATURES = ("n_words", "symbol_share", "dup_line_count", "repeat_share", "word_length", "upper_share", "mark_share")


def statistics(documents: DataFrame) -> DataFrame:
    """documents' doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks
    (long), per row. A null text has none of anything."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(F.col("doc_id"), text.alias("text"))
    words = f"array_remove(split(text, '{SPACE}+'), '')"
    grams = f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) ELSE CAST(array() AS array<bigint>) END"
    found = base.withColumn("s", F.expr(f"transform(array({words}), w -> named_struct('n', size(w), 'grams', {grams}))[0]"))
    lines = f"filter(split(text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    sorted_grams = "sort_array(transform(s.grams, (h, i) -> named_struct('h', h, 'i', i)))"
    places = "sort_array(transform(filter(o, (x, k) -> x.h = get(o, k - 1).h OR x.h = get(o, k + 1).h), x -> x.i))"
    covered = f"aggregate(transform(array({sorted_grams}), o -> {places})[0], named_struct('last', 0, 'n', 0), (a, p) -> named_struct('last', p + {WINDOW}, 'n', a.n + p + {WINDOW} - greatest(p, a.last)), a -> a.n)"

    def characters(but: str) -> Column:
        return F.length(F.regexp_replace("text", but, "")).cast("long")

    return found.select(
        "doc_id",
        F.expr("s.n").cast("long").alias("n_words"),
        characters(r"[\x20\x09-\x0D]+").alias("word_chars"),
        characters(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> size(l) - size(array_distinct(l)))[0]").cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(s.grams)) = size(s.grams) THEN 0 ELSE {covered} END").cast("long").alias("n_repeat_words"),
        characters(r"[^\p{Lu}]+").alias("n_upper"),
        characters(r"[^!?]+").alias("n_marks"),
    )


def features() -> dict[str, Column]:
    """What the rules compare with thresholds, from the statistics; never null."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_count": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / chars,
    }


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (feature, sign, threshold): sign 1 is >, -1 is <=."""

    conditions: tuple[tuple[str, int, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, sign, at in self.conditions:
            column = x[:, FEATURES.index(name)]
            out &= column > at if sign > 0 else column <= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (features()[name] > at if sign > 0 else features()[name] <= at)
        return out


def _precision(covered: np.ndarray, bad: np.ndarray) -> float:
    """Laplace estimate of the share of bad rows among the covered."""
    return (np.sum(covered & bad) + 1) / (np.sum(covered) + 2)


def _grown(x: np.ndarray, bad: np.ndarray, cuts: int, most: int) -> Rule:
    """A conjunction that gains most information on the bad rows at each step."""
    rule = Rule(())
    inside = np.ones(len(x), dtype=bool)
    while len(rule.conditions) < most and (inside & ~bad).any():
        p, n = np.sum(inside & bad), np.sum(inside)
        best = (1e-9, None)
        for name in FEATURES:
            column = x[:, FEATURES.index(name)]
            for at in np.unique(np.quantile(column[inside], np.linspace(0.01, 0.99, cuts), method="lower")):
                for sign in (1, -1):
                    new = inside & (column > at if sign > 0 else column <= at)
                    q, m = np.sum(new & bad), np.sum(new)
                    gain = q * (np.log2(q / m) - np.log2(p / n)) if q else 0.0
                    if gain > best[0]:
                        best = (gain, (name, sign, float(at)))
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        inside = rule.covers(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, purity: float = 0.9, least: int = 3, cuts: int = 32, most: int = 3) -> list[Rule]:
    """Rules in order, each with at least `purity` (Laplace) and `least` bad rows of the pruning part.

    x has one row per labelled text and a column per feature. A third of the rows prunes.
    """
    part = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while (bad & ~part).any():
        rule = _grown(x[~part], bad[~part], cuts, most)
        if not rule.conditions:
            break
        shorter = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        rule = max(shorter, key=lambda r: (_precision(r.covers(x[part]), bad[part]), -len(r.conditions)))
        hit = rule.covers(x)
        if _precision(hit[part], bad[part]) < purity or np.sum(hit & part & bad) < least:
            break
        rules.append(rule)
        x, bad, part = x[~hit], bad[~hit], part[~hit]
    return rules


def learned(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list for documents with labels (doc_id, quality: 0 is bad); at most `sample` labelled ids.

    Labels that are null, or of ids without a document, are left out; no labels give no rules. Of rows with one
    labelled doc_id the first text by order is learned from.
    """
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    stats = statistics(texts).join(F.broadcast(some), "doc_id")
    rows = stats.select(*[c.alias(k) for k, c in features().items()], "quality").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return []
    table = np.array([tuple(r) for r in rows], dtype=float)
    return learn(table[:, :-1], table[:, -1] == 0)


def verdict(rules: list[Rule]) -> Column:
    """False for what the first matching rule rejects, True for the rest."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of every row of documents (doc_id, text) with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = statistics(documents).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(learned(documents, labels, sample)))
