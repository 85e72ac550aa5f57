"""Toxicity by classifier chains: categories are predicted one after the other, and each linear model also
reads the probabilities of the categories before it, out of fold while it is trained.

Words are folded (A-Z lower-cased, marks left out) and hashed; those that tell a category apart in a bounded
labelled sample become features, present or not. Models are logistic regressions fitted on that sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import U, folded_words, signed, slices, window_hashes

#: Labelled documents that the chain is fitted on at most, taken by hash of doc_id.
SAMPLE = 8192
#: Words kept as features for each category.
WORDS = 256
#: A word must stand in this share of a category's documents, and in three, to be a feature.
LEAST_SHARE = 0.01
FOLDS = 5
#: Categories in the order of the chain, each with what makes a label positive.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


@dataclass(frozen=True)
class Chain:
    """Sorted word hashes; for each category its weights of the words, of earlier categories, and intercept."""

    words: np.ndarray
    names: tuple[str, ...]
    weights: tuple[tuple[np.ndarray, np.ndarray, float], ...]
    cut: float

    def probabilities(self, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """(documents x categories) from pairs (document, feature number), each once."""
        out = np.zeros((n, len(self.names)))
        for k, (of_words, of_earlier, intercept) in enumerate(self.weights):
            z = np.bincount(doc, weights=of_words[word], minlength=n) + out[:, :k] @ of_earlier + intercept
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_logistic(x: np.ndarray, extra: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and extra, and the intercept, by accelerated gradient steps on the
    class-balanced penalised likelihood."""
    full = np.hstack([x, extra]).astype(np.float32)
    n = len(y)
    balance = np.where(y, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum())))
    balance = np.minimum(balance, 20.0)
    w, b, v, vb = np.zeros(full.shape[1], np.float32), 0.0, np.zeros(full.shape[1], np.float32), 0.0
    rows = full.T.copy()
    rate = 1.0 / (0.25 * (np.square(full).sum(axis=1) + 1).max() * balance.mean() + penalty / n)
    for t in range(steps):
        look, look_b = w + v * np.float32(t / (t + 3)), b + vb * (t / (t + 3))
        error = (balance * (1 / (1 + np.exp(-np.clip(full @ look + look_b, -30, 30))) - y)).astype(np.float32)
        new, new_b = look - np.float32(rate) * (rows @ error / np.float32(n) + np.float32(penalty / n) * look), look_b - rate * float(error.mean())
        w, b, v, vb = new, new_b, new - w, new_b - b
    return w.astype(float), float(b)


def fit_chain(x: np.ndarray, labels: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray]:
    """Models of each category and the out-of-fold probabilities. x and labels have a row per document."""
    n, k = labels.shape
    fold = np.arange(n) % FOLDS
    held_out = np.zeros((n, k))
    models = []
    for c in range(k):
        earlier, y = held_out[:, :c], labels[:, c].astype(float)
        for f in range(FOLDS):
            train, test = fold != f, fold == f
            if not test.any() or not train.any():
                continue
            w, b = fit_logistic(x[train], earlier[train], y[train])
            held_out[test, c] = 1 / (1 + np.exp(-np.clip(np.hstack([x[test], earlier[test]]) @ w + b, -30, 30)))
        w, b = fit_logistic(x, earlier, y)
        models.append((w[: x.shape[1]], w[x.shape[1] :], b))
    return models, held_out


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1 on out-of-fold predictions; the middle of the widest such gap."""
    values = np.unique(p)
    best = (-1.0, 0.5)
    for low, high in zip(np.append(0.0, values), np.append(values, 1.0), strict=False):
        at = (low + high) / 2
        hit = p > at
        f1 = 2 * np.sum(hit & y) / max(1, hit.sum() + y.sum())
        if f1 > best[0] + 1e-12 or (abs(f1 - best[0]) <= 1e-12 and high - low > best[2]):
            best = (f1, at, high - low)
    return float(best[1])


def _presence(rows: DataFrame, keep: np.ndarray | None) -> DataFrame:
    """(doc_id, word) of rows (doc_id, text), each pair once per row: all words, or those kept."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first = folded_words(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            if keep is not None and len(keep):
                at = np.minimum(np.searchsorted(keep, hashes), len(keep) - 1)
                hit = keep[at] == hashes
                hashes, doc = hashes[hit], doc[hit]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new])), pa.array(signed(hashes[new]))], names=["doc_id", "word"])

    return rows.mapInArrow(found, "doc_id long, word long")


def _sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, sketch) of rows (doc_id, text): the least hash of five words in a row, which copies and
    near copies mostly share; of fewer words the hash of all."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first = folded_words(batch.column(1))
            least = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = window_hashes(hashes[a:b], max(1, min(5, b - a)))
                least.append(int(own.min()) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(np.array(least, dtype=U)))], names=["doc_id", "sketch"])

    return rows.mapInArrow(found, "doc_id long, sketch long")


def fit(documents: DataFrame, labels: DataFrame, categories: tuple[tuple[str, str], ...] = CATEGORIES, sample: int = SAMPLE, words: int = WORDS) -> Chain:
    """A chain for documents with labels (doc_id and the labels' columns); at most `sample` labelled ids.

    A label that is null counts as negative. An id with several label rows is positive if one of them is; of rows
    with one labelled doc_id, that of the first text by order is learned from. Without labelled documents
    nothing is toxic.
    """
    names = tuple(name for name, _ in categories)
    positive = [F.coalesce(F.expr(sql), F.lit(False)).cast("int").alias(f"y{i}") for i, (_, sql) in enumerate(categories)]
    marked = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *positive)
    marked = marked.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    rows = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    spark = documents.sparkSession
    some = spark.createDataFrame(rows, marked.schema)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # at most `sample` rows
    kept_ids = set()
    sketches = {r["doc_id"]: r["sketch"] for r in _sketches(texts).collect()}
    seen: set[int] = set()
    for r in rows:  # of copies, which would make their own words telling, one is learned from
        if r["doc_id"] in sketches and sketches[r["doc_id"]] not in seen:
            seen.add(sketches[r["doc_id"]])
            kept_ids.add(r["doc_id"])
    rows = [r for r in rows if r["doc_id"] in kept_ids]
    some = spark.createDataFrame(rows, marked.schema)
    texts = texts.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    counts = _presence(texts, None).join(F.broadcast(some), "doc_id").groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"p{i}") for i in range(len(names))])
    kept: set[int] = set()
    for i in range(len(names)):
        total, pos = len(rows), sum(r[f"y{i}"] for r in rows)
        if 0 < pos < total:
            # chi-squared of word and category, by its sign: words that speak for it
            share = pos / total
            score: Column = (F.col(f"p{i}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
            top = counts.filter(F.col(f"p{i}") >= max(3, LEAST_SHARE * pos)).select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(words).collect()
            kept |= {r["word"] for r in top if r["score"] > 2}
    hashes = np.sort(np.array(sorted(kept), dtype=np.int64).view(U))
    at = {r["doc_id"]: i for i, r in enumerate(rows)}
    x = np.zeros((len(rows), len(hashes)), dtype=np.float32)
    if len(hashes):  # at most sample x kept words, as an Arrow table
        found = _presence(texts, hashes).toArrow()
        doc = np.array([at[d] for d in found.column("doc_id").to_pylist()], dtype=np.int64)
        x[doc, np.searchsorted(hashes, found.column("word").to_numpy().view(U))] = 1
    y = np.array([[r[f"y{i}"] for i in range(len(names))] for r in rows], dtype=bool).reshape(len(rows), len(names))
    if not len(rows) or not y[:, -1].any():
        return Chain(hashes, names, tuple((np.zeros(len(hashes)), np.zeros(i), -30.0) for i in range(len(names))), 0.5)
    models, held_out = fit_chain(x, y)
    return Chain(hashes, names, tuple(models), best_cut(held_out[:, -1], y[:, -1]))


def score(documents: DataFrame, chain: Chain, keep_columns: bool = False) -> DataFrame:
    """doc_id, p_<category> of each and toxic (the last category's probability over the chain's cut) per row.

    keep_columns returns the columns of documents and toxic instead. A null or empty text has no words, so
    only the intercepts. Repeated rows stay; other columns, whatever their names, are not read.
    """
    columns = list(documents.columns)
    schema = ", ".join([*[f"p_{name} double" for name in chain.names], "toxic boolean"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in slices(batches):
            hashes, first = folded_words(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            word = np.zeros(0, dtype=np.int64)
            if len(chain.words):
                at = np.minimum(np.searchsorted(chain.words, hashes), len(chain.words) - 1)
                hit = chain.words[at] == hashes
                pair = np.unique(doc[hit] * len(chain.words) + at[hit])
                doc, word = pair // len(chain.words), pair % len(chain.words)
            else:
                doc = word
            yield batch, chain.probabilities(doc, word, batch.num_rows)

    if keep_columns:

        def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, p in judged(batches):
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(p[:, -1] > chain.cut)], names=[*[f"c{i}" for i in range(len(columns))], "toxic"])

        numbered = documents.toDF(*[f"c{i}" for i in range(len(columns))])
        id_at, text_at = columns.index("doc_id"), columns.index("text")
        rows = numbered.select(F.col(f"c{id_at}").cast("long").alias("doc_id"), F.col(f"c{text_at}").cast("string").alias("text"), "*")
        kinds = ", ".join([*[f"c{i} {kind}" for i, (_, kind) in enumerate(documents.dtypes)], "toxic boolean"])
        return rows.mapInArrow(filtered, kinds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in judged(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] > chain.cut)], names=["doc_id", *[c.split()[0] for c in schema.split(", ")]])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, f"doc_id long, {schema}")


def without_toxic(documents: DataFrame, chain: Chain) -> DataFrame:
    """documents without the rows that the chain rejects; all columns and other rows stay."""
    return score(documents, chain, keep_columns=True).filter("NOT toxic").drop("toxic").toDF(*documents.columns)
