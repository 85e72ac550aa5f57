"""Fill-in-the-middle examples: a text cut at two line borders, its parts put in another order.

One fullmatch of (unit)* keeps every repetition of the group, so its ends are the borders of all units: their number
and both cuts are read from them. The random numbers come from a hash of the id, so a rerun gives the same examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metriclake.llm.arrays import slices

#: A line with its end, or what is left at the end of the text. No match is given back, so none is tried twice.
UNITS = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def example(key: str, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of prefix and of middle, output) of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[first - 1] if first else 0), (ends[last - 1] if last else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output; other columns are left out.

    `rate` percent of the texts are transformed, `spm` percent of these begin with the suffix. A null text is empty;
    an empty text, and one that holds a sentinel, stays plain. A null id hashes as if it had no digits. A repeated row
    gives its example again, rows of one id with other texts share their random numbers. Rows are read one by one,
    in slices of a megabyte of text: nothing is shuffled, and memory follows the longest text alone.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, texts = batch.column(0), batch.column(1)
            rows = [example("" if k is None else str(k), t or "", seed, rate, spm) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)]
            n, form, before, within, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(output)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, " + MADE)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of this form was made from. Only texts without sentinels are transformed, and no
    sentinel can overlap another, so the places of the three are certain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    psm, spm = F.split(output, f"{SUFFIX}|{MIDDLE}", -1), F.split(output, f"{PREFIX}|{MIDDLE}", -1)
    cut = len(PREFIX) + 1
    return (
        F.when(form == "psm", F.concat(F.substring(psm[0], cut, 2**31 - 1), psm[2], psm[1]))
        .when(form == "spm", F.concat(spm[1], spm[2], F.substring(spm[0], cut, 2**31 - 1)))
        .otherwise(output)
    )


def digests(documents: DataFrame) -> DataFrame:
    """The examples with hashes in place of texts: output_sha256, and restored_sha256 of the text rebuilt from them."""
    hashed = {"output_sha256": F.sha2(F.encode("output", "UTF-8"), 256), "restored_sha256": F.sha2(F.encode(restored(), "UTF-8"), 256)}
    return transform(documents).withColumns(hashed).drop("output")
