"""Token ids as Simple-8b words: an own file format inside Parquet, written in document order, read vectorised.

A block holds whole documents. Its header has their ids, the offset of each in the block, and the block's
most frequent token ids in order of frequency; a token is stored as its 1-based rank there. A token that
is not in the header is the escape code 0, its id stands in the escape stream. Codes are packed greedily
into 64-bit words: 4 bits of selector, which says how many codes of how many bits follow, and 60 of codes.

Layout of a row: shard int, block int (order within the shard), shard_start long (ids of the shard before
the block), n_ids long, doc_ids / doc_starts binary (little-endian int64), no_id binary (a byte a document, 1 if
its doc_id is null), ranked binary (uint32), words binary (uint64), escapes binary (uint32). Shards ascend with
doc_id; a null comes before all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metriclake.llm.arrays import U, slices
from metriclake.llm.encoder import Encoder, with_end
from metriclake.llm.shared import new_path, shuffle_partitions

#: Codes in a word and their bits, by selector (fixed values of the format).
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
COUNTS = np.array([n for n, _ in SELECTORS])
#: Ranks that the header of a block may have: codes then fit in ten bits.
RANKED = 1023
#: A block is closed when it has so many ids; a document is never split.
BLOCK_IDS = 1 << 17
SCHEMA = "shard int, block int, shard_start long, n_ids long, doc_ids binary, no_id binary, doc_starts binary, ranked binary, words binary, escapes binary"


def pack(codes: np.ndarray) -> np.ndarray:
    """Simple-8b words of non-negative codes under 2**60."""
    n = len(codes)
    if not n:
        return np.zeros(0, U)
    padded = np.concatenate([codes.astype(U), np.zeros(60, U)])
    width = np.zeros(len(padded), dtype=np.uint8)
    rest = padded.copy()
    while rest.any():
        width += rest > 0
        rest >>= U(1)
    choice = np.zeros(n, dtype=np.uint8)
    reach, have = width, 1
    for s, (count, bits) in enumerate(SELECTORS):
        while have < count:  # reach[i]: the widest of the `have` codes from i
            step = min(have, count - have)
            reach = np.maximum(reach[: len(reach) - step], reach[step:])
            have += step
        choice[reach[:n] <= bits] = s
    jump = COUNTS[choice].tolist()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += jump[i]
    at = np.array(starts)
    selector = choice[at]
    out = selector.astype(U) << U(60)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shift = np.arange(count, dtype=U) * U(bits)
            out[mine] |= np.bitwise_or.reduce(padded[at[mine][:, None] + np.arange(count)] << shift, axis=1)
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n codes of Simple-8b words."""
    selector = (words >> U(60)).astype(np.int64)
    counts = COUNTS[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=U)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shift = np.arange(count, dtype=U) * U(bits)
            out[at[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shift) & U((1 << bits) - 1)
    return out[:n]


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranked ids, words, escapes) of a block's token ids."""
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:RANKED]
    code = np.zeros(len(values), dtype=U)
    code[order] = np.arange(1, len(order) + 1, dtype=U)
    codes = code[inverse]
    return values[order].astype(np.uint32), pack(codes), ids[codes == 0].astype(np.uint32)


def decode_block(ranked: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    codes = unpack(words, n).astype(np.int64)
    ids = np.concatenate([np.zeros(1, np.uint32), ranked])[codes]
    ids[codes == 0] = escapes
    return ids


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int, leading: bool = True) -> None:
    """Write the token ids of documents (doc_id, text; other columns are not read) to a new folder.

    Documents are range-partitioned and sorted by doc_id (rows with equal doc_id by text, a null doc_id
    first); a null text has only the end id. An empty table makes a folder without blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = Encoder.of(tokenizer, leading), TaskContext.get().partitionId()
        block = before = held = 0
        docs: list[pa.Array] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            ranked, words, escapes = encode_block(ids)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))[:-1]]).astype("<i8")
            doc = pa.concat_arrays(docs)
            row = [shard, block, before, len(ids), doc.fill_null(0).to_numpy().astype("<i8").tobytes(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), starts.tobytes(), ranked.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in slices(batches):
            ids, offsets = with_end(*encoder.encode(batch.column(1)), end_id)
            doc = batch.column(0)
            i = 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_IDS - held, "right")) - 1)
                j = min(j, len(doc))
                docs.append(doc[i:j])
                parts.append(ids[offsets[i] : offsets[j]])
                lengths.append(np.diff(offsets[i : j + 1]))
                held += int(offsets[j] - offsets[i])
                i = j
                if held >= BLOCK_IDS:
                    yield close()
                    before, block, held = before + held, block + 1, 0
                    docs, parts, lengths = [], [], []
        if docs:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(2 * shuffle_partitions(documents.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(blocks, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, with_tokens: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens (with
    the end id), ids_crc32, and with_tokens the ids themselves as array<int>.

    A null doc_id comes back as null. Only per-shard totals (one row per file) meet in one task.
    """
    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * with_tokens

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                starts = np.frombuffer(r["doc_starts"], "<i8")
                ids = decode_block(np.frombuffer(r["ranked"], "<u4"), np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u4"), r["n_ids"])
                ends = np.append(starts[1:], r["n_ids"])
                raw = memoryview(ids.astype("<u4").tobytes())
                out = [
                    pa.array(np.full(len(starts), r["shard"], np.int32)),
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["no_id"], np.uint8).astype(bool)),
                    pa.array(starts + r["shard_start"]),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ]
                if with_tokens:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, r["n_ids"]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    found = files.mapInArrow(documents, schema).join(F.broadcast(before), "shard")  # a row per file
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["tokens"] * with_tokens))


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write documents' ids to a new folder in the shared place and read them back."""
    path = new_path(documents.sparkSession, "simple8b")
    write_ids(documents, path, tokenizer, end_id)
    return read_ids(documents.sparkSession, path)
