"""A keyed table that is merged when it is read: batches add sorted files, none is rewritten.

A commit of the table's log names the files of one batch. A manifest keeps each file's range of keys and a Bloom filter of
them, in blocks, so that a lookup reads only files that can hold its keys. When the rows of deltas pass a share of those of
the base, all are merged into a new base; older commits stay, for reads of earlier versions and for the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metriclake.sources.commits import Conflict, Log

#: Bits of a block of a Bloom filter (Spark's bitmap functions have that many), keys of a block, bits of a key.
BITS, KEYS, HASHES = 32768, 2000, 3


class DeltaTable:
    """One row a key stays: the first by `order`, then of the latest batch. Null keys are keys."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: Callable[[], list[Column]], share: float = 0.5, least: int = 8) -> None:
        self.spark, self.folder, self.keys, self.order = spark, folder, keys, order
        self.share, self.least, self.log = share, least, Log(spark, folder)

    def first(self, rows: DataFrame, *then: Column) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order(), *then))
        return rows.withColumn("_k", nth).filter("_k = 1").drop("_k")

    def hashes(self) -> list[Column]:
        """Places of a key in its block."""
        return [F.pmod(F.xxhash64(F.lit(i), *self.keys), F.lit(BITS)) for i in range(HASHES)]

    def put(self, rows: DataFrame, kind: str, source: int | None, version: int) -> bool:
        """Write rows sorted by key, then their manifest, then the commit."""
        name = uuid.uuid4().hex
        ordered = rows.withColumn("_key", F.struct(*self.keys)).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
        ordered.write.parquet(f"{self.folder}/rows/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/{name}").select(*self.keys, F.col("_metadata.file_name").alias("file"))
        key = F.struct(*self.keys)
        sizes = written.groupBy("file").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        blocks = F.ceil(F.col("n") / KEYS).cast("int")
        at = written.join(sizes.select("file", "n"), "file").select("file", F.pmod(F.xxhash64(F.lit("block"), *self.keys), blocks).cast("int").alias("block"), F.explode(F.array(*self.hashes())).alias("bit"))
        bloom = at.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        sizes.withColumn("blocks", blocks).join(bloom, "file").withColumn("name", F.lit(name)).coalesce(1).write.parquet(f"{self.folder}/manifest/{name}")
        return self.log.put(version, name, kind, source)

    def append(self, batch: DataFrame, number: int) -> None:
        """Add batch `number` of a stream; one that was added before changes nothing. What it writes is as large as the batch."""
        newest = self.log.latest()
        if not self.log.read().filter((F.col("source") == number) & (F.col("kind") == "rows")).isEmpty():
            return
        if not self.put(self.first(batch), "rows", number, newest + 1):
            raise Conflict(f"another writer added version {newest + 1} of {self.folder}")
        sizes = {r.kind: r for r in self.files().groupBy("kind").agg(F.sum("n").alias("n"), F.countDistinct("version").alias("versions")).collect()}
        deltas, base = sizes.get("rows"), sizes.get("base")
        if deltas and deltas.versions >= self.least and deltas.n > self.share * (base.n if base else 0):
            self.compact()

    def compact(self) -> None:
        """Merge all that is live into a new base. If another commit comes first, nothing changes."""
        newest = self.log.latest()
        self.put(self.read(newest), "base", None, newest + 1)

    def live(self, version: int | None = None) -> DataFrame:
        """The commits that hold the rows at a version: the last base and what came after it."""
        commits = self.log.read(version)
        base = F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("version"))).over(Window.partitionBy()), F.lit(-1))
        return commits.withColumn("_base", base).filter("version >= _base").drop("_base")

    def files(self, version: int | None = None) -> DataFrame:
        """The manifest of the live files: version, kind, name, file, n, low, high, one row a file."""
        return self.blooms(version).drop("block", "bits", "blocks").distinct()

    def blooms(self, version: int | None = None) -> DataFrame:
        paths = [f"{self.folder}/manifest/{r.name}" for r in self.live(version).select("name").collect()]  # one a commit since the last base
        return self.spark.read.parquet(*paths).join(self.live(version).select("name", "version", "kind"), "name")

    def rows_of(self, commits: DataFrame) -> DataFrame:
        """All rows of some commits, with _version and _kind."""
        found = commits.select("name", "version", "kind").collect()
        rows = self.spark.read.parquet(*[f"{self.folder}/rows/{r.name}" for r in found])
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        of = commits.select(F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("kind").alias("_kind"))
        return rows.withColumn("_name", name).join(F.broadcast(of), "_name").drop("_name")  # one row a commit

    def read(self, version: int | None = None) -> DataFrame | None:
        """One row a key, as of a version (default: the newest); None of a table without commits."""
        if self.log.latest() < 0:
            return None
        return self.first(self.rows_of(self.live(version)), F.desc("_version")).drop("_version", "_kind")

    def history(self) -> DataFrame:
        """Every row that a batch brought, with its version and whether it is the one that reads give."""
        rows = self.rows_of(self.log.read().filter("kind = 'rows'"))
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order(), F.desc("_version")))
        return rows.withColumn("current", nth == 1).withColumnRenamed("_version", "version").drop("_kind")

    def candidates(self, keys: DataFrame) -> DataFrame:
        """name, file: the live files whose range and Bloom filter admit some of the keys."""
        asked = keys.select(F.struct(*self.keys).alias("_key"), F.xxhash64(F.lit("block"), *self.keys).alias("_hash"), F.array(*self.hashes()).alias("_bits")).distinct()
        byte = lambda bit: F.conv(F.hex(F.substring(F.col("bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        holds = F.forall("_bits", lambda bit: F.getbit(byte(bit), (bit % 8).cast("int")) == 1)
        sizes = self.blooms().select("blocks").distinct()
        dealt = asked.join(F.broadcast(sizes)).withColumn("block", F.pmod("_hash", "blocks").cast("int"))  # numbers of blocks: few
        return self.blooms().join(dealt, ["blocks", "block"]).filter((F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high")) & holds).select("name", "file").distinct()

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The current rows of keys; reads only files that can hold them."""
        paths = [f"{self.folder}/rows/{r.name}/{r.file}" for r in self.candidates(keys).collect()]
        every = self.live()
        rows = self.spark.read.parquet(*paths) if paths else self.spark.read.parquet(f"{self.folder}/rows/{every.first().name}").limit(0)
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        of = every.select(F.col("name").alias("_name"), F.col("version").alias("_version"))
        same = [F.col(f"_rows.{k}").eqNullSafe(F.col(f"_keys.{k}")) for k in self.keys]
        found = rows.withColumn("_name", name).join(F.broadcast(of), "_name").drop("_name").alias("_rows").join(keys.select(*self.keys).distinct().alias("_keys"), same, "left_semi")
        return self.first(found, F.desc("_version")).drop("_version")
