"""Resumable builds in verified shards: staged, counted and digested, then moved into place and entered in a manifest."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.contracts import ContractError, row_digest

#: Shards whose names are broadcast.
BROADCAST_SHARDS = 100_000


def shard_digests(rows: DataFrame, shard: str, columns: Sequence[str]) -> DataFrame:
    """``shard, rows, digest``: a digest of a shard's rows in any order, repeats counted (sums of the rows' digests, combined map-side)."""
    d = rows.select(F.col(shard).cast("string").alias("shard"), row_digest(list(columns)).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return d.groupBy("shard").agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("digest"))


class Shards:
    """A folder of shards ``rows/shard=<name>`` and a manifest with, for each shard, its rows, digest and the inputs' fingerprint.

    ``build`` writes what isn't there yet, verified: shards whose files are missing, unreadable or of other content, or whose
    manifest names other inputs, are built again; the rest isn't touched. A run that is cut off leaves whole shards or none: new
    ones are staged beside, counted and digested as read back, and each is moved by one rename before the manifest names it.
    """

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str], shard: str = "shard"):
        self.spark, self.path, self.columns, self.shard = spark, path.rstrip("/"), dict(columns), shard
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self.path}/{name}"))

    def _schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.columns.items())

    def manifest(self) -> DataFrame:
        """The latest entry of each shard: ``shard, rows, digest, inputs, built``."""
        kind = "shard string, rows bigint, digest string, inputs string, built double"
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], kind)
        m = self.spark.read.schema(kind).parquet(f"{self.path}/manifest")
        return m.groupBy("shard").agg(F.max_by(F.struct("rows", "digest", "inputs", "built"), "built").alias("m")).select("shard", "m.*")

    def _read(self, at: str) -> DataFrame:
        # a file that can't be read counts as missing rows, which the digest shows
        rows = self.spark.read.schema(f"{self._schema()}, `{self.shard}` string").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(at)
        return rows

    def status(self, inputs: str = "") -> DataFrame:
        """One row for each shard that the manifest or the folder has: ``shard, rows, status``: ``verified, damaged, missing, unlisted`` or ``stale`` (other inputs)."""
        m = self.manifest()
        if self._exists("rows"):
            have = shard_digests(self._read(f"{self.path}/rows"), self.shard, list(self.columns)).select("shard", F.col("rows").alias("n"), F.col("digest").alias("d"))
        else:
            have = self.spark.createDataFrame([], "shard string, n bigint, d string")
        both = m.join(have, "shard", "full")
        status = (
            F.when(F.col("rows").isNull(), "unlisted").when(F.col("n").isNull(), "missing").when((F.col("n") != F.col("rows")) | (F.col("d") != F.col("digest")), "damaged")
            .when(F.col("inputs") != inputs, "stale").otherwise("verified")
        )
        return both.select("shard", F.coalesce("rows", "n").alias("rows"), status.alias("status"))

    def build(self, shards: DataFrame, make: Callable[[DataFrame], DataFrame], inputs: str = "") -> DataFrame:
        """Build the ``shard`` names of ``shards`` that aren't verified: ``make`` gets these (a frame) and returns their rows with the shard column.

        Returns the names that were built. A shard for which ``make`` has no rows is an error.
        """
        wanted = shards.select(F.col(self.shard).cast("string").alias("shard")).distinct()
        done = self.status(inputs).where("status = 'verified'").select("shard")
        todo = [r.shard for r in wanted.join(done, "shard", "left_anti").collect()]  # names of shards, each a folder to be moved
        if not todo:
            return self.spark.createDataFrame([], "shard string")
        names = self.spark.createDataFrame([(n,) for n in todo], f"`{self.shard}` string")
        rows = make(F.broadcast(names) if len(todo) <= BROADCAST_SHARDS else names).select(*self.columns, F.col(self.shard).cast("string").alias(self.shard))
        stage = f"{self.path}/staged-{uuid.uuid4().hex}"
        rows.repartition(self.shard).write.partitionBy(self.shard).parquet(f"{stage}/rows")
        counted = shard_digests(self._read(f"{stage}/rows"), self.shard, list(self.columns)).select("shard", "rows", "digest", F.lit(inputs).alias("inputs"), F.lit(time.time()).alias("built"))
        entries = counted.collect()  # a row for each folder to be moved
        if lacking := sorted(set(todo) - {e.shard for e in entries}):
            raise ContractError(f"no rows for {lacking[:5]} ({len(lacking)} shards)")
        for e in entries:
            self._move(f"{stage}/rows/{self.shard}={_escaped(e.shard)}", f"{self.path}/rows/{self.shard}={_escaped(e.shard)}")
        self.spark.createDataFrame(entries, counted.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._fs.delete(self._fs_path(stage), True)
        return self.spark.createDataFrame([(e.shard,) for e in entries], "shard string")

    def _move(self, source: str, target: str) -> None:
        """Put a staged folder in its place; what a damaged one left goes."""
        to = self._fs_path(target)
        self._fs.delete(to, True)
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(self._fs_path(source), to):
            raise OSError(f"{source} could not be moved to {target}")

    def read(self, inputs: str = "") -> DataFrame:
        """The rows, if every listed shard is verified; else an error that names one that isn't."""
        bad = self.status(inputs).where("status <> 'verified'").first()
        if bad is not None:
            raise ContractError(f"shard {bad.shard}: {bad.status}")
        return self.spark.read.schema(f"{self._schema()}, `{self.shard}` string").parquet(f"{self.path}/rows")


def _escaped(name: str) -> str:
    """A partition value as Spark writes it in a path: plain for letters, digits, '-', '_' and '.'."""
    if not name or not all(c.isalnum() or c in "-_." for c in name):
        raise ValueError(f"{name!r} is no name for a shard: letters, digits, '-', '_', '.'")
    return name
