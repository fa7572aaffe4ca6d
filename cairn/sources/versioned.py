"""A stored table whose writes are one step each: buckets by a hash of the key, and a manifest that names the folder of each.

A write makes new folders for the buckets that its keys touch and then one manifest file, whose appearance is the write. Readers take
the newest manifest and so see a write whole or not at all; a DataFrame read before goes on with its own folders. A write that fails leaves
folders that no manifest names. One writer at a time: a second one for the same version is refused, since its manifest's folder exists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cairn.sources import index

BUCKETS = 64
_MANIFEST = "version long, tag long, bucket int, folder string"


class Versioned:
    """A table at ``path`` with unique keys. Manifests have a row for each bucket that has rows, and one without a folder."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = ("id",)) -> None:
        self.spark, self.path, self.key = spark, path, list(key)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: Sequence[str] = ("id",), buckets: int = BUCKETS) -> Versioned:
        """An empty table; ``buckets`` cannot be changed later."""
        made = cls(spark, path, key)
        spark.createDataFrame([], schema).write.parquet(f"{path}/schema")
        made._publish(0, None, {-1: f"{buckets}"})
        return made

    def _publish(self, version: int, tag: int | None, folders: dict[int, str]) -> None:
        rows = [(version, tag, b, f) for b, f in folders.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v={version}")

    def manifest(self, version: int | None = None) -> tuple[int, int | None, int, dict[int, str]]:
        """Version (the newest), the tag of its write, the number of buckets, and the folder of each: as many rows as buckets."""
        all_ = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        version = all_.agg(F.max("version")).first()[0] if version is None else version
        rows = all_.filter(F.col("version") == version).collect()
        folders = {r.bucket: r.folder for r in rows}
        return version, rows[0].tag, int(folders.pop(-1)), folders

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        paths = [f"{self.path}/{f}/bucket_={b}" for b, f in folders.items()]
        return self.spark.read.schema(schema).parquet(*paths or [f"{self.path}/schema"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        return self._rows(self.manifest(version)[3])

    def write(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], tag: int | None = None) -> int:
        """Puts ``change`` of the rows of all buckets that have one of the keys in their place, and returns the version after it.

        ``change`` must keep rows of other keys as they are. A bucket whose rows stay the same keeps its folder; without any other, there is no new version.
        A write with a tag is not repeated: it does nothing if the newest write has this tag or a later one.
        """
        version, last, buckets, folders = self.manifest()
        if tag is not None and last is not None and tag <= last:
            return version
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int").alias("bucket_")
        touched = [r[0] for r in keys.select(bucket).distinct().collect()]  # as many as buckets at most
        if not touched:
            return version
        old, folder = self._rows({b: f for b, f in folders.items() if b in touched}), f"data/{uuid.uuid4().hex}"
        names = old.columns
        change(old).select(*names, bucket).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(StructType(old.schema.fields).add("bucket_", IntegerType())).parquet(f"{self.path}/{folder}")

        def digest(df: DataFrame) -> dict:
            return {r[0]: (r[1], r[2]) for r in df.groupBy(bucket).agg(F.count("*"), F.bit_xor(F.xxhash64(*names))).collect()}

        before, after = digest(old), digest(made.select(*names))
        changed = [b for b in touched if before.get(b) != after.get(b)]
        if not changed and tag is None:
            return version
        folders = {b: f for b, f in folders.items() if b not in changed} | {b: folder for b in changed if b in after}
        self._publish(version + 1, tag, {**folders, -1: f"{buckets}"})
        return version + 1

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = ("embedding",), tag: int | None = None) -> int:
        """Rows replace those of their key, but a null in ``keep`` leaves the stored value."""
        return self.write(rows.select(*self.key), lambda old: index.upsert(old, rows.select(*old.columns), self.key[0], keep), tag)

    def plant(self, rows: DataFrame, tag: int | None = None) -> int:
        """Inserts or replaces rows."""
        return self.write(rows.select(*self.key), lambda old: index.plant(old, rows.select(*old.columns), self.key), tag)

    def remove(self, keys: DataFrame, tag: int | None = None) -> int:
        """Deletes the rows of the keys."""
        return self.write(keys.select(*self.key), lambda old: index.remove(old, keys.select(*self.key), self.key), tag)

    def unused(self, newest: int = 2) -> list[str]:
        """Folders that only versions before the ``newest`` name: they can be deleted when no reader is on them."""
        all_ = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").filter("bucket >= 0")
        first = self.manifest()[0] - newest + 1
        kept = F.max(F.when(F.col("version") >= first, 1).otherwise(0))
        return sorted(r[0] for r in all_.groupBy("folder").agg(kept.alias("k")).filter("k = 0").select("folder").collect())
