"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.sources.scratch import new_dir

#: Words: maximal runs of anything but a space and the ASCII controls tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most.
ARROW_ROWS = 1000


class Scratch:
    """Intermediate tables of one job: written once, read back without lineage, dropped when no longer needed."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = new_dir(spark, label)
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of plans that have been written and are out of use.

        The cleaner acts when the driver collects its garbage, which a driver with little to do seldom does.
        """
        gc.collect()  # Python's handles of those plans first
        if jvm := getattr(self.spark, "_jvm", None):
            jvm.System.gc()

    def drop(self, name: str) -> None:
        """Frees a table which no DataFrame still in use reads: an empty one takes its place."""
        self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Frees all tables but the named ones, which a result still reads."""
        for name in self.names - set(names):
            self.drop(name)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, batch_mb: int | None = None) -> DataFrame:
    """``mapInArrow`` in batches of ARROW_ROWS rows at most, so that long texts do not fill an executor; a task gives its free memory back.

    ``batch_mb`` bounds batches of large rows by size, too. Both bounds are settings of the session, which are lowered where they are higher.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    if batch_mb:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{batch_mb}m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task makes of a batch stays small too."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text) -> "F.Column":
    """All words of a text as an array; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPACE_WORD), 0), F.array().cast("array<string>"))
