"""Where jobs keep tables that several executors read: one folder, which the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a folder of its own; a real cluster is refused, since a
    machine-local folder is not visible to the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own for one job."""
    return f"{shared_dir(spark)}/cairn-{label}-{uuid.uuid4().hex}"


#: Session setting: shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once and read back; the shuffle files that the writing needed go when it ends."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
