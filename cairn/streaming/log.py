"""The log of turns as stored tables, fed by a stream whose batches can be repeated without a trace."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import turns
from cairn.sources.versioned import Versioned

#: What is stored of a key: its last result, and the last begin. Newer events are merged by taking the larger of each.
_STATE = "conversation_id long, client_message_id long, d struct<seq: long, kind: string, value: string>, b long"


class TurnLog:
    """Events, a folder for each batch, and the state of each key, a versioned table, whose version has the number of its batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path
        self.state = Versioned(spark, f"{path}/state", turns.KEY)
        try:
            self.state.manifest()
        except AnalysisException:  # nothing is stored yet
            Versioned.create(spark, f"{path}/state", spark.createDataFrame([], _STATE).schema, turns.KEY, buckets)

    def store(self, batch: DataFrame, number: int) -> None:
        """Stores a batch of events (key, seq, kind, value) under its number. A batch that is stored is not stored again;
        one that failed on the way is: its events first, over what may be left of them, then the state.
        """
        batch.write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")
        events = self.spark.read.schema(batch.schema).parquet(f"{self.path}/events/batch={number}")
        done = F.when(F.col("kind") != "begin", F.struct("seq", "kind", "value"))
        came = events.groupBy(*turns.KEY).agg(F.max(done).alias("d"), F.max(F.when(F.col("kind") == "begin", F.col("seq"))).alias("b"))

        def merged(old: DataFrame) -> DataFrame:
            return old.unionByName(came).groupBy(*turns.KEY).agg(F.max("d").alias("d"), F.max("b").alias("b"))

        self.state.write(came.select(*turns.KEY), merged, tag=number)

    def feed(self, events: DataFrame, checkpoint: str):
        """A stream into the log, to the end of what is there."""
        writer = events.writeStream.foreachBatch(self.store).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events").drop("batch")

    def current(self) -> DataFrame:
        """one row a key, from the stored state."""
        s = self.state.read()
        status = F.when(F.col("d").isNull() | ((F.col("d.kind") == "fail") & (F.col("b") > F.col("d.seq"))), "pending").when(F.col("d.kind") == "fail", "failed").otherwise("complete")
        return s.select(*turns.KEY, status.alias("status"), F.when(status == "complete", F.col("d.value")).alias("answer"))

    def intake(self) -> DataFrame:
        """the begin events with their results, over all stored events."""
        return turns.intake(self.events())
