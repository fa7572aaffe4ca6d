"""Streaming forms of intake, breaker and redaction; their batch forms are the reference for results."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.functions import text as X

FAILURES, RESET = 5, 30.0


def simple_intake(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """S1, without reopening: the first event of each (conversation, client id) within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["conversation_id", "client_message_id"])


def keep_state_on_disk(spark: SparkSession) -> None:
    """Stateful processors need a state store with column families: a setting of the session, read when a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Intake(StatefulProcessor):
    """The status of a (conversation, client id), and when it was last heard of; a timer of event time forgets a silent one."""

    def __init__(self, expire_ms: int) -> None:
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "status string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, last = self.known.get() if self.known.exists() else ("", 0)
        for row in sorted(rows, key=lambda r: r.seq):
            last = max(last, row.at // 1000)
            if row.kind == "begin":
                result = "replay" if status == "complete" else "in_flight" if status == "pending" else "new"
                status = status if status == "complete" else "pending"
                yield Row(conversation_id=key[0], client_message_id=key[1], seq=row.seq, result=result)
            else:
                status = {"complete": "complete", "fail": "failed"}[row.kind]
        self.known.update((status, last))
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.expire_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists() and self.known.get()[1] + self.expire_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()  # else a later event has set a timer of its own
        return iter(())

    def close(self) -> None:
        pass


def intake(events: DataFrame, delay: str = "1 hour", expire_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Begin events with ``result`` (new, in_flight, replay), state being the status of their key.

    Events (conversation_id, client_message_id, seq, ts, kind) of a key are folded in the order of seq within a batch. A
    failed key opens again. Events without a time, or later than ``delay``, are left out. A key that is silent for
    ``expire_ms`` of event time is forgotten by a timer: that bound is ours.
    """
    keep_state_on_disk(events.sparkSession)
    timed = events.filter("ts IS NOT NULL").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", delay)
    keyed = timed.groupBy("conversation_id", "client_message_id")
    return keyed.transformWithState(_Intake(expire_ms), "conversation_id long, client_message_id long, seq long, result string", "append", "eventtime")


def breaker_steps(ok: Iterable[bool], ts: Iterable[float], state: tuple[str, int, float], failures: int, reset: float) -> tuple[list[str], tuple[str, int, float]]:
    """The breaker's state after each attempt: closed, open or half_open, from (state, failures in a row, time it opened)."""
    now, n, opened = state
    out = []
    for good, t in zip(ok, ts):
        if now == "open" and t - opened >= reset:
            now = "half_open"
        if now == "open":
            out.append("rejected")
            continue
        if good:
            now, n = "closed", 0
        else:
            n += 1
            if now == "half_open" or n >= failures:
                now, opened = "open", t
        out.append(now)
    return out, (now, n, opened)


class _Breaker(StatefulProcessor):
    """The breaker of a source. In order, attempts wait until the watermark has passed them.

    Then a timer after the earliest of them lets through all that no earlier one can come before any more, so that attempts count in the order of their
    time, whatever the order in which they arrive: one row of state and one timer for the attempts of a batch, not one for each attempt. A timer at the end of the wait half-opens an open breaker; one after a long silence forgets the source.
    """

    def __init__(self, failures: int, reset: float, in_order: bool, expire_ms: int) -> None:
        self.failures, self.reset, self.in_order, self.expire_ms = failures, reset, in_order, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, n long, opened double, last long")
        self.pending = handle.getListState("pending", "at array<long>, id array<long>, ok array<boolean>")  # a row for the attempts of a batch

    def step(self, key: tuple, due: list[tuple]) -> Iterator[Row]:
        """The attempts (at, id, ok) in their order, and the timers that follow from them."""
        due = sorted(due, key=lambda r: (r[0], r[1] is None, r[1] or 0))
        state, n, opened, last = self.now.get() if self.now.exists() else ("closed", 0, 0.0, 0)
        out, (state, n, opened) = breaker_steps([r[2] for r in due], [r[0] / 1e6 for r in due], (state, n, opened), self.failures, self.reset)
        last = max(last, due[-1][0] // 1000)
        self.now.update((state, n, opened, last))
        self.handle.registerTimer(last + self.expire_ms)
        if state == "open":
            self.handle.registerTimer(math.ceil(1000 * (opened + self.reset)))
        for row, after in zip(due, out):
            yield Row(source=key[0], id=row[1], state=after)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.at, r.id, r.ok) for r in rows]
        if not self.in_order:
            yield from self.step(key, came)
            return
        if came:
            self.pending.appendValue(tuple(map(list, zip(*came))))
            self.handle.registerTimer(min(row[0] for row in came) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = [row for packed in self.pending.get() for row in zip(*packed)] if self.pending.exists() else []
        due = [r for r in waiting if r[0] // 1000 < passed]
        if due:
            left = [r for r in waiting if r[0] // 1000 >= passed]
            if left:
                self.pending.put([tuple(map(list, zip(*left)))])
                self.handle.registerTimer(min(row[0] for row in left) // 1000 + 1)
            else:
                self.pending.clear()
            yield from self.step(key, due)
        elif self.now.exists():
            state, n, opened, last = self.now.get()
            if not waiting and last + self.expire_ms <= passed:
                self.now.clear()
            elif state == "open" and passed / 1000 - opened >= self.reset:
                self.now.update(("half_open", n, opened, last))

    def close(self) -> None:
        pass


def breaker(attempts: DataFrame, failures: int = FAILURES, reset: float = RESET, delay: str = "1 hour", in_order: bool = False, expire_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """The breaker of each source after each attempt (source, id, ts, ok), in the order of ts and id within a batch.

    After ``reset`` seconds of event time an open breaker lets one attempt through, which closes or opens it again. ``in_order``:
    an attempt counts, and its row comes, when the watermark has passed it, so that the order holds across batches too. Attempts
    without a time, or later than ``delay``, are left out. A source that is silent for ``expire_ms`` of event time starts anew.
    """
    keep_state_on_disk(attempts.sparkSession)
    timed = attempts.filter("ts IS NOT NULL").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", delay)
    return timed.groupBy("source").transformWithState(_Breaker(failures, reset, in_order, expire_ms), "source long, id long, state string", "append", "eventtime")


def breaker_of_log(attempts: DataFrame, path: str, failures: int = FAILURES, reset: float = RESET) -> DataFrame:
    """S2 over a finished log, as a stream to its end: an attempt of no one, after all others, lets the watermark pass them."""
    spark, delay = attempts.sparkSession, "1 second"
    own = attempts.select(F.col("source").cast("long").alias("source"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "ok")
    own.withColumn("log", F.lit(True)).write.parquet(f"{path}/in")
    end = F.timestamp_seconds(F.max(F.unix_seconds("ts")) + 60)
    own.agg(end.alias("ts")).filter("ts IS NOT NULL").selectExpr("CAST(NULL AS LONG) AS source", "CAST(NULL AS LONG) AS id", "ts", "false AS ok", "false AS log").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("source long, id long, ts timestamp, ok boolean, log boolean").parquet(f"{path}/in")
    job = breaker(stream, failures, reset, delay, in_order=True).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("source long, id long, state string").parquet(f"{path}/out")


def breaker_batch(attempts: DataFrame, failures: int = FAILURES, reset: float = RESET) -> DataFrame:
    """The same over a finished log. Attempts of a source are one state machine, which no aggregate can express.

    Attempts are dealt by source and sorted within partitions; a task streams over them with the state of one source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), ("closed", 0, 0.0)
        for batch in batches:
            seconds = [t / 1e6 for t in batch.column(2).cast(pa.int64()).fill_null(-(2**63)).to_pylist()]
            out: list[str] = []
            for source, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), seconds), key=itemgetter(0)):
                if source != now:
                    now, state = source, ("closed", 0, 0.0)
                _, ok, ts = zip(*rows)
                steps, state = breaker_steps(ok, ts, state, failures, reset)
                out += steps
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["source", "id", "state"])

    own = attempts.select(F.col("source").cast("long").alias("source"), F.col("id").cast("long").alias("id"), "ts", "ok")
    dealt = own.repartition("source").sortWithinPartitions("source", F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    return dealt.mapInArrow(run, "source long, id long, state string")


def redacted(texts: DataFrame, phone: str = X.PHONE_BR) -> DataFrame:
    """S3: texts masked and flagged as they come; the same columns as in batch."""
    return texts.withColumns({"pii_kinds": X.pii_kinds(F.col("text"), phone), "text": X.redact(F.col("text"), phone)})
