"""Stored tables whose writes are one step, and the log of turns on top of them."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import turns
from cairn.sources.versioned import Versioned
from cairn.streaming.log import TurnLog

ROW = "id long, text string, embedding array<double>"
EVENT = "conversation_id long, client_message_id long, seq long, kind string, value string"


def rows(df):
    return sorted(map(str, df.collect()))


def made(spark, path, n=40, buckets=8):
    first = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text"), F.array(F.col("id").cast("double")).alias("embedding"))
    t = Versioned.create(spark, path, spark.createDataFrame([], ROW).schema, buckets=buckets)
    assert t.plant(first) == 1
    return t, first


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    t, first = made(spark, f"{tmp_path}/t")
    before, old = t.manifest()[3], t.read()
    change = spark.createDataFrame([(3, "new", None), (1000, "more", [1.0])], ROW)
    assert t.upsert(change) == 2
    after = t.manifest()[3]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    assert rows(old) == rows(first)  # read before the write: its own version
    got = {r.id: (r.text, r.embedding) for r in t.read().collect()}
    assert len(got) == 41 and got[3] == ("new", [3.0]) and got[1000] == ("more", [1.0]) and got[4] == ("t4", [4.0])
    assert rows(t.read(1)) == rows(first) and t.read(0).count() == 0


def test_a_repeated_write_changes_nothing(spark, tmp_path):
    t, first = made(spark, f"{tmp_path}/t")
    assert t.plant(first) == 1 and t.upsert(first.filter("id < 5")) == 1 and t.remove(spark.createDataFrame([(77,)], "id long")) == 1
    assert t.upsert(first.limit(0)) == 1 and len(t.manifest()[3]) <= 8
    assert t.remove(first.select("id")) == 2 and t.read().count() == 0 and t.manifest()[3] == {}
    assert t.plant(first) == 3 and rows(t.read()) == rows(first)
    assert len(t.unused(1)) >= 1 and not set(t.unused(1)) & set(t.manifest()[3].values())


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    t, first = made(spark, f"{tmp_path}/t")
    broken = lambda old: old.withColumn("text", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("half"))
    with pytest.raises(Exception, match="lost"):
        t.write(first.select("id"), broken)
    assert t.manifest()[0] == 1 and rows(t.read()) == rows(first)
    with pytest.raises(Exception):
        t._publish(1, None, {-1: "8"})  # a second writer of a version that is there
    assert rows(t.read()) == rows(first)


def test_a_reader_during_a_write_sees_one_version(spark, tmp_path):
    t, first = made(spark, f"{tmp_path}/t")
    seen = []

    def change(old):
        seen.append(rows(Versioned(spark, f"{tmp_path}/t").read()))
        return old.withColumn("text", F.lit("x"))

    publish = t._publish
    t._publish = lambda *a: (seen.append(rows(Versioned(spark, f"{tmp_path}/t").read())), publish(*a))
    assert t.write(first.select("id"), change) == 2
    assert seen == [rows(first)] * 2 and {r.text for r in t.read().collect()} == {"x"}


def events(spark, *some):
    return spark.createDataFrame(list(some), EVENT)


def test_a_replayed_batch_leaves_the_same_log(spark, tmp_path):
    log = TurnLog(spark, f"{tmp_path}/log", buckets=4)
    a = events(spark, (1, 0, 0, "begin", None), (1, 0, 1, "fail", "e"), (2, 0, 2, "begin", None))
    b = events(spark, (1, 0, 3, "begin", None), (2, 0, 4, "complete", "done"), (3, 1, 5, "begin", None))
    log.store(a, 0)
    log.store(b, 1)
    state, known = rows(log.current()), rows(log.events())
    assert state == rows(turns.current(a.unionByName(b))) and rows(log.intake()) == rows(turns.intake(a.unionByName(b)))
    again = TurnLog(spark, f"{tmp_path}/log")  # after a restart
    again.store(b, 1)
    again.store(a, 0)
    assert rows(again.current()) == state and rows(again.events()) == known


def test_a_batch_that_failed_half_way_is_finished_by_its_replay(spark, tmp_path, monkeypatch):
    log = TurnLog(spark, f"{tmp_path}/log", buckets=4)
    a, b = events(spark, (1, 0, 0, "begin", None), (2, 0, 1, "begin", None)), events(spark, (1, 0, 2, "complete", "x"))
    log.store(a, 0)
    publish = log.state._publish
    monkeypatch.setattr(log.state, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.store(b, 1)
    assert rows(log.current()) == rows(turns.current(a))  # events are there, the state is the old one
    monkeypatch.setattr(log.state, "_publish", publish)
    log.store(b, 1)
    assert rows(log.current()) == rows(turns.current(a.unionByName(b))) and log.events().count() == 3


def test_the_log_goes_on_from_its_checkpoint(spark, tmp_path):
    log, parts = TurnLog(spark, f"{tmp_path}/log", buckets=4), []
    for k in range(3):
        parts.append(events(spark, (1, 0, 2 * k, "begin", None), (1, 0, 2 * k + 1, "fail" if k < 2 else "complete", f"{k}"), (k, 5, 10 + k, "begin", None)))
        parts[-1].write.mode("append").parquet(f"{tmp_path}/in")
        job = log.feed(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
        assert job.awaitTermination(120)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(log.current()) == rows(turns.current(whole)) and rows(log.intake()) == rows(turns.intake(whole))
