from datetime import datetime, timedelta

from cairn.operators import turns
from cairn.streaming import jobs

EVENT = "conversation_id long, client_message_id long, seq long, ts timestamp, kind string"


def run(spark, df, make, name):
    path = f"/tmp/spark-stream-{name}-{id(df)}"
    df.write.mode("overwrite").parquet(path)
    q = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_intake_equals_its_batch_form(spark):
    kinds = ["begin", "begin", "fail", "begin", "complete", "begin"]
    rows = [(c, 0, 10 * c + i, datetime(2024, 1, 1) + timedelta(seconds=i), k) for c in range(3) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, EVENT)
    got = run(spark, df, jobs.intake, "intake_out")
    expected = turns.intake(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert [r.result for r in got.filter("conversation_id = 0").orderBy("seq").collect()] == ["new", "in_flight", "new", "replay"]


def test_breaker_opens_probes_and_closes(spark):
    ok, at = [False, False, True, True, False], [0, 1, 2, 40, 41]
    rows = [(1, i, datetime(2024, 1, 1) + timedelta(seconds=t), o) for i, (o, t) in enumerate(zip(ok, at))]
    df = spark.createDataFrame(rows, "source long, id long, ts timestamp, ok boolean")
    batch = jobs.breaker_batch(df, 2).orderBy("id").collect()
    assert [r.state for r in batch] == ["closed", "open", "rejected", "closed", "closed"]
    got = run(spark, df, lambda s: jobs.breaker(s, 2), "breaker_out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch))


def test_breaker_streams_over_the_attempts_of_a_source(spark, monkeypatch):
    rows = [(s, 100 * k + i, datetime(2024, 1, 1) + timedelta(seconds=7 * (37 * i % 40)), i % 5 == k) for k, s in enumerate((1, 2, None)) for i in range(40)]
    df = spark.createDataFrame(rows, "source long, id long, ts timestamp, ok boolean")
    expected, steps = [], jobs.breaker_steps
    for source in (1, 2, None):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[1]))
        out, _ = steps([r[3] for r in own], [r[2].timestamp() for r in own], ("closed", 0, 0.0), 2, 20.0)
        expected += [(source, r[1], s) for r, s in zip(own, out)]

    def bounded(ok, *rest):
        assert len(ok) <= 3
        return steps(ok, *rest)

    monkeypatch.setattr(jobs, "breaker_steps", bounded)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        got = [tuple(r) for r in jobs.breaker_batch(df, 2, 20.0).collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(got, key=lambda r: r[1]) == sorted(expected, key=lambda r: r[1]) and {r[2] for r in got} == {"closed", "open", "rejected"}


def test_redaction_is_the_same_on_a_stream(spark):
    df = spark.createDataFrame([(1, "a.b@c.com"), (2, "x")], "id int, text string")
    got = run(spark, df, jobs.redacted, "redacted_out")
    assert sorted((r.id, r.text, tuple(r.pii_kinds)) for r in got.collect()) == [(1, "[EMAIL]", ("email",)), (2, "x", ())]


def test_intake_goes_on_from_its_checkpoint(spark, tmp_path):
    at = lambda i: datetime(2024, 1, 1) + timedelta(seconds=i)
    parts = [[(1, 0, 0, at(0), "begin"), (1, 0, 1, at(1), "complete")], [(1, 0, 2, at(2), "begin"), (2, 0, 3, at(3), "begin")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        job = jobs.intake(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        job.awaitTermination(120)
    got = {(r.conversation_id, r.seq): r.result for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 0): "new", (1, 2): "replay", (2, 3): "new"}


def attempts(spark, rows, path):
    spark.createDataFrame(rows, "source long, id long, ts timestamp, ok boolean").coalesce(1).write.mode("append").parquet(path)


def advance(spark, tmp_path, **options):
    """What has come so far, and all rows given out since the start."""
    stream = spark.readStream.schema("source long, id long, ts timestamp, ok boolean").parquet(f"{tmp_path}/in")
    job = jobs.breaker(stream, 2, 20.0, "10 seconds", True, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination(120)
    return {(r.source, r.id): r.state for r in spark.read.schema("source long, id long, state string").parquet(f"{tmp_path}/out").collect()}


def test_breaker_in_order_across_batches_restarts_and_late_rows(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    first = [(1, 1, at(5), False), (1, 0, at(0), False), (2, 7, at(3), True)]
    attempts(spark, first, f"{tmp_path}/in")
    assert advance(spark, tmp_path) == {}  # nothing is certain before the watermark
    second = [(1, 2, at(2), False), (1, 3, at(26), True), (1, 4, at(30), False), (2, 8, at(40), False)]
    attempts(spark, second, f"{tmp_path}/in")  # from the checkpoint; id 2 comes after id 1 and counts before it
    got = advance(spark, tmp_path)
    assert got == {(1, 0): "closed", (1, 2): "open", (1, 1): "rejected", (1, 3): "closed", (2, 7): "closed"}
    attempts(spark, [(1, 5, at(1), False), (9, 9, at(100), True)], f"{tmp_path}/in")  # id 5 is too late
    got = advance(spark, tmp_path)
    kept = spark.createDataFrame(first + second, "source long, id long, ts timestamp, ok boolean")
    assert got == {(r.source, r.id): r.state for r in jobs.breaker_batch(kept, 2, 20.0).collect()}
    assert advance(spark, tmp_path) == got  # a run without news adds nothing


def test_silent_sources_are_forgotten_by_a_timer(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    attempts(spark, [(1, 0, at(0), False), (9, 90, at(30), True)], f"{tmp_path}/in")
    assert advance(spark, tmp_path, expire_ms=60_000) == {(1, 0): "closed"}
    attempts(spark, [(9, 91, at(200), True)], f"{tmp_path}/in")
    advance(spark, tmp_path, expire_ms=60_000)
    attempts(spark, [(1, 1, at(201), False), (9, 92, at(300), True)], f"{tmp_path}/in")
    assert advance(spark, tmp_path, expire_ms=60_000)[1, 1] == "closed"  # the second failure in a row, were the first not forgotten


def test_log_as_a_stream_equals_its_batch_form(spark, tmp_path):
    rows = [(s, 50 * s + i, datetime(2024, 1, 1) + timedelta(milliseconds=7777 * (17 * i % 50)), (i + s) % 3 == 0) for s in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "source long, id long, ts timestamp, ok boolean")
    got = jobs.breaker_of_log(df, f"{tmp_path}/log", 2, 20.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.breaker_batch(df, 2, 20.0).collect()))
    assert jobs.breaker_of_log(df.limit(0), f"{tmp_path}/none").count() == 0


def test_intake_forgets_silent_keys(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    parts = [[(1, 0, 0, at(0), "begin"), (1, 0, 1, at(1), "complete")], [(2, 0, 2, at(500), "begin")], [(1, 0, 3, at(501), "begin"), (3, 0, 4, at(2), "begin")]]
    for rows in parts:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        job = jobs.intake(stream, "10 seconds", 60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        job.awaitTermination(120)
    got = {(r.conversation_id, r.seq): r.result for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 0): "new", (2, 2): "new", (1, 3): "new"}  # the row of conversation 3 came too late


class _Handle:
    """The states and timers that a processor asks for, counted."""

    class State:
        def __init__(self):
            self.rows, self.writes = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return self.rows

        def put(self, rows):
            self.rows, self.writes = list(rows), self.writes + 1

        def appendValue(self, row):
            self.put([*self.rows, row])

        def appendList(self, rows):
            self.put([*self.rows, *rows])

        def clear(self):
            self.rows = []

    def __init__(self):
        self.timers, self.list = set(), self.State()

    def getValueState(self, *_):
        return self.State()

    def getListState(self, *_):
        return self.list

    def registerTimer(self, at):
        self.timers.add(at)


def test_attempts_of_a_batch_take_one_timer_and_one_write():
    handle, breaker = _Handle(), jobs._Breaker(2, 20.0, True, 1000)
    breaker.init(handle)
    rows = [type("Attempt", (), {"at": 1_000_000 * i, "id": i, "ok": True}) for i in range(50, 0, -1)]
    assert list(breaker.handleInputRows((1,), iter(rows), None)) == []
    assert handle.timers == {1001} and handle.list.writes == 1
