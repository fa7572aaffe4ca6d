from pyspark.sql import functions as F

from cairn.operators import ingest, probe
from cairn.operators import retrieval as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_stored_key_is_never_missed_and_few_others_pass(spark):
    keys = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    made = probe.key_filter(keys)
    assert probe.probed(keys, made).filter("NOT maybe").count() == 0
    others = spark.range(100_000, 200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    assert probe.probed(others, made).filter("maybe").count() < 1000  # of 100,000
    assert made[0].count() <= made[1] == 1250


def test_split_is_that_of_the_plain_joins(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "", None, "c", "d", "d", None])], "id long, text string")
    key = R.cache_key(F.lit("m"), F.col("text")).alias("key")
    for held in (["a", "c", "zz", None], [], ["a", "b", "", None, "c", "d"]):
        cache = spark.createDataFrame([(t,) for t in held], "text string").select(key, F.array(F.lit(1.0)).alias("vector"))
        want = R.cache_split(texts, cache, "m")
        for most in (probe.MOST_BLOCKS, 0):  # with the filters, and beyond their bound
            hits, misses, met = probe.probed_split(texts, cache, "m", most)
            assert rows(hits) == rows(want[0]) and rows(misses) == rows(want[1])
            met = met.first()
            assert met.n_texts == 9 and met.n_cache == len(held) and met.n_maybe >= hits.count()
            assert most or met.n_maybe == 9


def test_null_keys_and_clashing_columns(spark):
    some = spark.createDataFrame([(None, 1, 2), ("x", 3, 4), ("y", 5, 6)], "key string, block int, w0 int")
    made = probe.key_filter(some.filter("key = 'x' OR key IS NULL"))
    assert rows(probe.probed(some, made).select("key", "maybe")) == [("x", True), ("y", False), (None, False)]
    assert probe.probed(some, made).columns == ["key", "block", "w0", "maybe"]


def test_the_probe_does_not_shuffle_its_rows(spark, tmp_path):
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"))
    keys.write.parquet(str(tmp_path / "k"))
    stored = spark.read.parquet(str(tmp_path / "k"))
    table, blocks = probe.key_filter(stored)
    table.write.parquet(str(tmp_path / "f"))
    plan = probe.probed(stored, (spark.read.parquet(str(tmp_path / "f")), blocks))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_report_of_what_is_written(spark, tmp_path):
    s = "document_code string, version string, contains_pii boolean, superseded boolean, text string"
    chunks = spark.createDataFrame([("a", "1", True, None, "x"), ("a", "1", False, True, None), ("b", None, None, False, ""), (None, "2", True, True, "y")], s)
    got = ingest.write_chunks(chunks, str(tmp_path / "c"))
    assert rows(got) == rows(ingest.report(chunks))
    assert rows(spark.read.parquet(str(tmp_path / "c"))) == rows(chunks)
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "text" not in scan.split("ReadSchema")[1]
    assert rows(ingest.write_chunks(chunks.limit(0), str(tmp_path / "e"))) == [(None, None, 0, 0, 0)]
