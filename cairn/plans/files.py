"""Queries over files that are written first from the given tables, then read by the engine's readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import retrieval as R
from cairn.plans import metrics as PM
from cairn.plans import standins as S
from cairn.plans import turns as PT
from cairn.plans.registry import query
from cairn.sources import index, readers
from cairn.sources.scratch import new_dir
from cairn.streaming import jobs


_RUNS = f"""WITH {PM._REC}, {PM._CHK} SELECT r.case_id, r.run, count(*) AS n_records, sum(prompt_tokens)::BIGINT AS prompt_tokens, count(*) FILTER (provider = 'live') AS n_live, coalesce(max(c.n), 0) AS n_checks, coalesce(max(c.k), 0) AS n_passed
 FROM rec r LEFT JOIN (SELECT case_id, run, count(*) AS n, count(*) FILTER (passed) AS k FROM chk GROUP BY 1, 2) c ON c.case_id = r.case_id AND c.run = r.run GROUP BY r.case_id, r.run"""


def _write_runs(spark: SparkSession, sf_dir: str) -> str:
    """Run logs, a line for each record of orders with its checks of line items."""
    li = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.struct(F.element_at(F.array(*map(F.lit, PM.NAMES)), F.col("l_linenumber")).alias("name"), (F.col("l_quantity") > 3).alias("passed"))).alias("checks")
    )
    meta = F.struct("provider", F.col("latency_ms").cast("int").alias("latency_ms"), F.struct(F.col("prompt_tokens").cast("int").alias("prompt_tokens")).alias("usage"), "degraded")
    record = F.struct(F.col("case_id").cast("string").alias("case_id"), "grade", F.col("run").cast("int").alias("run"), "outcome", meta.alias("meta"), "checks")
    runs = PM.records(spark, sf_dir).join(li, "id", "left").select(F.col("run").cast("int").alias("run"), F.array(record).alias("records"))
    path = new_dir(spark, "runs")
    index.write_result(runs, path)
    return path


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("case_id").cast("long").alias("case_id"), F.col("run").cast("long").alias("run")).agg(
        F.count("*").alias("n_records"), F.sum("meta.usage.prompt_tokens").alias("prompt_tokens"), F.count_if(F.col("meta.provider") == "live").alias("n_live"),
        F.sum(F.coalesce(F.array_size("checks"), F.lit(0))).alias("n_checks"), F.sum(F.coalesce(F.array_size(F.filter("checks", lambda c: c["passed"])), F.lit(0))).alias("n_passed"),
    )


@query(_RUNS)
def a5_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs read back and added up."""
    return _added_up(index.read_runs(spark, _write_runs(spark, sf_dir), lines=True))


@query(_RUNS)
def a5_run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs as a stream of lines, to its end, in ranges of bytes."""
    path = new_dir(spark, "runlog")
    job = readers.stream_run_lines(spark, _write_runs(spark, sf_dir)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return _added_up(spark.read.parquet(f"{path}/out"))


#: Pages of documents in files by source and a part of the ids; a page's text stands right after its mark.
_PAGED = """SELECT source AS doc, part, row_number() OVER (PARTITION BY source, part ORDER BY doc_id) AS page, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text
 FROM (SELECT source, doc_id, doc_id % 16 AS part, string_split(text || chr(10), chr(10)) AS l FROM documents)"""


def _write_pages(spark: SparkSession, sf_dir: str) -> str:
    d = S.table(spark, sf_dir, "documents").select("source", F.pmod("doc_id", F.lit(16)).alias("part"), "doc_id", F.concat(F.lit("===== PAGE 1 ====="), "text").alias("value"))
    path = new_dir(spark, "pages")
    d.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").drop("doc_id").write.partitionBy("source", "part").text(path)
    return path


def _paged(rows: DataFrame) -> DataFrame:
    """Doc and part are in the folder's name."""
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]+)/", 1)
    return rows.filter("page > 0").select(part("source").alias("doc"), part("part").cast("long").alias("part"), "page", "line_no", "text")


@query(_PAGED)
def a1_paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-marked files of documents in ranges of 64 KB, so that pages and lines are placed across ranges at any scale."""
    return _paged(readers.read_pages(spark, _write_pages(spark, sf_dir), 1 << 16))


@query(_PAGED)
def a1_paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, to its end."""
    path = new_dir(spark, "paged")
    job = readers.stream_pages(spark, _write_pages(spark, sf_dir)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return _paged(spark.read.parquet(f"{path}/out"))


@query("""SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_contain, CASE WHEN doc_id % 2 = 1 THEN 'src1' ELSE '' END AS cite, CASE WHEN doc_id % 4 = 0 THEN TRUE WHEN doc_id % 4 = 2 THEN FALSE END AS refusal,
 sha256(text) AS answer_sha256 FROM documents""")
def a6_case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of documents, a line each; keys that a case lacks are not written and come back as null."""
    k = F.col("doc_id")
    words = lambda *w: F.array(*map(F.lit, w))
    cases = S.table(spark, sf_dir, "documents").select(
        k.cast("string").alias("id"), F.col("text").alias("resposta_esperada"), F.when(k % 2 == 0, words(" the ", " of ")).alias("must_contain"),
        F.when(k % 2 == 1, words("src1")).alias("must_cite"), F.when(k % 2 == 0, k % 4 == 0).alias("must_be_refusal"),
    )
    path = new_dir(spark, "cases")
    index.write_result(cases, path)
    return index.read_cases(spark, path, lines=True).select(
        F.col("id").cast("long").alias("case_id"), F.coalesce(F.array_size("must_contain"), F.lit(0)).alias("n_contain"), F.coalesce(F.array_join("must_cite", ","), F.lit("")).alias("cite"),
        F.col("must_be_refusal").alias("refusal"), F.sha2("resposta_esperada", 256).alias("answer_sha256"),
    )


@query("SELECT c_mktsegment AS name, count(*) AS n, count(*) FILTER (c_acctbal >= t) AS n_above FROM customer JOIN (SELECT c_mktsegment AS m, round(avg(c_acctbal), 2) AS t FROM customer GROUP BY 1) ON m = c_mktsegment GROUP BY 1")
def a7_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold file with the mean balance of each segment, then accounts held against it."""
    c = S.table(spark, sf_dir, "customer")
    line = F.concat("c_mktsegment", F.lit(": "), F.format_string("%.2f", F.round(F.avg("c_acctbal"), 2)), F.lit("  # mean"))
    path = new_dir(spark, "thresholds")
    c.groupBy("c_mktsegment").agg(line.alias("value")).select("value").write.text(path)
    t = index.read_thresholds(spark, path)
    return c.join(t, F.col("c_mktsegment") == F.col("name")).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= F.col("value")).alias("n_above"))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) ELSE vec_id % 10 END AS total,
 len(embedding)::INT AS dim FROM embeddings""")
def a8_a10_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors is appended to a cache and read back; what it misses is encoded, in batches, and joined to it."""
    e = S.table(spark, sf_dir, "embeddings")
    texts = e.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("text"))
    key = R.cache_key(F.lit("own"), F.col("vec_id").cast("string"))
    path = new_dir(spark, "cache")
    index.append_cache(e.filter("vec_id % 3 = 0").select(key.alias("key"), F.lit("own").alias("model"), index.encode_vector("embedding").alias("vector")), path)
    index.append_cache(e.filter("vec_id % 3 = 1").select(key.alias("key"), F.lit("other").alias("model"), index.encode_vector("embedding").alias("vector")), path)
    encode = lambda batch: [[int(x) % 10] + [0] * 63 for x in batch]
    found = R.fill(texts, index.read_cache(spark, path, "own", 64), "own", encode, 64)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select("id", F.round(total, 4).alias("total"), F.size("vector").alias("dim"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a13_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result is written twice and read back: the second write replaces the first."""
    n = S.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    path = new_dir(spark, "result")
    for _ in range(2):
        index.write_result(n, path, "parquet")
    return spark.read.parquet(path)


@query(S.sql("turns", PT._LOG + """, t AS (SELECT *, last_value(CASE WHEN kind <> 'begin' THEN kind END IGNORE NULLS) OVER w AS last, count(CASE WHEN kind <> 'begin' THEN 1 END) OVER w AS era FROM log
 WINDOW w AS (PARTITION BY conversation_id, client_message_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 u AS (SELECT *, count(CASE WHEN kind = 'begin' THEN 1 END) OVER (PARTITION BY conversation_id, client_message_id, era ORDER BY seq) AS nth FROM t)
 SELECT conversation_id, client_message_id, seq, CASE WHEN last = 'complete' THEN 'replay' WHEN nth = 1 THEN 'new' ELSE 'in_flight' END AS result FROM u WHERE kind = 'begin'"""))
def s1_stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of turns taken in as a stream, to its end; results go to a file sink with its own checkpoint."""
    e = S.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events*.parquet")  # a pattern may name a file
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("begin")
    log = stream.select(F.col("user_id").alias("conversation_id"), (F.col("event_id") % 3).alias("client_message_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    path = new_dir(spark, "intake")
    job = jobs.intake(log).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out")
