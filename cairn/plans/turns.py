"""Turn log queries: ``events`` are the log of turns, ``conversations`` the turns, ``lineitem`` the citations of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import turns as T
from cairn.plans import standins as S
from cairn.plans.registry import query
from cairn.sources.scratch import new_dir
from cairn.streaming.log import TurnLog

_LOG = ", log AS (SELECT user_id AS conversation_id, event_id % 3 AS client_message_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'begin' END AS kind, props AS value FROM events)"

ERRORS = {"error": (503, "Service unavailable", "Try again"), "view": (404, "Not found", "No such turn")}
DEFAULT = (500, "Internal error", "The turn could not be completed")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("begin")
    return e.select(F.col("user_id").alias("conversation_id"), (F.col("event_id") % 3).alias("client_message_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("value"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), (F.col("l_linenumber") % 3).alias("completion"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("evidence_id"))


@query(S.sql("turns", _LOG + """, t AS (SELECT *, last_value(CASE WHEN kind <> 'begin' THEN kind END IGNORE NULLS) OVER w AS last, count(CASE WHEN kind <> 'begin' THEN 1 END) OVER w AS era FROM log
 WINDOW w AS (PARTITION BY conversation_id, client_message_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 u AS (SELECT *, count(CASE WHEN kind = 'begin' THEN 1 END) OVER (PARTITION BY conversation_id, client_message_id, era ORDER BY seq) AS nth FROM t)
 SELECT conversation_id, client_message_id, seq, CASE WHEN last = 'complete' THEN 'replay' WHEN nth = 1 THEN 'new' ELSE 'in_flight' END AS result FROM u WHERE kind = 'begin'"""))
def f1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.intake(log(spark, sf_dir))


_CURRENT = S.sql("turns", _LOG + """, g AS (SELECT conversation_id, client_message_id, max(seq) FILTER (kind <> 'begin') AS d, arg_max(kind, seq) FILTER (kind <> 'begin') AS k, arg_max(value, seq) FILTER (kind <> 'begin') AS v, max(seq) FILTER (kind = 'begin') AS b FROM log GROUP BY 1, 2)
 SELECT conversation_id, client_message_id, CASE WHEN d IS NULL OR (k = 'fail' AND b > d) THEN 'pending' WHEN k = 'fail' THEN 'failed' ELSE 'complete' END AS status, CASE WHEN k = 'complete' THEN v END AS answer FROM g""")


@query(_CURRENT)
def f2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.current(log(spark, sf_dir))


@query(_CURRENT)
def f2_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored log, which a stream of the events feeds to its end."""
    e, path = log(spark, sf_dir), new_dir(spark, "log")
    e.write.parquet(f"{path}/in")
    stored = TurnLog(spark, path)
    stored.feed(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return stored.current()


@query("""SELECT l_orderkey AS message_id, l_linenumber % 3 AS completion, l_linenumber AS ordinal, l_partkey AS evidence_id FROM lineitem
 QUALIFY l_linenumber % 3 = max(l_linenumber % 3) OVER (PARTITION BY l_orderkey)""")
def f3_latest_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_citations(citations(spark, sf_dir))


@query("""SELECT o_custkey AS conversation_id, o_orderkey AS message_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderstatus AS status, coalesce(c, '') AS citations FROM orders
 LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def f4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderkey").alias("message_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return T.history(o, citations(spark, sf_dir)).select("conversation_id", "message_id", "position", "status", F.array_join("citations", ",").alias("citations"))


@query(S.sql("turns", """, m AS (SELECT conversation_id, 2 * seq AS pos, 'user' AS role, question AS content FROM turns WHERE answer_text IS NOT NULL UNION ALL SELECT conversation_id, 2 * seq + 1, 'assistant', answer_text FROM turns WHERE answer_text IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos DESC) AS nth, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY conversation_id ORDER BY pos DESC) AS used FROM m)
 SELECT conversation_id, pos, role, content FROM k WHERE nth = 1 OR used <= 200"""))
def f5_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.context(S.turns(spark, sf_dir), budget=200)


@query("""SELECT o_orderkey AS message_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R')""")
def f6_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").cast("string").alias("document_code"), F.col("l_returnflag").alias("version"))
    m = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), "o_custkey")
    return T.citing(c, m, "7", "R")


@query(S.sql("turns", " SELECT 'v' || conversation_id % 4 AS prompt_version, count(*) AS n_answers FROM turns WHERE answer_text IS NOT NULL GROUP BY 1"))
def f7_by_prompt_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.turns(spark, sf_dir)
    return T.by_prompt_version(t.withColumn("prompt_version", F.concat(F.lit("v"), F.col("conversation_id") % 4)))


@query("""SELECT event_id, event_type AS error_code, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 500 END AS http_status,
 CASE event_type WHEN 'error' THEN 'Service unavailable' WHEN 'view' THEN 'Not found' ELSE 'Internal error' END AS title FROM events""")
def f8_safe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("error_code"))
    return T.safe_errors(e, ERRORS, DEFAULT).select("event_id", "error_code", "http_status", "title")


_BREAKER = """WITH RECURSIVE a AS (SELECT user_id AS source, event_id AS id, epoch(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 s AS (SELECT source, 0::BIGINT AS r, NULL::BIGINT AS id, 'closed' AS now, 0::BIGINT AS n, 0.0::DOUBLE AS opened, '' AS state FROM (SELECT DISTINCT source FROM a)
 UNION ALL SELECT source, r, id, after, CASE WHEN shut THEN n WHEN ok THEN 0 ELSE n + 1 END, CASE WHEN NOT shut AND NOT ok AND after = 'open' THEN t ELSE opened END, CASE WHEN shut THEN 'rejected' ELSE after END FROM
  (SELECT *, CASE WHEN shut THEN 'open' WHEN ok THEN 'closed' WHEN now = 'open' OR n + 1 >= 2 THEN 'open' ELSE 'closed' END AS after FROM
   (SELECT a.source, a.r, a.id, a.t, a.ok, s.now, s.n, s.opened, s.now = 'open' AND a.t - s.opened < 3600 AS shut FROM s JOIN a ON a.source = s.source AND a.r = s.r + 1)))
 SELECT source, id, state FROM s WHERE r > 0"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), "ts", (F.col("event_type") != "error").alias("ok"))


@query(_BREAKER)
def s2_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.streaming.jobs import breaker_batch

    return breaker_batch(_attempts(spark, sf_dir), failures=2, reset=3600.0)


@query(_BREAKER)
def s2_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with timers, run to the end of the log."""
    from cairn.streaming.jobs import breaker_of_log

    return breaker_of_log(_attempts(spark, sf_dir), new_dir(spark, "breaker"), failures=2, reset=3600.0)


@query(rf"SELECT doc_id, regexp_matches(text, '{X.EMAIL}') AS has_email FROM documents")
def s3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.streaming.jobs import redacted

    d = redacted(S.table(spark, sf_dir, "documents").select("doc_id", "text"), S.PHONE)
    return d.select("doc_id", F.array_contains("pii_kinds", "email").alias("has_email"))
