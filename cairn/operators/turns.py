"""The log of turns and citations: idempotent intake, current state, history, context, lineage, safe errors.

``events`` (key columns, seq, kind: begin, complete or fail, value) are the log; keys are (conversation_id, client_message_id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("conversation_id", "client_message_id")
#: Tokens of context; characters of a token. Turns of these states are no context.
BUDGET, CHARS, EXCLUDED = 2000, 4, ("pending", "failed")


def intake(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """the begin events with ``result``: new, in_flight or replay.

    A turn that failed opens again with the next begin; a complete one is replayed; while one is open, others are in flight.
    """
    before = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    done = F.when(F.col("kind") != "begin", F.col("kind"))
    told = events.withColumns({"last": F.last(done, ignorenulls=True).over(before), "era": F.count(done).over(before)})
    told = told.withColumn("nth", F.count(F.when(F.col("kind") == "begin", 1)).over(W.partitionBy(*key, "era").orderBy("seq")))
    result = F.when(F.col("last") == "complete", "replay").when(F.col("nth") == 1, "new").otherwise("in_flight")
    return told.filter("kind = 'begin'").select(*key, "seq", result.alias("result"))


def current(events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """one row a key: status (pending, complete, failed) and the answer, which only a complete turn has.

    The last result decides; a begin after a failure makes the turn pending again. One aggregate, combined before the shuffle.
    """
    done = F.when(F.col("kind") != "begin", F.struct("seq", "kind", "value"))
    folded = events.groupBy(*key).agg(F.max(done).alias("d"), F.max(F.when(F.col("kind") == "begin", F.col("seq"))).alias("b"))
    status = F.when(F.col("d").isNull() | ((F.col("d.kind") == "fail") & (F.col("b") > F.col("d.seq"))), "pending").when(F.col("d.kind") == "fail", "failed").otherwise("complete")
    return folded.select(*key, status.alias("status"), F.when(status == "complete", F.col("d.value")).alias("answer"))


def latest_citations(citations: DataFrame) -> DataFrame:
    """the citations (message_id, completion, ordinal, ...) of each message's latest completion."""
    last = citations.groupBy("message_id").agg(F.max("completion").alias("completion"))
    return citations.join(last, ["message_id", "completion"], "left_semi")


def history(turns: DataFrame, citations: DataFrame) -> DataFrame:
    """turns of every status with position (by seq) and their citations as an array in ordinal order."""
    cited = citations.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "evidence_id"))), lambda x: x["evidence_id"]).alias("citations"))
    position = F.row_number().over(W.partitionBy("conversation_id").orderBy("seq")).cast("long")
    rows = turns.join(cited, "message_id", "left").withColumn("position", position)
    return rows.withColumn("citations", F.coalesce("citations", F.array().cast("array<bigint>")))


def context(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """conversation_id, pos, role, content: the newest messages that fit the budget; the newest one always."""
    ok = turns.filter(~F.col("status").isin(*EXCLUDED) & F.col("answer_text").isNotNull())
    said = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), (2 * F.col("seq")).alias("pos")), F.struct(F.lit("assistant").alias("role"), F.col("answer_text").alias("content"), (2 * F.col("seq") + 1).alias("pos")))
    rows = ok.select("conversation_id", F.explode(said).alias("m")).select("conversation_id", "m.*")
    order = W.partitionBy("conversation_id").orderBy(F.desc("pos"))
    cost = F.greatest(F.lit(1), F.floor(F.length("content") / CHARS))
    rows = rows.withColumns({"used": F.sum(cost).over(order.rowsBetween(W.unboundedPreceding, 0)), "nth": F.row_number().over(order)})
    return rows.filter((F.col("nth") == 1) | (F.col("used") <= budget)).select("conversation_id", "pos", "role", "content")


def citing(citations: DataFrame, messages: DataFrame, document_code: str, version: str) -> DataFrame:
    """the messages that cited a version of a document, in order."""
    ids = citations.filter((F.col("document_code") == document_code) & (F.col("version") == version)).select("message_id").distinct()
    return messages.join(ids, "message_id", "left_semi")


def by_prompt_version(turns: DataFrame) -> DataFrame:
    """answers of each prompt version."""
    return turns.filter("answer_text IS NOT NULL").groupBy("prompt_version").agg(F.count("*").alias("n_answers"))


def safe_errors(failures: DataFrame, table: Mapping[str, tuple[int, str, str]], default: tuple[int, str, str]) -> DataFrame:
    """F8: failures (error_code) with the HTTP status, title and detail that may be told; unknown codes get the default."""
    spark = failures.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in table.items()], "error_code string, http_status int, title string, detail string")
    rows = failures.join(F.broadcast(known), "error_code", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in zip(("http_status", "title", "detail"), default)})
