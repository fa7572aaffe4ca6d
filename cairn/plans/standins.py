"""The engine's input tables, made from the driver's: the same rules as DataFrames and as SQL.

Tables of the engine that the driver does not have are derived by fixed rules, so that every query's work grows with the
given data: documents become lines and chunks, orders become claims, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.sources.index import read_thresholds
from cairn.sources.scratch import new_dir

#: Phones in the driver's texts; heading rule for texts without numbered headings: a short line.
PHONE = r"\+1 \([0-9]{3}\) 555-[0-9]{4}"
HEADING_MOST = 30
PRODUCTS = {"en": "All", "de": "Auto", "fr": "Residencial", "es": "Empresarial"}
ROLES = ("normative", "minutes", "pointer", "glossary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, line_no, text."""
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return own.select("doc", "page", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document_code, section, version, effective_date, product, doc_role, superseded, contains_pii, text."""
    d = table(spark, sf_dir, "documents")
    product = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in PRODUCTS.items()), F.lit("All"))
    step = F.pmod("doc_id", F.lit(3)).cast("int")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("document_code"), F.concat(F.lit("part "), F.pmod("doc_id", F.lit(7))).alias("section"),
        step.cast("string").alias("version"), F.date_add(F.lit("2024-01-01").cast("date"), step * 30).alias("effective_date"), product.alias("product"),
        pick(F.col("doc_id"), ROLES).alias("doc_role"), (F.pmod("doc_id", F.lit(5)) == 4).alias("superseded"),
        (F.col("text").rlike(X.EMAIL) | F.col("text").rlike(PHONE)).alias("contains_pii"), "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("policy_id"), F.concat(F.lit("AP-AUTO-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("policy_number"), F.col("c_mktsegment").alias("product"), F.col("c_acctbal").alias("annual_premium"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.lit("SIN-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad(F.pmod("o_orderkey", F.lit(1000000)).cast("string"), 6, "0"))
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("policy_id"), number.alias("claim_number"), F.col("o_orderpriority").alias("claim_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("occurrence_date"), F.col("o_totalprice").alias("claim_amount"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return p.select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("payment_no"), F.col("l_extendedprice").alias("paid_amount"),
        F.col("l_shipdate").cast("date").alias("payment_date"), F.col("l_linestatus").alias("payment_type"),
    )


STATUSES = ("answered", "refused", "needs_clarification", "pending", "failed")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn after it: conversation_id, seq, question, status, answer_text."""
    c = table(spark, sf_dir, "conversations")
    answer = c.filter("role = 'assistant'").select(F.col("conv_id").alias("a_conv"), (F.col("turn") - 1).alias("a_turn"), F.col("text").alias("a_text"))
    status = pick(F.col("conv_id") + F.col("turn"), STATUSES)
    t = c.filter("role = 'user'").join(answer, (F.col("conv_id") == F.col("a_conv")) & (F.col("turn") == F.col("a_turn")), "left")
    t = t.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.col("text").alias("question"), status.alias("status"), "a_text")
    return t.withColumn("answer_text", F.when(F.col("status").isin("pending", "failed"), F.lit(None)).otherwise(F.col("a_text"))).drop("a_text")


#: The file of thresholds that gates are held against.
THRESHOLDS = ("retrieval:", "  recall_at_5: 0.88  # of questions", "rates:", "  judged: 0.5", "  deterministic: 1.0", "budget:", "  cost_usd: 0.0085")


def thresholds(spark: SparkSession) -> DataFrame:
    """name, value: the file, written and read."""
    path = new_dir(spark, "thresholds")
    spark.createDataFrame([(line,) for line in THRESHOLDS], "value string").coalesce(1).write.text(path)
    return read_thresholds(spark, path)


_SQL = {
    "lines": """lines AS (SELECT source AS doc, doc_id AS page, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "chunks": rf"""chunks AS (SELECT doc_id AS id, source AS document_code, 'part ' || doc_id % 7 AS section, (doc_id % 3)::VARCHAR AS version,
  DATE '2024-01-01' + ((doc_id % 3) * 30)::INT AS effective_date,
  CASE lang WHEN 'de' THEN 'Auto' WHEN 'fr' THEN 'Residencial' WHEN 'es' THEN 'Empresarial' ELSE 'All' END AS product,
  ['normative', 'minutes', 'pointer', 'glossary'][(doc_id % 4 + 1)::INT] AS doc_role, doc_id % 5 = 4 AS superseded,
  regexp_matches(text, '{X.EMAIL}') OR regexp_matches(text, '{PHONE}') AS contains_pii, text FROM documents)""",
    "questions": "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)",
    "policies": "policies AS (SELECT c_custkey AS policy_id, 'AP-AUTO-' || lpad(c_custkey::VARCHAR, 6, '0') AS policy_number, c_mktsegment AS product, c_acctbal AS annual_premium FROM customer)",
    "claims": """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS policy_id,
  'SIN-' || strftime(o_orderdate, '%Y') || '-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS claim_number, o_orderpriority AS claim_type,
  o_orderstatus AS status, o_orderdate::DATE AS occurrence_date, o_totalprice AS claim_amount FROM orders)""",
    "payments": """payments AS (SELECT l_orderkey AS claim_id, l_linenumber AS payment_no, l_extendedprice AS paid_amount,
  l_shipdate::DATE AS payment_date, l_linestatus AS payment_type FROM lineitem WHERE l_returnflag = 'R')""",
    "turns": """turns AS (SELECT u.conv_id AS conversation_id, u.turn AS seq, u.text AS question,
  ['answered', 'refused', 'needs_clarification', 'pending', 'failed'][((u.conv_id + u.turn) % 5 + 1)::INT] AS status,
  CASE WHEN (u.conv_id + u.turn) % 5 >= 3 THEN NULL ELSE a.text END AS answer_text
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named tables in front; body may start with more of them and a comma-free SELECT."""
    head = ", ".join(_SQL[n] for n in names.split())
    if body.lstrip().startswith(","):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body.lstrip()}"
    return f"WITH {head} {body}"
