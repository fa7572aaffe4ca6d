"""Fact queries: customers are policies, orders claims, returned line items payments."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import facts as D
from cairn.plans import standins as S
from cairn.plans.registry import query

_ALL = "policies claims payments"
_BRL = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({0})), ',.', '.,')"
_PAID = "arg_min({'paid_amount': paid_amount, 'payment_date': payment_date, 'payment_type': payment_type}, (payment_date, payment_no, paid_amount, payment_type))"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return S.claims(spark, sf_dir), S.policies(spark, sf_dir), S.payments(spark, sf_dir)


@query(S.sql("policies claims", " SELECT c.claim_id, c.claim_number, c.status, c.claim_amount, p.product, p.policy_number FROM claims c JOIN policies p ON p.policy_id = c.policy_id"))
def d1_claim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, _ = _tables(spark, sf_dir)
    return D.claim_lookup(c, c, p).select("claim_id", "claim_number", "status", "claim_amount", "product", "policy_number")


@query(S.sql(_ALL, f""", f AS (SELECT claim_id, {_PAID} AS p FROM payments GROUP BY claim_id)
 SELECT c.claim_id, c.claim_number, c.status, po.product, f.p.paid_amount AS paid_amount, f.p.payment_date AS payment_date, f.p.payment_type AS payment_type
 FROM claims c JOIN policies po ON po.policy_id = c.policy_id LEFT JOIN f ON f.claim_id = c.claim_id"""))
def d2_claim_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, pay = _tables(spark, sf_dir)
    return D.claim_payment(c, c, p, pay).select("claim_id", "claim_number", "status", "product", "paid_amount", "payment_date", "payment_type")


@query(S.sql("policies claims", """ SELECT p.policy_number, c.claim_id, c.claim_number, c.occurrence_date, c.claim_amount, c.n FROM policies p LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY occurrence_date DESC, claim_id) AS n FROM claims QUALIFY n <= 20) c ON c.policy_id = p.policy_id"""))
def d3_claims_of_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, _ = _tables(spark, sf_dir)
    return D.claims_of_policies(p, p, c).select("policy_number", "claim_id", "claim_number", "occurrence_date", "claim_amount", "n")


_SUM = "count(*) AS paid_count, round(sum(paid_amount), 2) AS paid_sum, round(avg(paid_amount), 4) AS paid_avg, min(paid_amount) AS paid_min, max(paid_amount) AS paid_max"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"paid_sum": F.round("paid_sum", 2), "paid_avg": F.round("paid_avg", 4)})


@query(S.sql(_ALL, f" SELECT {_SUM} FROM claims c JOIN policies p ON p.policy_id = c.policy_id JOIN payments y ON y.claim_id = c.claim_id"))
def d4_paid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.claims_summary(*_tables(spark, sf_dir)))


@query(S.sql(_ALL, f""" SELECT {_SUM} FROM claims c JOIN policies p ON p.policy_id = c.policy_id JOIN payments y ON y.claim_id = c.claim_id
 WHERE p.product = 'BUILDING' AND y.payment_type = 'F' AND c.occurrence_date >= DATE '1994-01-01' AND c.occurrence_date <= DATE '1996-12-31'"""))
def d8_optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.claims_summary(*_tables(spark, sf_dir), product="BUILDING", payment_type="F", date_from=datetime.date(1994, 1, 1), date_to=datetime.date(1996, 12, 31))
    return _rounded(own)


@query(S.sql("policies", " SELECT policy_number, product, annual_premium FROM policies"))
def d5_policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.policies(spark, sf_dir)
    return D.policy_lookup(p, p).select("policy_number", "product", "annual_premium")


_CASES = {"all": {}, "paid": {"paid": True}, "unpaid": {"paid": False, "product": "MACHINERY"}, "type": {"payment_type": "F", "status": "F"}}


@query(S.sql(_ALL, """, c AS (SELECT c.*, p.product, EXISTS (SELECT 1 FROM payments y WHERE y.claim_id = c.claim_id) AS paid,
 EXISTS (SELECT 1 FROM payments y WHERE y.claim_id = c.claim_id AND y.payment_type = 'F') AS full_ FROM claims c JOIN policies p ON p.policy_id = c.policy_id)
 SELECT 'all' AS filters, count(*) AS claim_count, count(*) FILTER (paid) AS paid_claim_count FROM c
 UNION ALL SELECT 'paid', count(*), count(*) FILTER (paid) FROM c WHERE paid UNION ALL SELECT 'unpaid', count(*), count(*) FILTER (paid) FROM c WHERE NOT paid AND product = 'MACHINERY'
 UNION ALL SELECT 'type', count(*), count(*) FILTER (paid) FROM c WHERE full_ AND status = 'F'"""))
def d6_count_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, wanted in _CASES.items():
        one = D.count_claims(*_tables(spark, sf_dir), **wanted).select(F.lit(name).alias("filters"), "claim_count", "paid_claim_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(S.sql("claims payments", " SELECT greatest((SELECT max(occurrence_date) FROM claims), (SELECT max(payment_date) FROM payments)) AS snapshot_date"))
def d7_snapshot_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, y = _tables(spark, sf_dir)
    return D.snapshot_date(c, y)


_NAMES = ("get_claim", "get_policy", "count_claims", "drop_table", "list_claims_by_policy")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = S.claims(spark, sf_dir), F.col("claim_id")
    return c.select(
        "claim_id", S.pick(k, _NAMES).alias("query"), F.when(k % 11 == 0, F.lower("claim_number")).otherwise(F.col("claim_number")).alias("claim_number"),
        F.when(k % 7 == 0, F.lit("AP-XXX-1")).otherwise(F.lit("AP-RES-000001")).alias("policy_number"), F.when(k % 6 == 0, F.lit("Pago")).alias("status"),
        F.when(k % 4 == 0, F.lit("Integral")).alias("payment_type"), (k % 3 > 0).alias("paid"), (k % 23).cast("int").alias("row_limit"),
    )


_PLANS_SQL = f""", plans AS (SELECT claim_id, {list(_NAMES)}[(claim_id % 5 + 1)::INT] AS query, CASE WHEN claim_id % 11 = 0 THEN lower(claim_number) ELSE claim_number END AS claim_number,
 CASE WHEN claim_id % 7 = 0 THEN 'AP-XXX-1' ELSE 'AP-RES-000001' END AS policy_number, CASE WHEN claim_id % 6 = 0 THEN 'Pago' END AS status,
 CASE WHEN claim_id % 4 = 0 THEN 'Integral' END AS payment_type, claim_id % 3 > 0 AS paid, claim_id % 23 AS row_limit FROM claims),
 checked AS (SELECT claim_id, query, CASE WHEN query = 'drop_table' THEN 'unknown query' WHEN query = 'get_claim' AND NOT regexp_matches(claim_number, '^SIN-[0-9]{{4}}-[0-9]{{6}}$') THEN 'claim_number'
 WHEN query IN ('get_policy', 'list_claims_by_policy') AND policy_number = 'AP-XXX-1' THEN 'policy_number' WHEN status = 'Pago' THEN 'status cannot express paid'
 WHEN NOT paid AND payment_type IS NOT NULL THEN 'paid=false contradicts payment_type' WHEN row_limit NOT BETWEEN 1 AND 20 THEN 'limit' END AS rejected FROM plans)"""


@query(S.sql("claims", _PLANS_SQL + " SELECT claim_id, query, rejected FROM checked"))
def d9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.validated(_plans(spark, sf_dir)).select("claim_id", "query", "rejected")


@query(S.sql("claims", _PLANS_SQL + " SELECT query, count(*) AS n FROM plans WHERE query = 'drop_table' GROUP BY query"))
def d10_unknown_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.validated(_plans(spark, sf_dir)).filter("rejected = 'unknown query'").groupBy("query").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, " + _BRL.format("c_acctbal") + " AS amount FROM customer")
def d11_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select("c_custkey", X.brl(F.col("c_acctbal")).alias("amount"))


@query(S.sql("claims", """ SELECT claim_id, 'claims.count_claims(' || concat_ws(', ', 'claim_type="' || claim_type || '"', CASE WHEN claim_id % 2 = 0 THEN 'status="' || status || '"' END) || ')' AS call FROM claims"""))
def d12_call_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"claim_type": F.col("claim_type"), "status": F.when(F.col("claim_id") % 2 == 0, F.col("status"))}
    return S.claims(spark, sf_dir).select("claim_id", X.call_text(F.lit("count_claims"), params).alias("call"))


@query(S.sql("claims", """ SELECT claim_id, 'claims:get_claim:' || substr(sha256('{"claim_number": "' || claim_number || '", "query": "get_claim"}'), 1, 8) AS evidence_id FROM claims"""))
def d13_evidence_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claims(spark, sf_dir).select("claim_id", X.evidence_id(F.lit("get_claim"), {"claim_number": F.col("claim_number")}).alias("evidence_id"))


_CLAIM_TEXT = ("'claim_number: ' || claim_number || chr(10) || 'claim_type: ' || claim_type || chr(10) || 'status: ' || status || chr(10) || 'occurrence_date: ' || occurrence_date::VARCHAR || chr(10) || "
 f"'valor_reivindicado ({D.CLAIMED}): ' || {_BRL.format('claim_amount')} || chr(10) || 'product: ' || product || chr(10) || 'policy_number: ' || policy_number || chr(10) || "
 """'valor pago: consultar claims.get_claim_payment(claim_number="' || claim_number || '")'""")  # fmt: skip
_PAY_TEXT = ("'claim_number: ' || claim_number || chr(10) || 'status: ' || status || chr(10) || 'product: ' || product || CASE WHEN f.p IS NULL THEN chr(10) || 'nenhum pagamento registrado — sinistro em status \"' || status || '\"' "
 f"ELSE chr(10) || 'paid_amount: ' || {_BRL.format('f.p.paid_amount')} || chr(10) || 'payment_date: ' || f.p.payment_date::VARCHAR || chr(10) || 'payment_type: ' || f.p.payment_type END")  # fmt: skip


@query(S.sql(_ALL, f""", f AS (SELECT claim_id, {_PAID} AS p FROM payments GROUP BY claim_id), j AS (SELECT c.*, p.product, p.policy_number FROM claims c JOIN policies p ON p.policy_id = c.policy_id)
 SELECT j.claim_id, {_CLAIM_TEXT} AS claim_text, {_PAY_TEXT} AS payment_text FROM j LEFT JOIN f ON f.claim_id = j.claim_id"""))
def d14_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, y = _tables(spark, sf_dir)
    found = D.claim_payment(c, c, p, y)
    cols = {k: F.col(k) for k in found.columns}
    return found.select("claim_id", D.claim_text(cols).alias("claim_text"), D.payment_text(cols).alias("payment_text"))


@query(S.sql(_ALL, f""", t AS (SELECT p.product, c.claim_id, y.paid_amount FROM policies p JOIN claims c ON c.policy_id = p.policy_id LEFT JOIN payments y ON y.claim_id = c.claim_id),
 s AS (SELECT product, count(paid_amount) AS k, sum(paid_amount) AS s, avg(paid_amount) AS a, min(paid_amount) AS lo, max(paid_amount) AS hi, count(DISTINCT claim_id) AS c, count(DISTINCT claim_id) FILTER (paid_amount IS NOT NULL) AS pc FROM t GROUP BY product)
 SELECT product, 'paid_count: ' || k || chr(10) || CASE WHEN k = 0 THEN 'nenhum pagamento nas condições filtradas' ELSE 'paid_sum: ' || {_BRL.format('round(s, 2)')} || chr(10) || 'paid_avg: ' || {_BRL.format('round(a, 4)')}
  || chr(10) || 'paid_min: ' || {_BRL.format('lo')} || chr(10) || 'paid_max: ' || {_BRL.format('hi')} END AS summary_text, 'claim_count: ' || c || chr(10) || 'paid_claim_count: ' || pc AS count_text FROM s
 UNION ALL SELECT 'none', 'paid_count: 0' || chr(10) || 'nenhum pagamento nas condições filtradas', 'claim_count: 0' || chr(10) || 'paid_claim_count: 0'"""))
def d14_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of each market segment, and of one that does not exist, as text."""
    c, p, y = _tables(spark, sf_dir)
    asked = p.select("product").distinct().unionByName(spark.range(1).select(F.lit("none").alias("product")))
    found = _rounded(D.summaries(c, p, y, asked))
    cols = {k: F.col(k) for k in found.columns}
    return found.select("product", D.summary_text(cols).alias("summary_text"), D.count_text(cols).alias("count_text"))


@query(S.sql("claims payments", rf""" SELECT doc_id, regexp_matches(text, '{X.EMAIL}') AS held FROM documents"""))
def d15_result_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, y = _tables(spark, sf_dir)
    ok, held = D.guard(S.table(spark, sf_dir, "documents").select("doc_id", "text"), D.snapshot_date(c, y))
    return ok.select("doc_id", F.lit(False).alias("held")).unionByName(held.select("doc_id", F.lit(True).alias("held")))


@query(S.sql(_ALL, f""", j AS (SELECT c.*, p.product, p.policy_number FROM claims c JOIN policies p ON p.policy_id = c.policy_id)
 SELECT 'claims:get_claim:' || substr(sha256('{{"claim_number": "' || claim_number || '", "query": "get_claim"}}'), 1, 8) AS evidence_id, 'claims.get_claim(claim_number="' || claim_number || '")' AS section,
 product, {_CLAIM_TEXT} AS text, greatest((SELECT max(occurrence_date) FROM claims), (SELECT max(payment_date) FROM payments)) AS effective_date, 'claims.db' AS document_code, 'snapshot' AS version, 'database' AS doc_role, 'claims' AS source_kind FROM j"""))
def d16_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, y = _tables(spark, sf_dir)
    found = D.claim_lookup(c, c, p)
    found = found.withColumn("text", D.claim_text({k: F.col(k) for k in found.columns}))
    return D.evidence_rows(found, "get_claim", {"claim_number": F.col("claim_number")}, D.snapshot_date(c, y))


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every claim: naming it, its policy, both, or neither; in either case, once or twice."""
    c, p, _ = _tables(spark, sf_dir)
    k = F.col("claim_id")
    n = F.when(k % 4 < 2, F.concat(F.lit("Qual o status de "), F.lower("claim_number"), F.lit(" ("), "claim_number", F.lit(")?"))).otherwise(F.lit("Qual a regra?"))
    m = F.when(k % 4 > 0, F.concat(F.lit(" Apólice "), "policy_number", F.when(k % 3 == 0, F.lit(" e indenizações")).otherwise(F.lit("")))).otherwise(F.lit(""))
    return c.join(p.select("policy_id", "policy_number"), "policy_id").select(k.alias("question_id"), F.concat(n, m).alias("question"))


_ROUTED = """, q AS (SELECT claim_id AS question_id, claim_id % 4 < 2 AS has_claim, claim_id % 4 > 0 AS has_policy, claim_id % 4 < 2 OR (claim_id % 4 > 0 AND claim_id % 3 = 0) AS about, claim_number, policy_number
 FROM claims c JOIN policies p ON p.policy_id = c.policy_id),
 routed AS (SELECT question_id, 1 AS step, 'get_claim' AS query, claim_number AS key FROM q WHERE has_claim UNION ALL SELECT question_id, 2, 'get_claim_payment', claim_number FROM q WHERE has_claim
 UNION ALL SELECT question_id, CASE WHEN has_claim THEN 3 ELSE 1 END, 'get_policy', policy_number FROM q WHERE has_policy
 UNION ALL SELECT question_id, CASE WHEN has_claim THEN 4 ELSE 2 END, 'list_claims_by_policy', policy_number FROM q WHERE has_policy AND about)"""


@query(S.sql("policies claims", _ROUTED + " SELECT question_id, step::BIGINT AS step, query, key FROM routed"))
def d17_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route(routed_questions(spark, sf_dir))


_POLICY_TEXT = f"'policy_number: ' || policy_number || chr(10) || 'product: ' || product || chr(10) || 'annual_premium: ' || {_BRL.format('annual_premium')}"
_LISTED_TEXT = ("'claim_number: ' || claim_number || chr(10) || 'claim_type: ' || claim_type || chr(10) || 'status: ' || status || chr(10) || 'occurrence_date: ' || occurrence_date::VARCHAR || chr(10) || "
 f"'valor_reivindicado ({D.CLAIMED}): ' || {_BRL.format('claim_amount')} || chr(10) || 'paid_amount: ' || coalesce({_BRL.format('f.p.paid_amount')}, 'nenhum pagamento')")  # fmt: skip


@query(S.sql(_ALL, _ROUTED + f""", f AS (SELECT claim_id, {_PAID} AS p FROM payments GROUP BY claim_id), j AS (SELECT c.*, p.product, p.policy_number FROM claims c JOIN policies p ON p.policy_id = c.policy_id),
 t AS (SELECT claim_number AS key, 'get_claim' AS query, {_CLAIM_TEXT} AS text FROM j UNION ALL SELECT claim_number, 'get_claim_payment', {_PAY_TEXT} FROM j LEFT JOIN f ON f.claim_id = j.claim_id
 UNION ALL SELECT policy_number, 'get_policy', {_POLICY_TEXT} FROM policies
 UNION ALL SELECT policy_number, 'list_claims_by_policy', string_agg({_LISTED_TEXT}, chr(10) || chr(10) ORDER BY n) FROM
  (SELECT j.*, row_number() OVER (PARTITION BY policy_id ORDER BY occurrence_date DESC, claim_id) AS n FROM j QUALIFY n <= 20) l LEFT JOIN f ON f.claim_id = l.claim_id GROUP BY policy_number)
 SELECT r.question_id, r.step::BIGINT AS step, r.query, r.key, t.text FROM routed r LEFT JOIN t ON t.key = r.key AND t.query = r.query"""))
def d18_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.execute(D.route(routed_questions(spark, sf_dir)), *_tables(spark, sf_dir))


@query(S.sql(_ALL, """, y AS (SELECT claim_id, sum(paid_amount) AS paid, max(paid_amount) AS most FROM payments GROUP BY claim_id)
 SELECT p.product, c.claim_type, count(*) AS n_claims, round(sum(claim_amount), 2) AS claimed, round(sum(y.paid), 2) AS paid, max(y.most) AS max_paid, 100000.0::DOUBLE AS limit_amount, max(y.most) > 100000.0 AS above_limit
 FROM claims c JOIN policies p ON p.policy_id = c.policy_id LEFT JOIN y ON y.claim_id = c.claim_id GROUP BY 1, 2"""))
def d19_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, y = _tables(spark, sf_dir)
    limits = p.select("product").distinct().withColumn("limit_amount", F.lit(100000.0))
    return D.reconcile(c, p, y, limits).withColumns({"claimed": F.round("claimed", 2), "paid": F.round("paid", 2)})
