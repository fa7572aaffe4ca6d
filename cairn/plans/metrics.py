"""Cost and evaluation queries: orders are records of runs, line items their checks, events attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import gates as G
from cairn.operators import metrics as M
from cairn.plans import gates as PG
from cairn.plans import retrieval as PR
from cairn.plans import standins as S
from cairn.plans.registry import query
from cairn.sources.index import bounds

_REC = """rec AS (SELECT o_orderkey AS id, o_custkey AS case_id, o_orderkey % 3 + 1 AS run, CASE WHEN o_custkey % 2 = 0 THEN 'judged' ELSE 'deterministic' END AS grade,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'canned' ELSE 'live' END AS provider, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'refused' ELSE 'needs_clarification' END AS outcome,
 floor(o_totalprice)::BIGINT % 5000 AS latency_ms, o_orderkey % 3000 AS prompt_tokens, o_orderkey % 1000 AS cached_tokens, o_custkey % 500 AS completion_tokens, o_orderkey % 7 AS reasoning_tokens, o_orderkey % 29 = 0 AS degraded FROM orders)"""
NAMES = ("citation_validity", "pii_leak", "error_leakage", "must_contain x", "must_cite y", "must_be_refusal", "must_not_match z")
_CHK = f"chk AS (SELECT r.case_id, r.run, {list(NAMES)}[l_linenumber] AS name, l_quantity > 3 AS passed FROM lineitem JOIN rec r ON r.id = l_orderkey)"
_VER = "WITH " + _REC + ", " + _CHK + """, pas AS (SELECT case_id, run, bool_and(passed) AS dp, coalesce(bool_and(passed) FILTER (name IN ('citation_validity', 'pii_leak', 'error_leakage')), TRUE) AS hp FROM chk GROUP BY 1, 2),
 jud AS (SELECT DISTINCT case_id, run, CASE WHEN case_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS verdict FROM rec WHERE case_id % 5 > 0),
 one AS (SELECT case_id, run, grade, min(outcome) AS outcome FROM rec GROUP BY 1, 2, 3),
 gra AS (SELECT o.case_id, o.run, o.grade, o.outcome, CASE WHEN o.grade = 'judged' THEN CASE WHEN coalesce(p.dp, FALSE) THEN coalesce(j.verdict, 'not-judged') ELSE 'fail' END WHEN p.dp THEN 'pass' ELSE 'fail' END AS verdict
  FROM one o LEFT JOIN pas p ON p.case_id = o.case_id AND p.run = o.run LEFT JOIN jud j ON j.case_id = o.case_id AND j.run = o.run)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.table(spark, sf_dir, "orders").select(
        k.alias("id"), c.alias("case_id"), (k % 3 + 1).alias("run"), F.when(c % 2 == 0, "judged").otherwise("deterministic").alias("grade"),
        F.when(F.col("o_orderpriority") == "5-LOW", "canned").otherwise("live").alias("provider"),
        F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "refused").otherwise("needs_clarification").alias("outcome"),
        (F.floor("o_totalprice") % 5000).alias("latency_ms"), (k % 3000).alias("prompt_tokens"), (k % 1000).alias("cached_tokens"),
        (c % 500).alias("completion_tokens"), (k % 7).alias("reasoning_tokens"), (k % 29 == 0).alias("degraded"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("id", "case_id", "run")
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, NAMES)), F.col("l_linenumber")).alias("name"), (F.col("l_quantity") > 3).alias("passed"))
    return li.join(r, "id").select("case_id", "run", "name", "passed")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    judged = r.filter("case_id % 5 > 0").select("case_id", "run", F.when(F.col("case_id") % 3 == 0, "fail").otherwise("pass").alias("verdict")).distinct()
    return M.verdicts(r.groupBy("case_id", "run", "grade").agg(F.min("outcome").alias("outcome")), M.record_verdicts(checks(spark, sf_dir)), judged)


_COST = "(greatest(0, prompt_tokens - cached_tokens) * 0.75::DOUBLE + cached_tokens * 0.075::DOUBLE + (completion_tokens + reasoning_tokens) * 4.5::DOUBLE) / 1e6"


@query(f"WITH {_REC} SELECT id, round({_COST}, 9) AS cost FROM rec")
def g1_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = M.cost_usd(*map(F.col, ("prompt_tokens", "cached_tokens", "completion_tokens", "reasoning_tokens")))
    return records(spark, sf_dir).select("id", F.round(cost, 9).alias("cost"))


@query("SELECT conv_id, round(greatest(1, sum(length(text)) // 3) * 0.75::DOUBLE / 1e6, 9) AS estimate FROM conversations GROUP BY conv_id")
def g2_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return M.estimated_usd(c, "conv_id").withColumn("estimate", F.round("estimate", 9))


@query(f"""WITH {_REC}, a AS (SELECT case_id AS question_id, id AS attempt, {_COST} AS cost FROM rec), s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY question_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM a)
 SELECT question_id, attempt, round(spent, 9) AS spent, spent + 0.001 <= 0.05 AS affordable FROM s""")
def g3_affordable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = M.cost_usd(*map(F.col, ("prompt_tokens", "cached_tokens", "completion_tokens", "reasoning_tokens")))
    a = records(spark, sf_dir).select(F.col("case_id").alias("question_id"), F.col("id").alias("attempt"), cost.alias("cost"), F.lit(0.001).alias("estimate"))
    return M.affordable(a).select("question_id", "attempt", F.round("spent", 9).alias("spent"), "affordable")


@query("""WITH a AS (SELECT user_id AS source, ts, event_id, event_type <> 'error' AS ok FROM events),
 i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - row_number() OVER (PARTITION BY source, ok ORDER BY ts, event_id) AS island FROM a)
 SELECT source, count(*) AS n, min(event_id) AS first_id FROM i WHERE NOT ok GROUP BY source, island HAVING count(*) >= 3""")
def g4_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    a = e.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    runs = M.failure_runs(a, threshold=3)
    first = a.select("source", F.col("ts").alias("first_ts"), "id")
    return runs.join(first, ["source", "first_ts"]).groupBy("source", "first_ts", "n").agg(F.min("id").alias("first_id")).select("source", "n", "first_id")


@query("""SELECT user_id AS question_id, count(*) AS n_attempts, count(*) FILTER (event_type IN ('error', 'view')) AS n_retryable, arg_max(event_type, event_id) AS last_reason FROM events GROUP BY user_id""")
def g5_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return M.attempts_by_question(e.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("attempt"), F.col("event_type").isin("error", "view").alias("retryable"), F.col("event_type").alias("reason")))


@query(S.sql("questions chunks", PR._BM + PR._TOP5 + PR._EXPECTED + """, m AS (SELECT e.question_id, count(DISTINCT e.id) = count(DISTINCT e.id) FILTER (t.id IS NOT NULL) AS hit FROM expected e LEFT JOIN top5 t ON t.question_id = e.question_id AND t.id = e.id GROUP BY 1)
 SELECT count(*) AS n, round(avg(hit::INT), 6) AS recall, round(avg(hit::INT), 6) >= 0.88 AS passed FROM m"""))
def h3_recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recall_gate(PR.h2_recall_by_chunk(spark, sf_dir), bounds(S.thresholds(spark), "recall_at_5")["recall_at_5"])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, even = S.table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0
    words = lambda *w: F.array(*map(F.lit, w))
    return d.select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("answer"), F.concat("source", F.lit("|"), "text").alias("envelope"), F.when(F.col("doc_id") % 3 == 0, "refused").otherwise("answered").alias("outcome"),
        F.array("source", "lang").alias("cited"), F.when(even, words(" the ", " of ")).alias("must_contain"), words("idiot").alias("must_not_contain"), F.when(~even, words("src1")).alias("must_cite"),
        words(r"[0-9]{16}").alias("must_not_match"), words("src13").alias("forbidden_strings"), (F.col("doc_id") % 4 == 0).alias("must_be_refusal"),
    )


@query("""SELECT doc_id AS case_id, 'must_contain ' || w AS name, contains(text, w) AS passed FROM documents, (SELECT unnest([' the ', ' of ']) AS w) WHERE doc_id % 2 = 0
 UNION ALL SELECT doc_id, 'must_not_contain idiot', NOT contains(text, 'idiot') FROM documents UNION ALL SELECT doc_id, 'must_cite src1', contains(source, 'src1') OR contains(lang, 'src1') FROM documents WHERE doc_id % 2 = 1
 UNION ALL SELECT doc_id, 'must_not_match [0-9]{16}', NOT regexp_matches(source || '|' || text, '[0-9]{16}') FROM documents UNION ALL SELECT doc_id, 'forbidden_strings src13', NOT contains(source || '|' || text, 'src13') FROM documents
 UNION ALL SELECT doc_id, 'must_be_refusal', doc_id % 3 = 0 FROM documents WHERE doc_id % 4 = 0""")
def h5_case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.case_checks(cases(spark, sf_dir))


@query(S.sql("chunks", PG._CITED + " SELECT d.question_id, coalesce(c.all_found, TRUE) AS passed FROM dr d LEFT JOIN cv c ON c.question_id = d.question_id"))
def h6_citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = PG.evidence(spark, sf_dir).groupBy("question_id").agg(F.collect_set("evidence_id").alias("ids"))
    d = PG.drafts(spark, sf_dir).join(got, "question_id", "left")
    return d.select("question_id", M.citation_validity(F.col("citations"), F.coalesce("ids", F.array().cast("array<string>"))).alias("passed"))


@query(rf"SELECT doc_id, NOT (regexp_matches(text, '{X.EMAIL}') OR regexp_matches(text, '{S.PHONE}') OR contains(text, 'idiot')) AS passed FROM documents")
def h7_pii_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", M.pii_leak(F.col("text"), ["idiot"], S.PHONE).alias("passed"))


_BODY = "text || CASE WHEN doc_id % 20 = 0 THEN ' Traceback' WHEN doc_id % 20 = 1 THEN ' gpt-5' ELSE '' END"


@query(f"SELECT doc_id, NOT (contains(b, 'Traceback') OR contains(b, 'gpt-5')) AS passed FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_BODY} || ' gpt-4' ELSE {_BODY} END AS b, doc_id % 3 = 0 AS p FROM documents) WHERE NOT p UNION ALL SELECT doc_id, FALSE FROM documents WHERE doc_id % 3 = 0")
def h8_error_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rest = F.concat("text", F.when(k % 20 == 0, " Traceback").when(k % 20 == 1, " gpt-5").otherwise(""))
    return S.table(spark, sf_dir, "documents").select("doc_id", M.error_leakage(F.concat(rest, F.lit(" gpt-4")), k % 3 == 0, rest).alias("passed"))


@query("""SELECT doc_id, doc_id % 5 > 0 AND (doc_id % 7 = 0 OR doc_id % 2 = 0 OR lang = 'de') AS passed FROM documents""")
def h9_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    answer = F.concat(F.when(k % 2 == 0, "sem valor").otherwise("R$ 10,00"), F.when(F.col("lang") == "de", " Auto").otherwise(""))
    return S.table(spark, sf_dir, "documents").select("doc_id", M.boundary(F.when(k % 5 == 0, "refused").otherwise("answered"), F.lit("answered"), answer, k % 7 == 0, G.PRODUCTS).alias("passed"))


@query(S.sql("chunks", PG._JUDGED + """, f AS (SELECT CASE WHEN pii_request THEN 'refused' WHEN outcome <> 'answered' THEN outcome WHEN ambiguous THEN 'needs_clarification' WHEN NOT cites OR NOT supported THEN 'refused' ELSE 'answered' END AS final_outcome FROM ju WHERE list_contains(citations, 'forged'))
 SELECT final_outcome, count(*) AS n FROM f GROUP BY 1"""))
def h10_forged_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = PG.inputs(spark, sf_dir, F.array_contains("citations", "forged"))
    return G.judge(forged, S.PHONE).groupBy("final_outcome").agg(F.count("*").alias("n"))


@query(_VER + " SELECT case_id, run, dp AS deterministic_pass, hp AS hard_gates_pass FROM pas")
def h11_record_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.record_verdicts(checks(spark, sf_dir))


@query(f"WITH {_REC} SELECT id FROM rec WHERE provider = 'live' AND NOT degraded AND prompt_tokens = 0")
def h12_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suspected_replays(records(spark, sf_dir), "live").select("id")


@query(f"WITH {_REC}, {_CHK} SELECT name, count(*) FILTER (passed) AS n_passed, count(*) AS n, count(*) FILTER (passed) = count(*) AS ok FROM chk WHERE name IN ('citation_validity', 'pii_leak', 'error_leakage') GROUP BY name")
def h13_gate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate_tally(checks(spark, sf_dir))


@query(f"WITH {_REC} SELECT string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(*) FILTER (provider = 'live' AND NOT degraded AND prompt_tokens = 0) AS n_replays, FALSE AS live FROM rec")
def h14_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.providers(records(spark, sf_dir), "live")


@query(_VER + " SELECT case_id, run, grade, outcome, verdict FROM gra")
def h15_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir)


@query(_VER + " SELECT case_id, count(DISTINCT verdict) = 1 AS stable, string_agg(DISTINCT outcome, '/' ORDER BY outcome) AS outcomes FROM gra GROUP BY case_id")
def h16_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stability(graded(spark, sf_dir))


@query(_VER + " SELECT grade, count(*) AS n, round(avg((verdict = 'pass')::INT), 6) AS rate, round(avg((verdict = 'pass')::INT), 6) >= CASE grade WHEN 'judged' THEN 0.5 ELSE 1.0 END AS ok FROM gra GROUP BY grade")
def h17_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pass_rates(graded(spark, sf_dir), bounds(S.thresholds(spark), "judged", "deterministic"))


@query(f"WITH {_REC}, {_CHK} SELECT case_id, name, min(run) AS run FROM chk WHERE NOT passed GROUP BY 1, 2")
def h18_first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_failures(checks(spark, sf_dir))


@query(f"""WITH {_REC}, o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM rec)
 SELECT median(latency_ms)::DOUBLE AS p50, max(latency_ms) FILTER (i = least(n - 1, round_even(0.95 * (n - 1), 0))) AS p95, max(latency_ms) AS max FROM o""")
def h19_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(records(spark, sf_dir))


@query(f"""WITH {_REC}, s AS (SELECT provider, round(avg({_COST}), 9) AS mean_cost, round(max({_COST}), 9) AS max_cost, count(*) FILTER (provider = 'live' AND NOT degraded AND prompt_tokens = 0) AS n_replays FROM rec GROUP BY provider)
 SELECT provider, mean_cost, max_cost, CASE WHEN provider <> 'live' OR n_replays > 0 THEN 'not measured' WHEN mean_cost <= 0.0085 THEN 'pass' ELSE 'miss' END AS mean_verdict,
 CASE WHEN provider <> 'live' OR n_replays > 0 THEN 'not measured' WHEN max_cost <= 0.0085 THEN 'pass' ELSE 'miss' END AS max_verdict FROM s""")
def h20_cost_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cost_verdicts(records(spark, sf_dir), "live", bounds(S.thresholds(spark), "cost_usd")["cost_usd"])


@query(f"""WITH {_REC} SELECT round(avg({_COST}), 9) AS mean_cost, round(max({_COST}), 9) AS max_cost, sum(prompt_tokens)::BIGINT AS prompt, sum(cached_tokens)::BIGINT AS cached,
 (sum(prompt_tokens) - sum(cached_tokens))::BIGINT AS uncached, sum(completion_tokens)::BIGINT AS completion FROM rec""")
def h20_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cost_summary(records(spark, sf_dir))


@query(f"""WITH {_REC}, f AS (SELECT DISTINCT case_id FROM rec WHERE run = 1 AND outcome = 'refused') SELECT count(*) FILTER (case_id % 4 = 0) AS correct, count(*) FILTER (case_id % 4 <> 0) AS wrong FROM f""")
def h21_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return M.refusals(r, r.filter("case_id % 4 = 0").select("case_id"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 5 > 0 AND (doc_id % 7 = 0 OR doc_id % 2 = 0 OR lang = 'de')) AS n_passed FROM documents")
def h22_boundary_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h9_boundary(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


_TEXTS = """cites AS (SELECT l_orderkey AS message_id, l_linenumber AS ordinal, l_partkey AS evidence_id FROM lineitem),
 texts AS (SELECT message_id, count(*) AS requested, count(d.text) AS resolved, {0} AS t FROM cites LEFT JOIN documents d ON d.doc_id = evidence_id GROUP BY 1)"""
_CITED_TEXT = "string_agg(d.text, chr(10) || '---' || chr(10) ORDER BY ordinal, d.text)"


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("evidence_id"))
    return c, S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query("WITH " + _TEXTS.format("string_agg(sha256(d.text), ',' ORDER BY ordinal, d.text)") + " SELECT message_id, requested, resolved, coalesce(t, '') AS text_hashes FROM texts")
def h23_resolved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.array_join(F.transform("texts", lambda x: F.lower(F.hex(x))), ",")
    return M.resolved(*_cited(spark, sf_dir), F.unhex(F.sha2("text", 256))).select("message_id", "requested", "resolved", hashes.alias("text_hashes"))


@query("WITH " + _TEXTS.format(_CITED_TEXT) + """ SELECT message_id, sha256('<question>' || chr(10) || 'q' || message_id || chr(10) || '</question>' || chr(10) || '<expected>' || chr(10) || chr(10) || '</expected>' || chr(10) || '<answer>' || chr(10) || requested || chr(10) || '</answer>' || chr(10)
 || '<cited>' || chr(10) || coalesce(t, '') || chr(10) || '</cited>') AS prompt_sha256 FROM texts""")
def h24_grader_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    t = M.resolved_by_range(*_cited(spark, sf_dir))
    answers = t.select("message_id", F.concat(F.lit("q"), "message_id").alias("question"), F.lit(None).cast("string").alias("expected"), F.col("requested").cast("string").alias("answer"), "texts")
    return M.grader_prompts(answers).select("message_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("""SELECT conv_id, n_sent, n, all_ok, n = n_sent AND all_ok AS ok FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n_sent, count(*) FILTER (role = 'assistant') AS n,
 coalesce(bool_and(text IS NOT NULL AND NOT contains(text, 'Traceback')) FILTER (role = 'assistant'), FALSE) AS all_ok FROM conversations GROUP BY conv_id)""")
def h25_batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "batch_id")
    sent = c.filter("role = 'user'").select("batch_id")
    got = c.filter("role = 'assistant'").select("batch_id", F.col("text").isNotNull().alias("well_formed"), (~F.contains("text", F.lit("Traceback"))).alias("clean"))
    known = c.select("batch_id").distinct()
    return M.batch_check(known, sent, got).withColumnRenamed("batch_id", "conv_id")
