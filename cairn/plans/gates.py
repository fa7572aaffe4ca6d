"""Gate queries: every document's whole text is a question, and the documents with the next five ids are its evidence.

Planted cases: a question of 13 has no evidence, one of 8 no draft; answers are evidence texts, or for one of 4 the question
itself; citations are forged or missing for some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import gates as G
from cairn.plans import standins as S
from cairn.plans.registry import query

#: Evidence of a question.
NEXT = 5
_TAILS = ("", " nomes completos", " no Auto", " e o e-mail?", " CPF")
_FOLD = f"trim(regexp_replace(translate(lower({{}}), '{X.MARKED}', '{X.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_TERMS = f"list_distinct(list_filter(string_split({_FOLD}, ' '), lambda w: length(w) >= 4 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$')))"
_BASE = f""", gq AS (SELECT doc_id AS question_id, text || {list(_TAILS)}[(doc_id % 5 + 1)::INT] AS question FROM documents),
 ev AS (SELECT q.question_id, c.id - q.question_id AS pos, c.id::VARCHAR AS evidence_id, document_code, section, product,
  doc_role, contains_pii, CASE WHEN c.id % 9 = 0 THEN 'claims' ELSE 'corpus' END AS source_kind, c.text
  FROM (SELECT question_id, unnest(range(1, {NEXT + 1})) AS k FROM gq WHERE question_id % 13 <> 0) q JOIN chunks c ON c.id = q.question_id + q.k),
 dr AS (SELECT q.question_id, CASE WHEN q.question_id % 17 = 3 THEN 'refused' WHEN q.question_id % 17 = 5 THEN 'needs_clarification' ELSE 'answered' END AS outcome,
  CASE WHEN q.question_id % 4 = 0 THEN q.question ELSE coalesce(e.text, '') END AS answer,
  CASE WHEN q.question_id % 6 = 0 THEN ['forged', e.evidence_id] WHEN q.question_id % 6 = 1 THEN []::VARCHAR[] ELSE list_filter([e.evidence_id], lambda x: x IS NOT NULL) END AS citations
  FROM gq q LEFT JOIN ev e ON e.question_id = q.question_id AND e.pos = 1 WHERE q.question_id % 8 <> 7)"""
_FACTS = _BASE + """, fa AS (SELECT question_id, coalesce(bool_or(contains_pii OR doc_role = 'minutes'), FALSE) AS carries_pii, list_sort(list_distinct(list(product) FILTER (product <> 'All'))) AS products, count(*) AS n_evidence FROM ev GROUP BY 1)"""
_GATES = _FACTS + rf""", ga AS (SELECT q.question_id, q.question, coalesce(carries_pii, FALSE) AS carries_pii, coalesce(products, []) AS products, n_evidence,
 regexp_matches({_FOLD.format('question')}, '{X.PII_REQUEST}') AND coalesce(carries_pii, FALSE) AS pii_request,
 len(coalesce(products, [])) > 1 AND NOT regexp_matches({_FOLD.format('question')}, '\b(auto|residencial|empresarial)\b') AS ambiguous FROM gq q LEFT JOIN fa ON fa.question_id = q.question_id)"""
_CITED = _GATES + """, ci AS (SELECT d.question_id, d.ordinal, d.evidence_id, e.evidence_id IS NOT NULL AS found, e.text, e.section FROM
  (SELECT question_id, unnest(citations) AS evidence_id, unnest(range(len(citations))) AS ordinal FROM dr) d LEFT JOIN ev e ON e.question_id = d.question_id AND e.evidence_id = d.evidence_id),
 cv AS (SELECT question_id, bool_and(found) AS all_found, count(*) AS n_cited FROM ci GROUP BY 1)"""
_RATIO = _CITED + f""", he AS (SELECT DISTINCT question_id, unnest(list_concat({_TERMS.format('text')}, {_TERMS.format('section')})) AS term FROM ci WHERE found),
 te AS (SELECT question_id, unnest({_TERMS.format('answer')}) AS term FROM dr),
 ra AS (SELECT d.question_id, coalesce(r.ratio, 1.0) AS ratio FROM dr d LEFT JOIN (SELECT te.question_id, count(*) FILTER (h.term IS NOT NULL OR s.stem IS NOT NULL) / count(*) AS ratio FROM te
  LEFT JOIN he h ON h.question_id = te.question_id AND h.term = te.term
  LEFT JOIN (SELECT DISTINCT question_id, substr(term, 1, 6) AS stem FROM he WHERE length(term) >= 6) s ON s.question_id = te.question_id AND length(te.term) >= 6 AND s.stem = substr(te.term, 1, 6)
  GROUP BY 1) r ON r.question_id = d.question_id)"""
_JUDGED = _RATIO + """, ju AS (SELECT d.*, g.products, g.pii_request, g.ambiguous, coalesce(cv.all_found AND cv.n_cited > 0, FALSE) AS cites, ra.ratio >= 0.8 AS supported
 FROM dr d JOIN ga g ON g.question_id = d.question_id LEFT JOIN cv ON cv.question_id = d.question_id LEFT JOIN ra ON ra.question_id = d.question_id)"""
_CL = f"'{G.CLARIFICATION}' || " + "CASE WHEN len(products) > 1 THEN array_to_string(products[1:len(products) - 1], ', ') || ' ou ' || products[len(products)] ELSE products[1] END || '?'"


def _red(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '{X.EMAIL}', '[EMAIL]', 'g'), '{S.PHONE}', '[TELEFONE]', 'g')"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.concat("text", S.pick(F.col("doc_id"), _TAILS)).alias("question"))


def evidence(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """``of``: only what these drafts cite, found by its keys before any text is met."""
    c = S.chunks(spark, sf_dir)
    pos = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(NEXT).cast("long"))).alias("pos")
    q = S.table(spark, sf_dir, "documents").filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("question_id"), pos)
    q = q.withColumn("id", F.col("question_id") + F.col("pos")).withColumn("evidence_id", F.col("id").cast("string"))
    if of is not None:
        q = q.join(of.select("question_id", F.explode("citations").alias("evidence_id")), ["question_id", "evidence_id"], "left_semi")
    facts = c.select("id", "document_code", "section", "product", "doc_role", "contains_pii", F.when(F.col("id") % 9 == 0, "claims").otherwise("corpus").alias("source_kind"), "text")
    return q.join(facts, "id").drop("id")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = evidence(spark, sf_dir).filter("pos = 1").select("question_id", F.col("evidence_id").alias("e"), F.col("text").alias("t"))
    k = F.col("question_id")
    none = F.array().cast("array<string>")
    q = questions(spark, sf_dir).filter("question_id % 8 <> 7").join(first, "question_id", "left")
    cites = F.when(k % 6 == 0, F.array(F.lit("forged"), F.col("e"))).when(k % 6 == 1, none).otherwise(F.array_compact(F.array("e")))
    return q.select("question_id", F.when(k % 17 == 3, "refused").when(k % 17 == 5, "needs_clarification").otherwise("answered").alias("outcome"), F.when(k % 4 == 0, F.col("question")).otherwise(F.coalesce("t", F.lit(""))).alias("answer"), cites.alias("citations"))


def inputs(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """``only``: of the drafts for which it holds."""
    d = drafts(spark, sf_dir) if only is None else drafts(spark, sf_dir).filter(only)
    return G.gate_inputs(questions(spark, sf_dir), evidence(spark, sf_dir), d, evidence(spark, sf_dir, d))


@query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def e1_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")
def e1_fold_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    return S.table(spark, sf_dir, "documents").select("doc_id", X.fold_any(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, array_to_string(list_sort({_TERMS.format('text')}), ' ') AS terms FROM documents")
def e2_content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.content_terms(F.col("text"))), " ").alias("terms"))


@query(S.sql("chunks", _BASE + rf" SELECT question_id, regexp_matches({_FOLD.format('question')}, '{X.PII_REQUEST}') AS asks FROM gq"))
def e3_personal_data_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", G.asks_personal_data(F.col("question")).alias("asks"))


@query(S.sql("chunks", _FACTS + " SELECT question_id, carries_pii, array_to_string(coalesce(products, []), ',') AS products, n_evidence FROM fa"))
def e4_e6_evidence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence_facts(evidence(spark, sf_dir)).withColumn("products", F.array_join("products", ","))


@query(S.sql("chunks", _GATES + " SELECT question_id, pii_request, ambiguous FROM ga"))
def e5_e8_question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.question_gates(questions(spark, sf_dir), G.evidence_facts(evidence(spark, sf_dir))).select("question_id", "pii_request", "ambiguous")


@query(S.sql("chunks", _BASE + rf" SELECT question_id, regexp_matches({_FOLD.format('question')}, '\b(auto|residencial|empresarial)\b') AS names FROM gq"))
def e7_names_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", G.names_product(F.col("question")).alias("names"))


@query(S.sql("chunks", _RATIO + " SELECT question_id, round(ratio, 6) AS ratio, ratio >= 0.8 AS supported FROM ra"))
def e9_e11_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drafts(spark, sf_dir)
    r = G.grounded(d, G.cited(d, evidence(spark, sf_dir, d)))
    return r.select("question_id", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= G.SUFFICIENT).alias("supported"))


@query(S.sql("chunks", _CITED + " SELECT question_id, ordinal::INT AS ordinal, evidence_id, found FROM ci"))
def e12_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cited(drafts(spark, sf_dir), evidence(spark, sf_dir)).select("question_id", "ordinal", "evidence_id", "found")


@query(S.sql("chunks", _JUDGED + f""" SELECT question_id, CASE WHEN pii_request THEN 'refused' WHEN outcome <> 'answered' THEN outcome WHEN ambiguous THEN 'needs_clarification' WHEN NOT cites OR NOT supported THEN 'refused' ELSE 'answered' END AS final_outcome,
 CASE WHEN pii_request THEN '{G.PII_REFUSAL}' WHEN outcome <> 'answered' THEN nullif({_red('answer')}, '') WHEN ambiguous THEN {_CL} WHEN NOT cites THEN '{G.CITATION_REFUSAL}' WHEN NOT supported THEN '{G.UNSUPPORTED_REFUSAL}' ELSE {_red('answer')} END AS final_text FROM ju"""))
def e13_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judge(inputs(spark, sf_dir), S.PHONE).select("question_id", "final_outcome", "final_text")


@query(f"""SELECT doc_id, CASE WHEN length(f) > 240 THEN substr(f, 1, 237) || '...' ELSE f END AS snippet FROM (SELECT doc_id, trim(regexp_replace({_red('text')}, '\\s+', ' ', 'g')) AS f FROM documents)""")
def e14_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), phone=S.PHONE).alias("snippet"))


@query(S.sql("chunks", _FACTS + f" SELECT question_id, {_CL} AS clarification FROM fa WHERE len(products) > 0"))
def e15_clarification(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.evidence_facts(evidence(spark, sf_dir)).filter(F.size("products") > 0)
    return f.select("question_id", G.clarification(F.col("products")).alias("clarification"))


@query(S.sql("chunks", _FACTS + """ SELECT q.question_id, CASE WHEN n_evidence IS NULL THEN 'failed' WHEN carries_pii THEN 'refused' ELSE 'answered' END AS outcome,
 CASE WHEN n_evidence IS NOT NULL AND NOT carries_pii THEN n_evidence ELSE 0 END AS n_excerpts FROM gq q ANTI JOIN dr ON dr.question_id = q.question_id LEFT JOIN fa ON fa.question_id = q.question_id"""))
def e16_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degraded(questions(spark, sf_dir), evidence(spark, sf_dir), drafts(spark, sf_dir))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of drafts; some cut off, some not a draft."""
    d, k = drafts(spark, sf_dir), F.col("question_id")
    body = F.to_json(F.struct("outcome", "answer", F.transform("citations", lambda c: F.struct(c.alias("evidence_id"))).alias("citations")))
    body = F.when(k % 5 == 0, F.substring(body, 1, 15)).when(k % 7 == 0, F.lit('{"type": "object", "properties": {}}')).otherwise(body)
    return d.select("question_id", body.alias("body"), (k % 10 == 0).alias("truncated"), k.alias("k"))


@query(S.sql("chunks", _BASE + """ SELECT question_id, CASE WHEN question_id % 10 = 0 THEN 'refused' WHEN question_id % 5 = 0 OR question_id % 7 = 0 THEN 'failed' ELSE 'draft' END AS status,
 CASE WHEN question_id % 10 = 0 THEN 'refused' WHEN question_id % 5 = 0 OR question_id % 7 = 0 THEN NULL ELSE outcome END AS outcome,
 CASE WHEN question_id % 10 = 0 OR question_id % 5 = 0 THEN NULL WHEN question_id % 7 = 0 THEN 'properties,type' END AS keys FROM dr"""))
def e17_parse_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.parse_drafts(completions(spark, sf_dir)).select("question_id", "status", "outcome", F.nullif("keys", F.lit("")).alias("keys"))


_BLOCK = _BASE + """, bl AS (SELECT question_id, coalesce('<claims_database>' || chr(10) || string_agg('### evidence_id=' || evidence_id || ' query=' || section || ' product=' || product || chr(10) || text, chr(10) ORDER BY pos) FILTER (source_kind = 'claims') || chr(10) || '</claims_database>' || chr(10) || chr(10), '')
 || '<retrieved_corpus>' || chr(10) || coalesce(string_agg('### evidence_id=' || evidence_id || ' document=' || document_code || ' section=' || section || ' product=' || product || chr(10) || text, chr(10) ORDER BY pos) FILTER (source_kind <> 'claims'), '') || chr(10) || '</retrieved_corpus>' AS block FROM ev GROUP BY 1)"""


@query(S.sql("chunks", _BLOCK + " SELECT question_id, sha256(block) AS block_sha256, length(block) AS n_chars FROM bl"))
def e18_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence_block(evidence(spark, sf_dir)).select("question_id", F.sha2("block", 256).alias("block_sha256"), F.length("block").cast("long").alias("n_chars"))


@query(S.sql("chunks", _BLOCK + r" SELECT question_id, substr(sha256(block), 1, 12) AS prompt_hash, array_to_string(regexp_extract_all(block, 'evidence_id=(\S+)', 1), ',') AS evidence_ids FROM bl"))
def e19_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.prompt_fingerprint(G.evidence_block(evidence(spark, sf_dir)).withColumnRenamed("block", "prompt"))
    return p.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_B = "CASE WHEN pii_request THEN 'refused' WHEN outcome <> 'answered' THEN outcome "


@query(S.sql("chunks", _JUDGED + f""" SELECT question_id, {_B} WHEN ambiguous THEN 'needs_clarification' WHEN NOT cites OR NOT supported THEN 'refused' ELSE 'answered' END AS today,
 {_B} WHEN NOT cites OR NOT supported THEN 'refused' WHEN ambiguous THEN 'needs_clarification' ELSE 'answered' END AS support_first,
 {_B} WHEN ambiguous AND NOT supported THEN 'refused' WHEN ambiguous THEN 'needs_clarification' WHEN NOT cites OR NOT supported THEN 'refused' ELSE 'answered' END AS whole_set FROM ju"""))
def e20_gate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate_orders(inputs(spark, sf_dir).withColumn("ratio_all", F.col("ratio")))


@query(S.sql("chunks", _BASE + " SELECT count(*) AS n, round(avg((question_id % 5 <> 0 AND question_id % 7 <> 0)::INT), 6) AS rate FROM dr"))
def e21_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.conformance(completions(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(S.sql("chunks", _BASE + """, ids AS (SELECT q.question_id, list(e.evidence_id ORDER BY e.pos) FILTER (e.evidence_id IS NOT NULL) AS ids FROM gq q LEFT JOIN ev e ON e.question_id = q.question_id GROUP BY 1)
 SELECT question_id, CASE WHEN ids IS NULL THEN 'refused' ELSE 'answered' END AS outcome, CASE WHEN list_contains(ids, '2') THEN '2' ELSE ids[1] END AS cited FROM ids"""))
def e22_rule_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = evidence(spark, sf_dir).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    rows = questions(spark, sf_dir).select("question_id").join(ids, "question_id", "left")
    return G.rule_drafts(rows, "2", F.lit("answer")).select("question_id", "outcome", F.get("citations", 0).alias("cited"))
