import pytest
from pyspark.sql import functions as F

from cairn.operators import facts as D
from cairn.operators import gates as G
from cairn.operators import retrieval as R


def test_cap_order(spark):
    rows = [("a1", "A", 1.0), ("a2", "A", 0.9), ("a3", "A", 0.8), ("n1", "N", 0.7), ("p1", "P", 0.6)]
    df = spark.createDataFrame([(1, *r) for r in rows], "question_id int, id string, document_code string, score double")
    assert [r.id for r in R.capped(df).orderBy("rank").collect()] == ["a1", "a2", "n1", "p1"]
    assert [r.id for r in R.capped(df, 3, 0).orderBy("rank").collect()] == ["a1", "a2", "a3"]


def test_boost_breaks_ties(spark):
    df = spark.createDataFrame([(1, "g", "glossary", 1.0), (1, "n", "normative", 1.0), (1, "p", "pointer", 1.0), (1, "x", "?", 0.5)], "question_id int, id string, doc_role string, score double")
    assert [r.id for r in R.top(R.role_boost(df), 9).orderBy("rank").collect()] == ["n", "p", "g", "x"]


def test_fusion_and_arms(spark):
    arm = lambda *ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "question_id int, id string, rank int")
    got = {r.id: r.score for r in R.fuse(arm("a", "b"), arm("b")).collect()}
    assert got == {"a": round(1 / 16, 9), "b": round(1 / 17 + 1 / 16, 9)}
    with pytest.raises(ValueError):
        R.arms("vector", arm("a"), None)
    with pytest.raises(ValueError):
        R.arms("other", arm("a"), arm("a"))


def test_fill_encodes_each_text_once_and_checks_dimensions(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string")
    cache = texts.filter("id = 1").select(R.cache_key(F.lit("m"), F.col("text")).alias("key"), F.array(F.lit(9.0).cast("float")).alias("vector"))
    got = {r.id: r.vector for r in R.fill(texts, cache, "m", lambda t: [[float(len(x))] for x in t], 1).collect()}
    assert got == {1: [9.0], 2: [1.0], 3: [1.0]}
    with pytest.raises(ValueError):
        R.fill(texts, cache, "m", None, 1)
    with pytest.raises(Exception, match="dimension"):
        R.fill(texts, cache, "m", lambda t: [[1.0, 2.0] for _ in t], 1).collect()


def test_vector_rank_leaves_out_nulls_and_zeros(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "question_id long, embedding array<float>")
    assert [(r.id, r.rank) for r in R.vector_rank(c, q).orderBy("rank").collect()] == [(1, 1), (4, 2)]


def test_bad_parameters_are_refused():
    with pytest.raises(ValueError):
        D.count_claims(None, None, None, status="Pago")
    with pytest.raises(ValueError):
        D.count_claims(None, None, None, paid=False, payment_type="Integral")
    with pytest.raises(ValueError):
        D.claims_of_policies(None, None, None, 21)


def test_route(spark):
    q = spark.createDataFrame([(1, "sin-2024-000001 e SIN-2024-000001?"), (2, "AP-RES-000001"), (3, "pagamento da AP-RES-000001"), (4, "regra?")], "question_id int, question string")
    got = [(r.question_id, r["query"]) for r in D.route(q).orderBy("question_id", "step").collect()]
    assert got == [(1, "get_claim"), (1, "get_claim_payment"), (2, "get_policy"), (3, "get_policy"), (3, "list_claims_by_policy")]


def test_gates(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["limite?", "limite no Auto?", "nomes completos?", "limite?", "limite?"])], "question_id int, question string")
    ev = lambda i, e, p, role="normative": (i, 1, e, "C", "1 Limite", p, role, False, "corpus", "o limite de vidros vale quinhentos")
    rows = [ev(0, "a", "Auto"), ev(0, "b", "Residencial"), ev(1, "a", "Auto"), ev(1, "b", "Residencial"), ev(2, "m", "All", "minutes"), ev(3, "a", "All"), ev(4, "a", "All")]
    e = spark.createDataFrame(rows, "question_id int, pos int, evidence_id string, document_code string, section string, product string, doc_role string, contains_pii boolean, source_kind string, text string")
    d = spark.createDataFrame([(0, "answered", "limite", ["a"]), (1, "answered", "limite vidros", ["a"]), (2, "answered", "limite", ["m"]), (3, "answered", "limite", ["forged", "a"]), (4, "answered", "desconto inventado", ["a"])], "question_id int, outcome string, answer string, citations array<string>")
    got = {r.question_id: r.final_outcome for r in G.judge(G.gate_inputs(q, e, d)).collect()}
    assert got == {0: "needs_clarification", 1: "answered", 2: "refused", 3: "refused", 4: "refused"}


def test_vector_blocks_give_the_same_ranks(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(40)]
    c = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = c.filter("id % 5 = 1").withColumnRenamed("id", "question_id")
    whole = sorted(map(tuple, R.vector_rank(c, q, 3).collect()))
    monkeypatch.setattr(R, "VECTOR_BLOCK", 64)
    assert sorted(map(tuple, R.vector_rank(c, q, 3).collect())) == whole and len(whole) == 24


def test_execute_without_payments_and_with_unknown_keys(spark):
    s = "claim_id long, policy_id long, claim_number string, claim_type string, status string, occurrence_date date, claim_amount double"
    claims = spark.createDataFrame([(1, 7, "SIN-2024-000001", "t", "Aberto", None, 10.0)], s)
    policies = spark.createDataFrame([(7, "AP-AUTO-000007", "Auto", 5.0)], "policy_id long, policy_number string, product string, annual_premium double")
    plans = spark.createDataFrame(
        [(1, 1, "get_claim", "SIN-2024-000001"), (1, 2, "get_claim_payment", "SIN-2024-000001"), (2, 1, "get_claim", "SIN-2024-000009"), (3, 1, "get_policy", "AP-AUTO-000009"), (3, 2, "list_claims_by_policy", "AP-AUTO-000007")],
        "question_id long, step long, query string, key string",
    )
    got = {(r.question_id, r.step): r.text for r in D.execute(plans, claims, policies, None).collect()}
    assert (1, 2) not in got and got[1, 1].startswith("claim_number: SIN-2024-000001") and got[2, 1] == "sinistro não encontrado: SIN-2024-000009"
    assert got[3, 1] == "apólice não encontrada: AP-AUTO-000009" and got[3, 2].endswith("paid_amount: nenhum pagamento")
