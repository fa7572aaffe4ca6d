"""Plans meet the columns of texts, not texts; few plans and many give the same rows."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import facts as D
from cairn.plans import registry
from cairn.sources.scratch import CLEANUP, stored

DAY = datetime.date(2024, 1, 1)


def odd(spark):
    policies = [(1, "A", 1.0, "AP-AUTO-000001"), (2, "B", 2.0, "AP-AUTO-000001"), (3, None, None, "AP-AUTO-000003"), (4, "D", 4.0, None)]
    claims = [(i, 1 + i % 2, f"SIN-2024-{i % 40:06d}", "t", "F", DAY + datetime.timedelta(i % 30), 1000.5 * i) for i in range(80)]
    claims += [(90, 4, "SIN-2024-000003", "t", None, None, None), (91, 9, "SIN-2024-000004", "t", "F", DAY, 1.0), (92, None, "SIN-2024-000005", "t", "F", DAY, 1.0), (93, 4, None, "t", "F", DAY, 1.0)]
    paid = [(i % 50, i % 3, 10.0 * (i % 7), DAY + datetime.timedelta(i % 4), "FO"[i % 2]) for i in range(120)] + [(60, 1, None, DAY, "F"), (61, 1, 5.0, None, None), (None, 1, 5.0, DAY, "F")]
    keys = [f"SIN-2024-{i:06d}" for i in range(42)] + ["AP-AUTO-000001", "AP-AUTO-000003", "AP-AUTO-000009", None]
    names = ("get_claim", "get_claim_payment", "get_policy", "list_claims_by_policy", "claims_summary", None)
    plans = [(n, s, q, k) for n, k in enumerate(keys) for s, q in enumerate(names)] * 2
    return (
        spark.createDataFrame(plans, "question_id long, step long, query string, key string"),
        spark.createDataFrame(claims, "claim_id long, policy_id long, claim_number string, claim_type string, status string, occurrence_date date, claim_amount double").repartition(3),
        spark.createDataFrame(policies, "policy_id long, product string, annual_premium double, policy_number string"),
        spark.createDataFrame(paid, "claim_id long, payment_no int, paid_amount double, payment_date date, payment_type string").repartition(3),
    )


@pytest.mark.parametrize("with_payments", [True, False])
def test_few_and_many_plans_of_odd_tables(spark, monkeypatch, with_payments):
    plans, claims, policies, paid = odd(spark)
    run = lambda: sorted(map(tuple, D.execute(plans, claims, policies, paid if with_payments else None).collect()), key=str)
    few = run()
    monkeypatch.setattr(D, "FEW_PLANS", 0)
    assert run() == few
    of = lambda q, k: [r[4] for r in few if r[2:4] == (q, k)]
    assert len(of("get_claim", "SIN-2024-000003")) == 6 and len(of("get_policy", "AP-AUTO-000001")) == 4  # numbers that two or three rows have, asked twice
    assert len(set(of("list_claims_by_policy", "AP-AUTO-000001"))) == 1 and of("list_claims_by_policy", "AP-AUTO-000001")[0].count("claim_number") == 40  # 20 of each policy
    assert of("claims_summary", "SIN-2024-000001") == ["sinistro não encontrado: SIN-2024-000001"] * 2 and of("get_policy", None) == [None, None]
    assert of("list_claims_by_policy", "AP-AUTO-000003") == ["nenhum sinistro nesta apólice: AP-AUTO-000003"] * 2
    assert len(of("get_claim_payment", "SIN-2024-000041")) == (2 if with_payments else 0)


def test_no_text_is_shuffled(spark, sf):
    plan = registry.QUERIES["d18_execute"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, (key#") == plan.count("Join ") == 3 and "Window" not in plan  # three kinds of plans, by key; the tables were joined and stored before


def test_shuffle_files_of_stored_rows_go(spark):
    names = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    before = names()
    found = stored(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("v")), "own")
    assert found.select(F.sum(F.size("v"))).first()[0] == 10_000 and spark.conf.get(CLEANUP) == "false"
    late = time.time() + 10
    while (left := {n for n in names() - before if n.endswith(".data")}) and time.time() < late:
        time.sleep(0.2)
    assert len(left) <= 1  # what the sum of sizes itself has shuffled
