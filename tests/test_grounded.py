"""An answer meets the terms of its cited texts in one row, without a join on terms; texts that nobody cites are not met."""

from importlib import import_module

from pyspark.sql import functions as F

from cairn.operators import gates as G
from cairn.plans import registry


def test_ratios_without_a_join_on_terms(spark):
    drafts = spark.createDataFrame(
        [(1, "answered", "Seguro cobre incendio zebra", ["a", "b", "a"]), (2, "answered", "", ["a"]), (3, "answered", "palavra qualquer", []), (4, "answered", None, ["x"]), (5, "answered", "palavra seguros", ["forged", "n"])],
        "question_id long, outcome string, answer string, citations array<string>",
    )
    evidence = spark.createDataFrame(
        [(1, "a", "segurou tudo", "parte 1"), (1, "b", "Incêndio 2024", "parte 2"), (1, "c", "zebra cobre", "parte 3"), (2, "a", "nada", "parte"), (5, "n", None, "palavra")],
        "question_id long, evidence_id string, text string, section string",
    )
    got = G.grounded(drafts, G.cited(drafts, evidence))
    assert {r.question_id: r.ratio for r in got.collect()} == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.5}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan


def test_texts_of_cited_evidence_alone_are_met(spark, sf):
    PG = import_module("cairn.plans.gates")  # after the registry, which imports all plans
    assert "e9_e11_grounded" in registry.QUERIES
    d = PG.drafts(spark, sf)
    wanted = d.select("question_id", F.explode("citations").alias("evidence_id")).distinct()
    all_ = PG.evidence(spark, sf)
    want = all_.join(wanted, ["question_id", "evidence_id"], "left_semi").select("question_id", "evidence_id", "text").collect()
    got = PG.evidence(spark, sf, d).select("question_id", "evidence_id", "text").collect()
    assert sorted(got) == sorted(want) and 0 < len(want) < all_.count() / 2
