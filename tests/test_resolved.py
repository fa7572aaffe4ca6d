"""Resolved citations carry digests or packed texts, in the order of the texts."""

import hashlib

from pyspark.sql import functions as F

from cairn.operators import metrics as M
from cairn.plans import registry


def test_ties_of_an_ordinal_are_in_the_order_of_texts(spark):
    texts = {1: "zebra", 2: "apple", 3: None, 4: "mango é", 5: ""}
    chunks = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    cites = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (7, 1, 4), (7, 0, 4), (7, 2, 3), (7, 3, 99), (8, 1, 99), (9, 1, 5), (9, 1, 5)], "message_id long, ordinal int, evidence_id long")
    want = {7: (6, 4, ["mango é", "apple", "mango é", "zebra"]), 8: (1, 0, []), 9: (2, 2, ["", ""])}
    got = lambda df: {r.message_id: (r.requested, r.resolved, r.texts) for r in df.collect()}
    assert got(M.resolved(cites, chunks)) == want
    assert got(M.resolved(cites, chunks, M.packed("text")).withColumn("texts", M.unpacked("texts"))) == want
    digests = {k: (n, m, [hashlib.sha256(t.encode()).digest() for t in found]) for k, (n, m, found) in want.items()}
    assert {k: (n, m, [bytes(x) for x in found]) for k, (n, m, found) in got(M.resolved(cites, chunks, F.unhex(F.sha2("text", 256)))).items()} == digests


def test_texts_do_not_cross_a_shuffle_by_message(spark, sf):
    plan = registry.QUERIES["h23_resolved_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    by_message = plan[plan.index("RepartitionByExpression [message_id") :].split("\n")[1]
    assert "text" not in by_message and "value" in by_message


def test_a_text_crosses_once_for_each_range_of_messages(spark):
    texts = {1: "zebra", 2: "apple", 3: None, 4: "mango é", 5: ""}
    chunks = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    rows = [(m, o, 1 + (m * 7 + o * o) % 6) for m in range(1000) for o in (0, 1, 1, 2, 3)] + [(m, 1, 1 + m % 5) for m in range(1000)] + [(2000, 1, None), (2000, None, 1)]
    cites = spark.createDataFrame(rows, "message_id long, ordinal int, evidence_id long")
    sent = M.dealt(cites, 4)
    assert sent.filter("evidence_id IS NOT NULL").groupBy("evidence_id").count().agg(F.max("count")).first()[0] == 4  # not the 1000 citations or so of each
    assert sent.select(F.sum(F.size("cites"))).first()[0] == len(rows)
    assert sent.select("range", F.explode("cites.message_id").alias("m")).distinct().groupBy("m").count().agg(F.max("count")).first()[0] == 1
    got = lambda df: {r.message_id: (r.requested, r.resolved, r.texts) for r in df.collect()}
    want = got(M.resolved(cites, chunks))
    assert len(want) == 1001 and got(M.resolved_by_range(cites, chunks)) == want
    assert got(M.resolved_by_range(cites, chunks, 20_000)) == want


def test_prompts_get_texts_by_range(spark, sf):
    plan = registry.QUERIES["h24_grader_prompts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [message_id#" not in plan.split("Generate explode")[0]  # what is dealt by message still is a row a text and range
    assert "Sort [text" not in plan  # a sort by texts sends whole ones to the driver as samples


def test_a_citation_crosses_one_shuffle(spark, sf):
    plan = registry.QUERIES["h24_grader_prompts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "collect_list" not in plan  # texts are wanted by ranges, not by lists of citations


def test_ranges_of_odd_ids(spark):
    chunks = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "x"), (3, "")], "id long, text string").repartition(3)
    rows = [(m, o, e) for m in (None, -(2**62), 5, 2**62, 2**62 + 1) for o in (None, 1, 1, 2) for e in (1, 2, 3, 4, None)] + [(6, 0, 4)]
    cites = spark.createDataFrame(rows, "message_id long, ordinal int, evidence_id long").repartition(3)
    got = lambda df: {r.message_id: (r.requested, r.resolved, r.texts) for r in df.collect()}
    want = got(M.resolved(cites, chunks))
    assert want[5][:2] == (28, 12) and want[6] == (1, 0, [])
    assert got(M.resolved_by_range(cites, chunks)) == got(M.resolved_by_range(cites, chunks, 50)) == want
    named = cites.withColumn("message_id", F.concat(F.lit("m"), "message_id"))
    assert got(M.resolved_by_range(named, chunks)) == {k if k is None else f"m{k}": v for k, v in want.items()}
    assert M.resolved_by_range(cites.limit(0), chunks).collect() == []
