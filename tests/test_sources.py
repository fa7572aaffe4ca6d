import base64
import json

import numpy as np
import pytest

from cairn.sources import index


def test_corpus_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head\n===== PAGE 1 =====\nx\ny\n===== PAGE 2 =====\nz")
    got = [(r.doc, r.page, r.text) for r in index.read_corpus(spark, str(tmp_path)).filter("page > 0 AND text <> ''").orderBy("page", "line_no").collect()]
    assert got == [("a.txt", 1, "x"), ("a.txt", 1, "y"), ("a.txt", 2, "z")]


def test_runs_and_cases(spark, tmp_path):
    (tmp_path / "run-1.json").write_text(json.dumps({"run": 1, "tag": "t", "records": [{"case_id": "a", "run": 1, "outcome": None, "checks": [{"name": "n", "passed": True}]}, {"case_id": "b", "run": 1, "meta": {"provider": "p"}}]}))
    got = index.read_runs(spark, str(tmp_path / "run-*.json")).orderBy("case_id").collect()
    assert [(r.case_id, r.outcome, r.meta and r.meta.provider) for r in got] == [("a", None, None), ("b", None, "p")]
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "x", "must_contain": ["a"]}, {"id": "y", "must_be_refusal": True}]))
    got = {r.id: (r.must_contain, r.must_be_refusal) for r in index.read_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"x": (["a"], None), "y": (None, True)}


def test_cache_keeps_model_and_dimension(spark, tmp_path):
    code = lambda *v: base64.b64encode(np.array(v, "<f4").tobytes()).decode()
    rows = [("k1", "m", code(1, 2)), ("k2", "m", code(1)), ("k3", "other", code(1, 2))]
    index.append_cache(spark.createDataFrame(rows, index.CACHE), str(tmp_path / "c"))
    assert [(r.key, r.vector) for r in index.read_cache(spark, str(tmp_path / "c"), "m", 2).collect()] == [("k1", [1.0, 2.0])]


def test_upsert_keeps_old_vectors_and_thresholds_make_a_row(spark, tmp_path):
    s = "id int, t string, embedding array<double>"
    old, new = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], s), spark.createDataFrame([(2, None, None), (3, "c", None)], s)
    assert sorted(map(tuple, index.upsert(old, new).collect())) == [(1, "a", [1.0]), (2, None, [2.0]), (3, "c", None)]
    assert index.thresholds(spark, {"recall": 0.88}).first().recall == 0.88
    index.write_result(old, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_thresholds_of_a_file(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("budget:\n  p50_latency_s: 4.0  # seconds\n  cost: 0.05\n\n# rate: 9\nrecall@5: 0.88\nname: text\n")
    assert {r.name: r.value for r in index.read_thresholds(spark, str(tmp_path / "t.yaml")).collect()} == {"p50_latency_s": 4.0, "cost": 0.05, "recall@5": 0.88}


def test_bounds_of_gates_come_from_the_table(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("a: 1\nb: 0.5\n")
    t = index.read_thresholds(spark, str(tmp_path / "t.yaml"))
    assert index.bounds(t, "b") == {"b": 0.5}
    with pytest.raises(KeyError, match="c"):
        index.bounds(t, "a", "c")
