"""The chunks that a question expects come with their columns: all chunks are not joined again, and a row has its own code."""

import pyarrow as pa
import pyarrow.parquet as pq

from cairn.operators.metrics import recall
from cairn.plans import registry  # noqa: F401  (loads the plans, each once)
from cairn.plans import retrieval as PR


def test_expected_has_no_join_and_each_row_its_own_code(spark, tmp_path):
    docs = [(1, "has the Phrase here", "a"), (1, "another row of that id", "b"), (2, "the phrase", None), (3, "none", "c"), (None, "THE PHRASE", "d"), (4, None, "e")]
    docs = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": ["en"] * len(docs), "source": [d[2] for d in docs]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([7, 8], pa.int64()), "text": ["the phrase", "not there"]}), tmp_path / "benchmark.parquet")
    got = PR.expected(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == [(7, 1, "a"), (7, 2, None), (7, None, "d")]
    # as the SQL counts: distinct values that are not null
    ranked = spark.createDataFrame([(7, 1, "a"), (7, 3, "d")], "question_id long, id long, document_code string")
    assert [tuple(r) for r in recall(ranked, got, "document_code").collect()] == [(7, 2, 2, True)]
    assert [tuple(r) for r in recall(ranked, got, "id").collect()] == [(7, 2, 1, False)]
