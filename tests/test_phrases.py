import numpy as np
import pytest

from cairn.operators.phrases import holding


@pytest.mark.parametrize("block", [500_000, 20])
def test_holding_equals_a_search_for_each_phrase(spark, block):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("aábß X"), n))
    texts = [(i, word(int(rng.integers(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (5, "aab")]
    phrases = [(k, word(int(rng.integers(1, 5)))) for k in range(30)] + [(30, None), (31, ""), (32, "b"), (32, "B"), (33, "Á")]
    got = holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "question_id long, question string"), block)
    expected = sorted((k, i) for i, t in texts for k, q in phrases if t is not None and q is not None and q.lower() in t.lower())
    assert sorted(map(tuple, got.collect())) == expected and expected
