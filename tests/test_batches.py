"""Queries that take texts through Arrow functions bound the rows of a batch; the fold of single texts is that of whole columns."""

import pandas as pd
import pytest

from cairn.functions import text as X
from cairn.plans import registry

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["e1_fold_any", "b20_chunk_ids", "h24_grader_prompts"])
def test_batches_of_texts_are_small(spark, sf, name):
    spark.conf.set(KEY, "10000")
    registry.QUERIES[name](spark, sf)
    assert int(spark.conf.get(KEY)) == X.ARROW_ROWS


def test_fold_any_of_odd_texts():
    got = X.fold_any.func(pd.Series(["", None, "Ação Ünï—x", "ﬁn Ⅳ ǅ", "漢字 a"], dtype=object)).tolist()
    assert got == ["", None, "acao uni x", "fin iv dz", "a"]
