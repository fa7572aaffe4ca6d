"""H1, H2, C20: which texts hold which of many phrases, in one pass over the texts.

Phrases go to the tasks in blocks of bounded size; each task builds the automaton of a block (Aho and Corasick, 1975) and streams its texts
through it, so that a text is read once a block however many phrases there are, short ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of phrases in a block; their automaton takes some hundred bytes for each.
BLOCK_CHARS = 500_000


def _held(phrases: list[tuple[int, str]]):
    """An Arrow function of text, id and further columns: a row for each text and phrase in it, with its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, of = ahocorasick.Automaton(), {}
        for i, phrase in phrases:
            of.setdefault(phrase, []).append(i)
        everywhere = of.pop("", [])
        for phrase, ids in of.items():
            automaton.add_word(phrase, (phrase, ids))
        automaton.make_automaton()
        for batch in batches:
            asked, at = [], []
            for i, text in enumerate(batch.column(0)):
                if (t := text.as_py()) is None:
                    continue
                found = dict(own for _, own in automaton.iter(t)) if of else {}
                held = [*everywhere, *(k for own in found.values() for k in own)]
                asked += held
                at += [i] * len(held)
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), *own], names=["question_id", *batch.schema.names[1:]])

    return run


def holding(texts: DataFrame, phrases: DataFrame, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """question_id, id: each phrase (question_id, question) and each text (id, text) that holds it, whatever the case of letters.

    A null holds nothing and is in nothing; an empty phrase is in every text. Repeated rows give repeated results. The driver reads one block of phrases at a time.
    ``keep``: columns of the texts that come along, so that what is found need not meet all texts again.
    """
    low = phrases.filter("question IS NOT NULL").select(F.col("question_id").cast("long").alias("question_id"), F.lower("question").alias("q"))
    size = low.agg(F.sum(F.length("q") + 1)).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    own = texts.select(F.lower("text").alias("text"), F.col("id").cast("long").alias("id"), *keep)
    schema = T.StructType([T.StructField("question_id", T.LongType()), *own.schema.fields[1:]])
    found = None
    for i in range(blocks):
        rows = [(r[0], r[1]) for r in low.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()]
        one = own.mapInArrow(_held(rows), schema)
        found = one if found is None else found.unionByName(one)
    return found
