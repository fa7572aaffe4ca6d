"""Sources and sinks: corpora, evaluation files, the embedding cache, and the chunk index."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = r"===== PAGE \d+ ====="
CACHE = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "model", "vector")])
CASE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("id", "pergunta", "resposta_esperada", "grade", "family")),
    *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("docs", "needs", "must_contain", "must_not_contain", "must_cite", "must_not_match", "forbidden_strings", "traps")),
    T.StructField("must_be_refusal", T.BooleanType()),
])
RUN = "run int, tag string, records array<struct<case_id:string, grade:string, run:int, question:string, status_code:int, outcome:string, answer:string, citations:array<struct<evidence_id:string, document_code:string, section:string>>, meta:struct<provider:string, model:string, latency_ms:int, cost_usd:double, usage:struct<prompt_tokens:int, cached_prompt_tokens:int, completion_tokens:int>, degraded:boolean, reason:string>, elapsed_s:double, checks:array<struct<name:string, scope:string, passed:boolean, detail:string>>, deterministic_pass:boolean, hard_gates_pass:boolean, suspected_replay:boolean>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A1: doc, page, line_no, text of text files whose pages are marked; what stands before the first mark is page 0."""
    files = spark.read.text(path, wholetext=True).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    pages = files.select("doc", F.posexplode(F.split("value", PAGE)).alias("page", "body"))
    rows = pages.select("doc", "page", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    return rows.select("doc", "page", (F.col("i") + 1).alias("line_no"), "text")


def split_by_header(docs: DataFrame, header: str) -> tuple[DataFrame, DataFrame]:
    """A2: documents with the header, and those without it, to be set aside."""
    has = F.coalesce(F.col("text").rlike(header), F.lit(False))
    return docs.filter(has), docs.filter(~has)


def read_relational(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A4: a table, read-only, with the listed columns alone."""
    return spark.read.parquet(path).select(*columns)


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A5: one row a record of every run: a file a run, or with ``lines`` a line a run."""
    return spark.read.schema(RUN).json(path, multiLine=not lines).select("tag", F.explode("records").alias("r")).select("tag", "r.*")


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Golden and authored cases, a list a file, or with ``lines`` a line each; keys that a case lacks are null."""
    return spark.read.schema(CASE).json(path, multiLine=not lines)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Name, value of ``name: number`` lines; comments, sections and blank lines are left out, of equal names the largest value counts."""
    pattern = r"^\s*([A-Za-z0-9_.@-]+)\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:#.*)?$"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.groupBy(F.regexp_extract("value", pattern, 1).alias("name")).agg(F.max(F.regexp_extract("value", pattern, 2).cast("double")).alias("value"))


def bounds(table: DataFrame, *names: str) -> dict[str, float]:
    """The named thresholds of a table (name, value); a missing one is an error, not a pass."""
    found = dict(table.filter(F.col("name").isin(*names)).select("name", "value").collect())  # as many as names
    if missing := set(names) - set(found):
        raise KeyError(f"no threshold {', '.join(sorted(missing))}")
    return found


def thresholds(spark: SparkSession, values: Mapping[str, float]) -> DataFrame:
    """A one-row table of thresholds."""
    return spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{k} double" for k in values))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(encoded: pd.Series) -> pd.Series:
    """Little-endian float32 in base64."""
    import base64

    return encoded.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))


@F.pandas_udf(T.StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """The reverse of ``decode_vector``."""
    import base64

    return vectors.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


def read_cache(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Key, vector of the cached rows of this model and dimension."""
    rows = spark.read.schema(CACHE).json(path).filter(F.col("model") == model)
    return rows.select("key", decode_vector("vector").alias("vector")).filter(F.size("vector") == dim)


def append_cache(rows: DataFrame, path: str) -> None:
    """A10: appends to the cache."""
    rows.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """New rows replace old ones by key, but a null in ``keep`` leaves the old value."""
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    both = o.alias("o").join(n.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in (key, *keep) else F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(value(c).alias(c) for c in old.columns))


def plant(chunks: DataFrame, rows: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Inserts or replaces rows."""
    return chunks.join(rows, key, "left_anti").unionByName(rows)


def remove(chunks: DataFrame, ids: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Deletes rows by id."""
    return chunks.join(ids, key, "left_anti")


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result, written at once; a second write replaces the first."""
    df.write.mode("overwrite").format(fmt).save(path)
