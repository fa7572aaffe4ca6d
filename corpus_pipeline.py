"""Corpus pipeline: language ID, near duplicates, contamination, PII and mixing, in this order.

Every stage takes what the one before kept, whole. All but the last return the columns of ``documents``, and no others that
their input may have; the last returns the mix: how often each document is taken. Rows with the same doc_id are one
document: of several the near-duplicate stage keeps one, the first by text, whatever their texts. A null doc_id is no
copy of another. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, table
from cairn.llm.decontaminate import contaminated, find_passages, n_hit
from cairn.llm.language_id import UND, identify, train
from cairn.llm.mixing import mix
from cairn.llm.ngram_join import BROADCAST_ROWS, ngram_components
from cairn.llm.pii import mask_pii

#: SQL has no expectation-maximisation and no Newton steps; tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of an index shard: small, since tasks here share executors with what earlier stages left.
SHARD = 250_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is not listed: a broadcast where the list is small, else a shuffle join."""
    keys = Scratch(docs.sparkSession, "out").save(keys.distinct(), "keys")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: texts without letters, and null texts, go."""
    found = identify(docs, train(docs))
    return found.filter(F.col("lang_pred") != UND).select("row.*").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, and one row of each id."""
    scratch, docs = Scratch(spark, "near"), docs.select(*COLUMNS)
    found = scratch.save(ngram_components(docs).select("doc_id", "component_id"), "found")
    kept = _without(docs, found.filter("component_id < doc_id").select("doc_id"), "doc_id")
    twice = scratch.save(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not twice.take(1):
        return kept.select(*COLUMNS)
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    one = kept.join(twice, "doc_id", "left_semi").withColumn("k", first).filter("k = 1").drop("k")
    return _without(kept, twice, "doc_id").unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which less than a twentieth of the words are in benchmark passages."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark"), shard_tokens=SHARD).withColumn("n_hit", n_hit())
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    return _without(keyed, found.filter(contaminated()).select("key"), "key").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data masked."""
    return mask_pii(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document, with how many copies and words of it are taken."""
    return mix(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
