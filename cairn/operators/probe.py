"""A Bloom filter of stored keys in front of the joins with a cache.

The filter is a table of blocks: a key belongs to one block and sets two bits in each of its four numbers, so that a key is
looked up by one join and the blocks are made by ``bit_or``, combined before the shuffle. It never misses a stored key. Its size follows the number of
keys, is known before it is broadcast, and has a bound; of more keys there is no filter, and all rows go through the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.retrieval import cache_key

#: Keys of a block, its numbers, and blocks at most: 2^19 of about 100 bytes each are broadcast, for 8 million keys.
BLOCK_KEYS, WORDS, MOST_BLOCKS = 16, 4, 1 << 19


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each number of its block: two of 64, places taken from the bytes of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def key_filter(keys: DataFrame, key: str = "key", most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int] | None:
    """The blocks that have a key, (block, w0 .. w3), and how many blocks there may be; None if the keys need more than ``most_blocks``.

    Null keys are left out. ``keys`` is read twice, that column alone.
    """
    keys = keys.select(key).filter(F.col(key).isNotNull())
    blocks = max(1, -(-keys.count() // BLOCK_KEYS))
    if blocks > most_blocks:
        return None
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def probed(rows: DataFrame, made: tuple[DataFrame, int] | None, key: str = "key") -> DataFrame:
    """The rows with ``maybe``: false only if the key is not stored (or null). The blocks are broadcast; the rows are not shuffled."""
    if made is None:
        return rows.withColumn("maybe", F.col(key).isNotNull())
    table, blocks = made
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("own")  # names of the rows cannot clash with those of the blocks
    at = rows.select(own, _block(F.col(key), blocks).alias("at")).join(F.broadcast(table), F.col("at") == F.col("block"), "left")
    has = F.col(f"own.{key}").isNotNull()
    for i, m in enumerate(_masks(F.col(f"own.{key}"))):
        has = has & (F.col(f"w{i}").bitwiseAND(m) == m)
    return at.select("own.*", F.coalesce(has, F.lit(False)).alias("maybe"))


def probed_split(texts: DataFrame, cache: DataFrame, model: str, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C17: (id, key, vector) that the cache holds; the distinct (key, text) it misses; and how many rows met what.

    The results are those of ``cache_split``. Two filters stand in front: of the cache's keys over the texts, whose sure misses do
    not meet the cache at all, and of the texts' keys over the cache, whose other vectors are not shuffled. Only keys and ids
    go through the joins: a text is taken along by misses alone. Rows: n_texts, n_maybe (that meet the cache), n_cache, n_cache_maybe (that meet the texts).
    """
    keyed = texts.withColumn("key", cache_key(F.lit(model), F.col("text")))
    asked = probed(keyed, key_filter(cache, "key", most_blocks))
    held = probed(cache, key_filter(keyed.select("key").distinct(), "key", most_blocks))
    some = held.filter("maybe").select("key", "vector")
    hits = asked.filter("maybe").select("id", "key").join(some, "key").select("id", "key", "vector")
    sure = asked.filter("NOT maybe").select("key", "text")
    missed = asked.filter("maybe").select("key", "text").join(some.select("key"), "key", "left_anti")
    # texts of one key are equal, so any stands for all: combined before the shuffle
    misses = sure.unionByName(missed).groupBy("key").agg(F.first("text").alias("text"))
    count = lambda df, a, b: df.agg(F.count("*").alias(a), F.count_if("maybe").alias(b))
    met = count(asked, "n_texts", "n_maybe").crossJoin(count(held, "n_cache", "n_cache_maybe"))  # of one row each
    return hits, misses, met
