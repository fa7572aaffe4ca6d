"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct word 2-grams, hashed to 64 bits. One permutation: the range of hashes is cut into BINS equal
bins, and a bin's value is the smallest hash in it. An empty bin borrows from the first bin that has a value in its own fixed random order of
bins, so that every bin of two sets agrees with a probability of their Jaccard similarity. BANDS groups of ROWS bins
are the keys of buckets: two sets of similarity 0.8 share none with a probability of about (1 - 0.8^6)^48 = 5e-7, the only
way in which a link can be lost; more similar ones even less.

1. Equal sets are one. Buckets of one set are dropped.
2. Stars: each set of a bucket meets the bucket's centre among sets of about its size; one of the centre's component meets the centre of another
   component. The surest candidates of each set are confirmed on whole sets. After a few rounds most groups of copies
   are one component, at as many pairs as entries.
3. The rest: sets of a bucket's smaller components meet all that is in the bucket. Only pairs of different components, of sizes and
   with sketches that do not rule the similarity out, leave the join; all of them are confirmed on whole sets. Here each
   set also has the parities of its hashes in CELLS cells: two sets differ in no more of them than they have elements apart, so that this test loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, arrow_map, slices, table
from cairn.llm.components import components

#: Words of a shingle; least similarity in percent.
WIDTH, PERCENT = 2, 80
#: Bands, bins of a band, bins; one bit of each is kept, of which so many differ at most between two sets that link (five deviations).
BANDS, ROWS = 48, 6
BINS, DIFFER = BANDS * ROWS, 65
#: Parities of a set: two words or so a cell keep them telling.
CELLS = 2048
#: Rounds of stars, and candidates of a set that are confirmed in each.
ROUNDS, PARTNERS = 2, 2
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SHIFT = np.uint64(29)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD[0]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    return h ^ (h >> _SHIFT)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 2-grams; of the whole sequence if it has fewer words."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and the six white-space characters of ASCII
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WIDTH:
        return h
    out = np.zeros(len(h) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        out = _mixed(out + h[k : len(h) - WIDTH + 1 + k])
    return np.unique(out)


@lru_cache
def _orders() -> np.ndarray:
    """For each bin the places of all bins in its own order."""
    return np.random.default_rng(11).permuted(np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1)


def densified(values: np.ndarray) -> np.ndarray:
    """The value of every bin, of sorted distinct hashes, at least one."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    donors = full[np.argmin(_orders()[:, full], axis=1)]
    donors[full] = full
    own = np.zeros(BINS, np.uint64)
    own[full] = values[first]
    return own[donors]


def sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bands, and a bit of every bin, packed."""
    bins = densified(values) + np.arange(BINS, dtype=np.uint64) * _ODD[1]
    keys = np.zeros(BANDS, np.uint64)
    for column in bins.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + column)
    bits = np.zeros(64 * -(-BINS // 64), np.uint8)
    bits[:BINS] = (_mixed(bins) >> np.uint64(63)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def parities(values: np.ndarray) -> np.ndarray:
    """Whether each cell has an odd number of hashes, packed."""
    return np.packbits((np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1).astype(np.uint8)).view(np.int64)


def _uid(values: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63 if len(values) else None


_LONGS = pa.list_(pa.int64())
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("bands", _LONGS), ("bits", _LONGS)])
_COLUMNS = pa.schema([("uid", pa.int64()), ("columns", _LONGS), ("odd", _LONGS)])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingle_set(t.as_py())
            out.append((i, len(s), _uid(s), *(sketch(s) if len(s) and i is not None else (None, None))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of a batch, once."""
    for batch in slices(batches, 100):
        found = {_uid(s): (s.view(np.int64), parities(s)) for s in (shingle_set(t.as_py()) for t in batch.column(0)) if len(s)}
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array(c, _LONGS) for c in zip(*found.values()))], schema=_COLUMNS)


def _known(df: DataFrame) -> DataFrame:
    """Ids, broadcast where they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _differing(x: str, y: str, words: int):
    """Bits that differ between two arrays of so many numbers."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(words)), F.lit(0))


def _may(x: str, y: str):
    """Two sets that may link: of different components, sizes and bits not ruling it out."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    return (F.col(f"g{x}") != F.col(f"g{y}")) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (_differing(f"bits{x}", f"bits{y}", -(-BINS // 64)) <= DIFFER)


def _side(entries: DataFrame, x: str, *more: str) -> DataFrame:
    return entries.select("key", *more, F.col("uid").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "g", "bits", "odd")))


def _stars(entries: DataFrame, shift: float) -> DataFrame:
    """Pairs (a, b): up to PARTNERS centres b for each set a, those whose bits differ least, over all its buckets.

    Sizes go by classes of a quarter, moved by ``shift``. A centre is the set with the smallest number; a component's sets never meet their own.
    """
    e = entries.withColumn("k", F.floor(F.ln("n") / math.log(100 / PERCENT) + shift))
    best = e.groupBy("key", "k", "g").agg(F.min("uid").alias("uid"))
    one = best.groupBy("key", "k").agg(F.min(F.struct("uid", "g")).alias("p1"), F.count("*").alias("of")).filter("of > 1")
    two = best.join(one, ["key", "k"]).filter(F.col("g") != F.col("p1.g")).groupBy("key", "k", "p1").agg(F.min(F.struct("uid", "g")).alias("p2"))
    met = e.join(two, ["key", "k"]).withColumn("b", F.when(F.col("g") != F.col("p1.g"), F.col("p1.uid")).otherwise(F.col("p2.uid")))
    pairs = met.select(F.col("uid").alias("a"), "b").distinct()
    one_side = lambda x: entries.select(F.col("uid").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "g", "bits"))).dropDuplicates([x])
    both = pairs.join(one_side("a"), "a").join(one_side("b"), "b").filter(_may("a", "b"))
    differ = _differing("bitsa", "bitsb", -(-BINS // 64))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct(differ.alias("d"), "b"))), 1, PARTNERS)  # of BANDS at most
    return both.groupBy("a").agg(F.explode(nearest).alias("p")).select("a", "p.b")


def _rest(entries: DataFrame, odd: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that share a bucket and may link. ``odd``: uid, odd."""
    held = entries.groupBy("key", "g").agg(F.count("*").alias("m"))
    major = held.groupBy("key").agg(F.max(F.struct("m", "g")).alias("most"), F.count("*").alias("of")).filter("of > 1").select("key", F.col("most.g").alias("major"))
    some = entries.join(major, "key").join(odd, "uid")
    small = _side(some.filter("g <> major"), "a")
    every = _side(some.withColumn("large", F.col("g") == F.col("major")), "b", "large")
    # elements that only one of the two has, where the similarity is PERCENT
    apart = F.floor((F.col("na") + F.col("nb")) * (100 - PERCENT) / (100 + PERCENT))
    met = small.join(every, "key").filter(_may("a", "b") & (F.col("large") | (F.col("a") < F.col("b"))) & (_differing("odda", "oddb", CELLS // 64) <= apart))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The documents (a, b) of those pairs of sets that link, by their whole sets."""
    one = lambda x: sets.select(F.col("uid").alias(x), F.col("b").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("columns").alias(f"s{x}"))
    both = pairs.join(one("a"), "a").join(one("b").withColumnRenamed("b", "b_"), F.col("b") == F.col("b_"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select(F.col("da").alias("a"), F.col("db").alias("b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row; kept is the document with the smallest id of its component.

    A null, empty or blank text has an empty set and is linked with nothing. Rows with the same doc_id are one node: it is
    linked through any of their texts, and all of them are kept or none. A null doc_id is linked with nothing, its
    component_id is null, and it is kept. Other columns are not read. Shingles and whole sets are told apart by 64-bit hashes.
    No candidate is dropped; links are confirmed on whole sets.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    # 1. Sketches; a row for each set; entries of buckets that two sets or more have.
    all_rows = scratch.save(arrow_map(own, _sketched, "doc_id long, n long, uid long, bands array<long>, bits array<long>"), "rows")
    rows = all_rows.select("doc_id", "n", "uid")
    of_set = all_rows.filter("uid IS NOT NULL AND doc_id IS NOT NULL").groupBy("uid")
    sets = scratch.save(of_set.agg(F.min("doc_id").alias("b"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "sets")
    entries = sets.select("uid", F.posexplode("bands").alias("p", "band")).select(F.xxhash64("p", "band").alias("key"), "uid")
    several = entries.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).filter("lo <> hi").select("key")
    shared = scratch.save(entries.join(several, "key", "left_semi"), "shared")
    scratch.settle()

    # whole sets of those that have a bucket in common with another
    able = scratch.save(shared.select("uid").distinct().join(sets.select("uid", "b", "n", "bits"), "uid"), "able")
    ids = able.select(F.col("b").alias("doc_id")).distinct()
    texts = own.join(_known(ids), "doc_id", "left_semi").select("text")
    whole = arrow_map(texts, _sets, "uid long, columns array<long>, odd array<long>").groupBy("uid").agg(F.first("columns").alias("columns"), F.first("odd").alias("odd"))
    whole = scratch.save(whole.join(able.select("uid", "b", "n"), "uid"), "whole")
    scratch.settle()

    # 2. Equal sets, and rounds of stars.
    twice = sets.filter("m > 1").select("uid", "b")
    groups = components(scratch, rows.join(_known(twice), "uid").select(F.col("doc_id").alias("a"), "b").filter("a <> b"), "same")

    def placed() -> DataFrame:
        grouped = able.join(groups, F.col("b") == F.col("node"), "left").select("uid", "n", "bits", F.coalesce("component", "b").alias("g"))
        return shared.join(grouped, "uid").select("key", "uid", "n", "g", "bits")

    def united(found: DataFrame, name: str) -> DataFrame:
        return components(scratch, groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), name)

    for i in range(ROUNDS):
        found = scratch.save(_confirmed(_stars(placed(), i / 2), whole), f"star{i}")
        if not found.take(1):
            break
        groups = united(found, f"groups{i}")
    scratch.settle()

    # 3. What is left between components.
    found = scratch.save(_confirmed(scratch.save(_rest(placed(), whole.select("uid", "odd")), "pairs"), whole), "rest")
    if found.take(1):
        groups = united(found, "all")
    groups = scratch.save(groups, "groups")
    scratch.keep("rows", "groups")
    out = rows.join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2
           THEN list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i + 1], ' '))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
