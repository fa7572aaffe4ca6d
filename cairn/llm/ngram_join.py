"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are sets (equal sets are one row), columns are hashed word 5-grams. Two sets with Jaccard >= 3/4 share
1 + k columns among the first n - ceil(3n/4) + 1 + k of each in any common order of columns; these are the columns that
*lead*. Entries travel packed, as arrays of numbers in blocks of columns. Four steps, each exact:

1. In the order of hashes, with k = n/10, a block finds the leading columns that two sets or more have. A set with fewer
   of them than 1 + k of the smallest partner that its size allows links with nothing.
2. For the sets left, blocks of all their columns count how many sets have each. A set stays if 3/4 of its
   columns are shared. Its columns are put in order of frequency, rarest first, so that a passage that many documents
   share leads in few of them, and a copy with many changes is led by its own changes.
3. Each column multiplies its foremost set with all others; overlaps add up by pair, pairs that cannot reach what both
   sizes ask for are dropped, and the largest overlaps of each set are settled on all shared columns. After a few
   rounds most of every group of copies is one component, at as many pairs as sets.
4. The product between different components. Columns that the same sets have become one weighted column, ordered by
   frequency to weight. What two linked sets have in common starts, in this order, with a sequence of columns before which each passes over no
   more weight than it can miss; a set lists such sequences, each as long as needed to be in few sets. Sets
   meet by sequence, if their sizes and what each can still reach allow the overlap that both sizes ask for. The product of their weighted
   columns adds up overlaps by pair; pairs below the bound are dropped, the others are links. So a passage that many
   documents share pairs none of them; several in the same order of weight must agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, arrow_map, slices, table
from cairn.llm.components import components

#: Words in an n-gram.
WIDTH = 5
#: Entries that a task deals out at once; sets of one column there from which its frequency counts as this bound.
CHUNK, OFTEN = 1_000_000, 32
#: Rounds of products with the foremost set, and partners of a set that are settled in each.
ROUNDS, PARTNERS = 2, 2
#: Sets that a sequence of columns is expected in at most, were columns independent (they are not, hence so few);
#: sequences of a set, beyond which single columns lead it; ratio of the classes of sizes.
EXPECTED, SEQUENCES, CLASS = 1e-4, 512, 1.1
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Stands for "often" among the sets of a column; no set has this number.
_MARK = 0


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word 5-grams; of the whole sequence if it has fewer words."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and the six white-space characters of ASCII
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())] if len(h) else [], np.uint64)
    out = np.zeros(len(h) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        out = (out ^ h[k : len(h) - WIDTH + 1 + k]) * _ODD[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def lead(n: int) -> int:
    """How many columns lead in a set of n, by hash."""
    return n - (3 * n + 3) // 4 + 1 + n // 10 if n else 0


#: What is dealt out: a document and its set (doc_id, n, uid), or packed entries (c, uids), whose frequency is known to be OFTEN or not.
_DEAL = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("c", pa.binary()), ("uids", pa.binary()), ("df", pa.binary())])
_DEAL_SQL = "bucket int, doc_id long, n long, uid long, c binary, uids binary, df binary"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("uid", pa.int64()), ("shared", pa.int64())])
_SHARED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("columns", pa.list_(pa.int64()))])


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch whose other columns are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _at(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(buckets)).astype(np.uint16)


def _packed(key: np.ndarray, buckets: int, **arrays: np.ndarray) -> pa.RecordBatch:
    """Packed rows of the arrays, dealt by a key."""
    at = _at(key, buckets)
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
    rows = {name: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for name, x in ((name, x[order]) for name, x in arrays.items())}
    return _batch(_DEAL, bucket=at[cuts[:-1]].astype(np.int32), **rows)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The starts of runs of equal keys, and the end."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.r_[np.flatnonzero(new), len(new)]


def _deal(leading: bool, buckets: int):
    """An Arrow function of (doc_id, text): documents with their sets, and the entries of each set once a chunk.

    ``leading``: every document and its leading entries; else one document a set and chunk, and all entries.
    """

    def entries(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        uids = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in sets.values()])
        c = np.concatenate(list(sets.values())).view(np.int64)
        order = np.argsort(c, kind="stable")
        c, uids = c[order], uids[order]
        at = _runs(c)
        times = np.diff(at)
        often = np.repeat(times >= OFTEN, times)
        marks = c[at[:-1][times >= OFTEN]]
        open_c = np.r_[c[~often], marks]
        yield _packed(open_c, buckets, c=open_c, uids=np.r_[uids[~often], np.full(len(marks), _MARK)])
        if len(marks):
            yield _packed(uids[often], buckets, c=c[often], uids=uids[often], df=np.full(often.sum(), OFTEN, np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size, seen = {}, 0, 0
        for batch in slices(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(t.as_py())
                uid = xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 or 1 if len(s) else None
                new = i is not None and uid is not None and uid not in sets  # a null id stands for no set
                if new:
                    sets[uid] = s[: lead(len(s))].copy() if leading else s
                    size += len(sets[uid])
                if new or leading:
                    rows.append((i, len(s), uid))
            if rows:
                ids, ns, uids = zip(*rows)
                # copies have one set, so documents are dealt by it only where each set comes once a chunk
                key = np.arange(seen, seen + len(rows)) if leading else np.array(uids, np.int64)
                yield _batch(_DEAL, bucket=_at(key, buckets).astype(np.int32), doc_id=ids, n=ns, uid=uids)
                seen += len(rows)
            if size >= CHUNK:
                yield from entries(sets)
                sets, size = {}, 0
        if sets:
            yield from entries(sets)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, list], dict[bool, list[np.ndarray]]]:
    """All that was dealt to a task: documents by column, and entries (c, uids, df) of columns whose frequency is open (False) or known."""
    docs: dict[str, list] = {"doc_id": [], "n": [], "uid": []}
    found: dict[bool, list[list[np.ndarray]]] = {False: [[], [], []], True: [[], [], []]}
    for batch in batches:
        c, uids, df = (batch.column(k) for k in (4, 5, 6))
        plain = batch.filter(c.is_null())
        for k, name in enumerate(docs, 1):
            docs[name] += plain.column(k).to_pylist()
        for x, y, z in zip(c, uids, df):
            if x.is_valid:
                to = found[z.is_valid]
                to[0].append(np.frombuffer(x.as_buffer(), np.int64))
                to[1].append(np.frombuffer(y.as_buffer(), np.int64))
                to[2].append(np.frombuffer(z.as_buffer(), np.int8) if z.is_valid else np.zeros(len(to[0][-1]), np.int8))
    empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]
    return docs, {k: [np.concatenate([e, *x]) for e, x in zip(empty, v)] for k, v in found.items()}


def _counted(found: dict[bool, list[np.ndarray]]) -> list[np.ndarray]:
    """The entries (c, uid, df) of columns that two sets or more have; df is OFTEN at most."""
    c, uids, _ = found[False]
    order = np.lexsort((uids, c))
    c, uids = c[order], uids[order]
    once = _runs(c, uids)[:-1]
    c, uids = c[once], uids[once]
    at = _runs(c)
    times = np.diff(at)
    marked = np.add.reduceat(uids == _MARK, at[:-1]) > 0 if len(c) else np.zeros(0, bool)
    df = np.repeat(np.where(marked, OFTEN, np.minimum(times, OFTEN)).astype(np.int8), times)
    kept = (df > 1) & (uids != _MARK)
    return [np.r_[a[kept], b] for a, b in zip((c, uids, df), found[True])]


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents, and how many of this block's columns each set shares."""
    docs, found = _gathered(batches)
    yield _batch(_COUNTS, **docs, shared=[0] * len(docs["uid"]))
    uids, shared = np.unique(_counted(found)[1], return_counts=True)
    yield _batch(_COUNTS, uid=uids, shared=shared)


def _return_shared(buckets: int):
    """The documents, and the entries of shared columns with their frequencies, dealt by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found = _gathered(batches)
        if docs["uid"]:
            yield _batch(_DEAL, bucket=_at(np.array([u or 0 for u in docs["uid"]], np.int64), buckets).astype(np.int32), **docs)
        c, uids, df = _counted(found)
        if len(c):
            yield _packed(uids, buckets, c=c, uids=uids, df=df)

    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of which 3/4 are shared: its shared columns, rarest first."""
    docs, found = _gathered(batches)
    known: dict[int, tuple[int, int]] = {}
    for doc_id, n, uid in zip(*docs.values()):
        if uid is not None and doc_id is not None and (uid not in known or doc_id < known[uid][0]):
            known[uid] = (doc_id, n)
    c, uids, df = found[True]
    order = np.lexsort((c, df, uids))
    c, uids, df = c[order], uids[order], df[order]
    once = _runs(uids, df, c)[:-1]
    c, uids = c[once], uids[once]
    at = _runs(uids)
    rows = [(u, *known[u], c[a:b]) for u, a, b in zip(uids[at[:-1]].tolist(), at, at[1:]) if u in known and 4 * (b - a) >= 3 * known[u][1]]
    for i in range(0, len(rows), 500):
        some = list(zip(*rows[i : i + 500]))
        yield _batch(_SHARED, uid=some[0], doc_id=some[1], n=some[2], columns=list(some[3]))


def _asked(na, nb):
    """The overlap that Jaccard >= 3/4 asks of two sizes."""
    return F.ceil(3 * (na + nb) / 7)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The documents (a, b) of those pairs (a, b) of sets that have Jaccard >= 3/4."""
    one = lambda x: sets.select(F.col("uid").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("columns").alias(f"s{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= 75 * (F.col("na") + F.col("nb") - shared)).select(F.col("da").alias("a"), F.col("db").alias("b"))


def _edges(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _placed(leading: DataFrame, groups: DataFrame) -> DataFrame:
    """The leading entries with the component g of their set."""
    return leading.join(groups, F.col("doc_id") == F.col("node"), "left").select("c", "uid", "n", "s", "r", F.coalesce("component", "doc_id").alias("g"))


def _may(x: str, y: str):
    """Two entries of one column may be of a pair that links: another component, and enough shared columns before it and from here on in both."""
    s, t, p, q = (F.col(c) for c in (f"s{x}", f"s{y}", f"r{x}", f"r{y}"))
    return (F.col(f"g{x}") != F.col(f"g{y}")) & (F.least(p, q) + F.least(s - p, t - q) >= _asked(F.col(f"n{x}"), F.col(f"n{y}")))


def _known(df: DataFrame) -> DataFrame:
    """Ids, broadcast where they are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _stars(entries: DataFrame, shift: float) -> DataFrame:
    """Pairs (a, b): the PARTNERS sets b that have most columns in common with a, among the foremost sets of a's columns.

    Foremost is the set with the fewest columns before this one, among sets of about one size (classes of a third, moved by ``shift``);
    a set of its component meets the foremost of another.
    """
    e = entries.withColumn("k", F.floor(F.ln("n") / math.log(4 / 3) + shift))
    best = e.groupBy("c", "k", "g").agg(F.min(F.struct((F.col("n") - F.col("s") + F.col("r")).alias("i"), "uid", "n", "s", "r", "g")).alias("p"))
    one = best.groupBy("c", "k").agg(F.min("p").alias("p1"))
    two = best.join(one, ["c", "k"]).filter(F.col("g") != F.col("p1.g")).groupBy("c", "k", "p1").agg(F.min("p").alias("p2"))
    met = e.join(two, ["c", "k"]).withColumn("q", F.when(F.col("g") != F.col("p1.g"), F.col("p1")).otherwise(F.col("p2")))
    met = met.select(F.col("uid").alias("a"), *(F.col(x).alias(f"{x}a") for x in "nsrg"), F.col("q.uid").alias("b"), *(F.col(f"q.{x}").alias(f"{x}b") for x in "nsrg"))
    overlaps = met.filter(_may("a", "b")).groupBy("a", "b").agg(F.count("*").alias("overlap"))
    most = F.slice(F.sort_array(F.collect_list(F.struct("overlap", "b")), asc=False), 1, PARTNERS)  # as many as a has leading columns at most
    return overlaps.groupBy("a").agg(F.explode(most).alias("p")).select("a", "p.b")


def _weighted(sets: DataFrame, leading: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, n, g, columns (id, df, w): sets that share a leading column with another component, and their merged columns.

    Only columns of two components or more count. Columns in the same sets are one, with their number as its weight, which is the same in all of these.
    """
    placed = _placed(leading, groups)
    mixed = placed.groupBy("c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("c")
    able = scratch.save(placed.join(mixed, "c", "left_semi").select("uid", "g").distinct(), "able")
    some = scratch.save(sets.join(_known(able), "uid").select("uid", "doc_id", "n", "g", "columns"), "some")
    cells = some.select("uid", "g", F.explode("columns").alias("c"))
    h = F.xxhash64("uid")
    of = cells.groupBy("c").agg(F.count("*").alias("df"), F.bit_xor(h).alias("x"), F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi")
    merged = cells.select("uid", "c").join(of.select("c", "df", F.xxhash64("x", "df").alias("id")), "c").groupBy("uid", "id", "df").agg(F.count("*").alias("w"))
    listed = merged.groupBy("uid").agg(F.collect_list(F.struct("id", "df", "w")).alias("columns"))
    return scratch.save(some.drop("columns").join(listed, "uid").filter(F.aggregate("columns", F.lit(0).cast("long"), lambda a, x: a + x["w"]) >= F.ceil(3 * F.col("n") / 4)), "weighted")


_KEYS = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("g", pa.int64()), ("key", pa.int64()), ("reach", pa.int64()), ("single", pa.bool_())])
_KEYS_SQL = "uid long, n long, g long, key long, reach long, single boolean"
_END, _MASK = 0x5851F42D4C957F2D, (1 << 64) - 1


def _joined(key: int, x: int) -> int:
    key = ((key ^ (x & _MASK)) * 0x9E3779B97F4A7C15) & _MASK
    return key ^ (key >> 29)


def sequences(columns: list[tuple[int, int, int]], n: int, total: int, most: int) -> tuple[list[tuple[int, int]], bool]:
    """(key, reach) of every sequence of columns (id, df, w) that what the set shares with a linked set may start with; whether they are single columns.

    ``reach``: the weight that the two can still share. A sequence ends where EXPECTED sets of ``total`` should have it at most, or
    where no more columns are shared. A set with more than ``most`` of them is led by single columns.
    """
    columns = sorted(columns, key=lambda c: (c[1] / c[2], c[0]))
    have = sum(w for _, _, w in columns)
    spare = have - -(-3 * n // 4)
    if spare < 0:
        return [], False
    out: list[tuple[int, int]] = []
    todo = [(0, 0, float(total), 0)]
    while todo and len(out) + len(todo) <= most:
        at, passed, expected, key = todo.pop()
        for k in range(at, len(columns)):
            x, df, w = columns[k]
            if (fewer := expected * df / total) <= EXPECTED:
                out.append((_joined(key, x), have - passed))
            else:
                todo.append((k + 1, passed, fewer, _joined(key, x)))
            passed += w
            if passed > spare:
                break
        else:
            if at:  # nothing more is shared
                out.append((_joined(key, _END), have - passed))
    if not todo:
        return out, False
    out, passed = [], 0
    for x, _, w in columns:
        out.append((_joined(_END, x), have - passed))
        if (passed := passed + w) > spare:
            break
    return out, True


def _led(total: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function of weighted sets (uid, n, g, columns): a row for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            uids, ns, gs = (batch.column(k).to_pylist() for k in range(3))
            at, cells = batch.column(3).offsets.to_pylist(), batch.column(3).flatten()
            start = at[0]
            rows = list(zip(*(c.to_pylist() for c in cells.flatten())))
            out = []
            for k, (uid, n, g) in enumerate(zip(uids, ns, gs)):
                found, single = sequences(rows[at[k] - start : at[k + 1] - start], n, total, most)
                out += [(uid, n, g, key - (1 << 64) if key >> 63 else key, reach, single) for key, reach in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEYS)], schema=_KEYS)

    return run


def _met(asks: DataFrame, homes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components with a key in common, of sizes and reaches that allow the overlap that both ask for; the larger set asks."""
    size = lambda n: F.floor(F.log(n) / math.log(CLASS) + 1e-9)
    high = F.least("na", F.floor(7 * F.col("ra") / 3).cast("long") - F.col("na"))
    a = asks.select("key", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"), F.col("reach").alias("ra"))
    a = a.withColumn("low", F.ceil(3 * F.col("na") / 4)).withColumn("high", high).filter("low <= high")
    a = a.withColumn("k", F.explode(F.sequence(size(F.col("low")), size(F.col("high")))))
    b = homes.select("key", F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("reach").alias("rb"), size(F.col("n")).alias("k"))
    smaller = (F.col("nb") < F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))
    return a.join(b, ["key", "k"]).filter((F.col("ga") != F.col("gb")) & smaller & (F.least("ra", "rb") >= _asked(F.col("na"), F.col("nb")))).select("a", "b").distinct()


def candidates(weighted: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets that may link. Sets with too many sequences meet all others by single columns."""
    own, total = weighted.select("uid", "n", "g", "columns"), weighted.count()
    keys = scratch.save(arrow_map(own, _led(total, SEQUENCES), _KEYS_SQL), "keys")
    found = _met(keys.filter("NOT single"), keys.filter("NOT single"))
    if not keys.filter("single").take(1):
        return found
    single = scratch.save(arrow_map(own, _led(total, 0), _KEYS_SQL), "single")
    long_ = keys.filter("single")
    return found.unionByName(_met(long_, single)).unionByName(_met(single, long_)).distinct()


def _product(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """The documents (a, b) of those pairs whose overlap, added up over the weighted columns that both have, reaches the threshold."""
    cells = weighted.select("uid", F.explode("columns").alias("x")).select("uid", "x.id", "x.w")
    met = pairs.join(cells.withColumnRenamed("uid", "a"), "a").join(cells.select(F.col("uid").alias("b"), "id"), ["b", "id"])
    overlap = met.groupBy("a", "b").agg(F.sum("w").alias("overlap"))
    one = lambda x: weighted.select(F.col("uid").alias(x), F.col("doc_id").alias(f"d{x}"), F.col("n").alias(f"n{x}"))
    both = overlap.join(one("a"), "a").join(one("b"), "b")
    return both.filter(100 * F.col("overlap") >= 75 * (F.col("na") + F.col("nb") - F.col("overlap"))).select(F.col("da").alias("a"), F.col("db").alias("b"))


def ngram_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    A null, empty or blank text has an empty set and is linked with nothing. Rows with the same doc_id are one node: it
    is linked through any of their texts. A null doc_id is linked with nothing and its component_id is null. Other
    columns are not read. N-grams and whole sets are told apart by 64-bit hashes. No partner is dropped: all pairs that
    reach the threshold end in the same component.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    buckets = min(1 << 16, max(1 << 10, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    # 1. Sets with enough shared columns among those that lead by hash.
    dealt = arrow_map(own, _deal(True, buckets), _DEAL_SQL).repartition("bucket")
    first = scratch.save(arrow_map(dealt, _count_shared, "doc_id long, n long, uid long, shared long"), "first")
    rows, known = first.filter("n IS NOT NULL").select("doc_id", "n", "uid"), first.filter("uid IS NOT NULL")
    sums = known.groupBy("uid").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.min("doc_id").alias("b"), F.count("doc_id").alias("m"))
    nodes = scratch.save(sums.filter("b IS NOT NULL AND (m > 1 OR shared >= 1 + floor(3 * n / 40))"), "nodes")
    scratch.settle()

    # 2. Their columns, rarest first.
    able = nodes.filter("shared >= 1 + floor(3 * n / 40)").select(F.col("b").alias("doc_id")).distinct()
    some = own.join(_known(able), "doc_id", "left_semi")
    counted = arrow_map(arrow_map(some, _deal(False, buckets), _DEAL_SQL).repartition("bucket"), _return_shared(buckets), _DEAL_SQL)
    sets = scratch.save(arrow_map(counted.repartition("bucket"), _ordered, "uid long, doc_id long, n long, columns array<long>"), "sets")
    scratch.settle()
    s = F.size("columns")
    leading = sets.select("uid", "doc_id", "n", s.alias("s"), F.posexplode(F.slice("columns", 1, s - F.ceil(3 * F.col("n") / 4).cast("int") + 1)).alias("r", "c"))

    # 3. Equal sets, and rounds of stars.
    twice = nodes.filter("m > 1").select("uid", "b")
    same = rows.join(_known(twice), "uid")
    groups = components(scratch, same.select(F.col("doc_id").alias("a"), "b").filter("a <> b"), "same")
    for i in range(ROUNDS):
        found = scratch.save(_linked(_stars(_placed(leading, groups), i / 2), sets), f"star{i}")
        scratch.settle()
        if not found.take(1):
            break
        groups = components(scratch, _edges(groups).unionByName(found), f"groups{i}")

    # 4. What is left between components.
    weighted = _weighted(sets, leading, groups, scratch)
    more = scratch.save(_product(scratch.save(candidates(weighted, scratch), "pairs"), weighted), "more")
    if more.take(1):
        groups = components(scratch, _edges(groups).unionByName(more), "all")
    groups = scratch.save(groups, "groups")
    scratch.keep("first", "groups")
    out = rows.join(groups, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
           THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
