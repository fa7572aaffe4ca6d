"""Centroid clustering: exact rounds of k-means over integer vectors, pruned by the Shallot search.

Every vector remembers its centroid, its second nearest, an upper bound of the distance to the first and a lower bound of the distance to
all others. A round moves the bounds by how far centroids went; a vector whose upper bound stays below the lower one, or below
half the way from its centroid to the next, keeps its centroid without a look at any other. Else it starts from the closer of the two that
it remembers and goes through that centroid's neighbours in order of distance, in a ball of the distance to the start plus
the distance to the second nearest so far, which shrinks with each better one found. Bounds are floating point with a margin; what
survives them is compared in integers, so that distances, ties and sums are exact.

Vectors are dealt once and never shuffled: a round is a map over them and sums by centroid that are combined before
the shuffle. The driver holds k centroids and their sums. Each round is written to the shared folder in place of the one before the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, arrow_map, table

#: Centroids, rounds of assignment and update, components of a vector, integers to a unit, seed of the first centroids.
K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Integers of components stay below this, so that squared distances of 64 of them fit 64 bits.
LIMIT = 1 << 27
#: What a sum of floating-point roundings can be off by, and far more.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """The nearest of k centroids (k, d), with what the search needs to know of them, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = np.sqrt(np.stack([squared(centroids, c) for c in centroids]).astype(float)) if k else np.zeros((0, 0))
        np.fill_diagonal(apart, -1.0)  # each is the first of its own neighbours
        self.neighbours = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.neighbours, 1)
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = moved * _UP
        most = np.argsort(-self.moved, kind="stable")
        self.others = np.full(k, self.moved[most[0]] if k else 0.0)  # the farthest that any other has moved
        if k:
            self.others[most[0]] = self.moved[most[1]] if k > 1 else 0.0

    def assign(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """near, second, upper, lower of the vectors x (n, d), from those of the round before."""
        near, second = near.copy(), second.copy()
        upper, lower = upper * _UP + self.moved[near], lower * _DOWN - self.others[near]
        if len(self.centroids) == 1:
            return near, second, upper, lower
        bound = np.maximum(lower, self.half[near] * _DOWN)
        open_ = np.flatnonzero(~(upper < bound))
        upper[open_] = np.sqrt(squared(x[open_], self.centroids[near[open_]]).astype(float)) * _UP
        open_ = open_[~(upper[open_] < bound[open_])]
        if len(open_):
            near[open_], second[open_], e1, e2 = self._scan(x[open_], near[open_], second[open_])
            upper[open_], lower[open_] = np.sqrt(e1.astype(float)) * _UP, np.sqrt(e2.astype(float)) * _DOWN
        return near, second, upper, lower

    def _scan(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest, second nearest and their squared distances; of equal distances the smaller number is nearer."""
        d1, d2 = squared(x, self.centroids[one]), squared(x, self.centroids[two])
        swap = (d2 < d1) | (d2 == d1) & (two < one)
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, other, from_start = one, two, np.sqrt(d1.astype(float)) * _UP
        one, two = one.copy(), two.copy()
        live = np.arange(len(x))
        for k in range(1, len(self.centroids)):
            radius = from_start[live] + np.sqrt(d2[live].astype(float)) * _UP
            live = live[self.apart[start[live], k] * _DOWN <= radius]
            if not len(live):
                break
            c = self.neighbours[start[live], k]
            at, c = live[c != other[live]], c[c != other[live]]
            d = squared(x[at], self.centroids[c])
            first = (d < d1[at]) | (d == d1[at]) & (c < one[at])
            next_ = ~first & ((d < d2[at]) | (d == d2[at]) & (c < two[at]))
            i = at[first]
            two[i], d2[i] = one[i], d1[i]
            one[i], d1[i] = c[first], d[first]
            two[at[next_]], d2[at[next_]] = c[next_], d[next_]
        return one, two, d1, d2


_STATE = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("near", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])
_STATE_SQL = "vec_id long, x array<int>, near int, second int, upper double, lower double"
_LAST_SQL = "vec_id long, cluster int, distance long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _round(centroids: np.ndarray, moved: np.ndarray, dim: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function of the state: the state after an assignment, or the assignment with exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, moved)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            near, second, upper, lower = search.assign(x, *(batch.column(k).to_numpy() for k in range(2, 6)))
            if last:
                columns = [batch.column(0), pa.array(near, pa.int32()), pa.array(squared(x, centroids[near]))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (near.astype(np.int32), second.astype(np.int32), upper, lower))], schema=_STATE)

    return run


def _moved_to(state: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    sums = state.groupBy("near").agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dim))).collect()
    out = centroids.copy()
    for row in sums:
        out[row[0]] = [s // row[1] for s in row[2:]]
    return out


def cluster_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance: one row for each vector that takes part; the final centroids).

    A vector takes part if it has ``dim`` components, none null or not finite, and their integers floor(scale * x) stay below LIMIT
    in size: beyond it a squared distance need not fit 64 bits. The first centroids are the k vectors with the smallest SHA-256 of
    ``seed:vec_id`` (of equal ids the smaller vector); one with a null id is none of them but takes part. With fewer vectors there are fewer centroids;
    without any, the result is empty. Repeated rows take part as often as they occur. Of equally near centroids the smaller
    number wins. Other columns are not read. k and dim bound what a task and the driver hold.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter(F.size("v") == dim)
    good = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT / scale, F.lit(False)))  # not a number is larger than any
    v = v.filter(good).select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int")).alias("x"))
    start = (F.lit(0), F.lit(min(1, k - 1)), F.lit(float("inf")), F.lit(0.0))
    state = scratch.save(v.select("vec_id", "x", *(c.alias(n) for c, n in zip(start, ("near", "second", "upper", "lower")))), "state0")
    named = state.filter("vec_id IS NOT NULL").select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    centroids = np.array([r.x for r in named.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _LAST_SQL), []
    if len(centroids) == 1:
        state = state.withColumn("second", F.lit(0))
    moved = np.zeros(len(centroids))
    for i in range(rounds):
        state = scratch.save(arrow_map(state, _round(centroids, moved, dim, False), _STATE_SQL), f"state{(i + 1) % 2}")  # in place of the one before the last
        after = _moved_to(state, centroids, dim)
        moved, centroids = np.sqrt(squared(after, centroids).astype(float)), after
    last = scratch.save(arrow_map(state, _round(centroids, moved, dim, True), _LAST_SQL), "last")
    scratch.keep("last")
    return last, centroids.tolist()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector, the inertia of its cluster and of all, and a digest of its centroid."""
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    total = int(sum(sums.values()))
    rows = [(c, int(s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # K rows at most
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds of OP13_SQL, written out."""
    assign = """a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c) GROUP BY r)"""
    update = """c{j} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
  SELECT c, list(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END ORDER BY p) AS x FROM (
    SELECT a.c, p, sum(v.x[p])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} a JOIN v ON v.r = a.r CROSS JOIN (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2) GROUP BY c) m ON m.c = c{i}.c)"""
    steps = [s.format(i=i, j=i + 1) for i in range(ROUNDS) for s in (assign, update)]
    return ",\n".join([*steps, assign.format(i=ROUNDS)])


OP13_SQL = rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1)::INT AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40),
{_sql()}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN c{ROUNDS} c ON c.c = a.c
"""
