"""Periodic run detection: a Kruskal pass over the suffixes of a text in descending order of their common prefixes.

A run with period q and length L is a pair of suffixes, q apart, whose longest common prefix has L - q words. Suffixes that
share a prefix of a length form a class. Classes are united by decreasing length of the prefix (LCP), each as an ordered set
of positions under union-find, the smaller set going into the larger. When two positions become neighbours in a set at a
length that their distance does not exceed, they seed a run: the distance is its smallest period, since a shorter
one would have a position of the class between them, and it ends where the common prefix ends. Its first seed is its start.

Texts are independent of each other: the work is one Arrow map without a shuffle. A text takes memory in proportion to its
words times the logarithm of its longest repeat; positions whose first words do not occur again never enter the sort.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import SPACE_WORD, arrow_map, slices, table

#: Words of a run at least, and its periods at least.
MIN_LENGTH, MIN_PERIODS = 12, 2


def least_prefix(min_length: int) -> int:
    """Words that the two suffixes of a run of ``min_length`` or more share at least, whatever its period."""
    return max(1, min_length - min_length // MIN_PERIODS)


def _ranked(key: np.ndarray) -> np.ndarray:
    """For each key how many keys are smaller."""
    order = np.argsort(key)
    key = key[order]
    first = np.zeros(len(order), np.int64)
    new = np.flatnonzero(key[1:] != key[:-1]) + 1
    first[new] = new
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(first)
    return out


def _suffix_order(words: np.ndarray, first: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Positions whose first words occur elsewhere, in the order of their suffixes, and levels (length, positions, classes).

    A level has the positions whose prefix of that length occurs elsewhere, and a number for each such prefix; lengths
    double from ``first``. Ranks of all positions are refined from level to level, but only classes of two or more are sorted again.
    """
    n = len(words)
    rank, length = words.astype(np.int64), 1

    def pairs(at: np.ndarray, step: int) -> np.ndarray:
        far = at + step
        return rank[at] * (n + 1) + np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)

    while length < first:  # the last step overlaps what is known
        step = min(length, first - length)
        rank, length = _ranked(pairs(np.arange(n), step)), length + step
    at, levels = np.arange(n), []
    active = None
    while True:
        at = at[np.bincount(rank[at], minlength=n)[rank[at]] > 1]
        active = at if active is None else active
        if not len(at):
            return active[np.argsort(rank[active])], levels
        levels.append((length, at, rank[at].astype(np.int32)))
        key = pairs(at, length)
        order = np.argsort(key)
        key, of = key[order], at[order]
        old = rank[of]  # of a class: the rank of its first member, and its members follow one another here
        place = np.arange(len(of))
        head = np.ones(len(of), bool)
        head[1:] = old[1:] != old[:-1]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        rank[of] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        length *= 2


def _common_prefixes(levels: list[tuple[int, np.ndarray, np.ndarray]], words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words in common from i and from j on, for pairs of positions i < j, by the levels from the longest to the shortest."""
    n, out = len(words), np.zeros(len(i), np.int64)
    for length, at, classes in reversed(levels):
        full = np.full(n + 1, -1, np.int32)
        full[at] = classes
        a, b = full[i + out], full[j + out]
        out += np.where((a >= 0) & (a == b), length, 0)
    open_ = np.arange(len(i))
    for _ in range(levels[0][0] - 1):  # what is left is shorter than the first level
        a, b = i[open_] + out[open_], j[open_] + out[open_]
        open_ = open_[(b < n) & (words[a] == words[np.minimum(b, n - 1)])]
        out[open_] += 1
    return out


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of word numbers, by start, then period."""
    n, first = len(words), least_prefix(min_length)
    if n < min_length:
        return []
    order, levels = _suffix_order(words, first)
    if not len(order):
        return []
    lcp = _common_prefixes(levels, words, np.minimum(order[:-1], order[1:]), np.maximum(order[:-1], order[1:]))
    edges = np.flatnonzero(lcp >= first)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    found: dict[tuple[int, int], int] = {}
    parent = list(range(len(order)))
    sets: list[list[int]] = [[p] for p in order.tolist()]
    for a, shared in zip(edges.tolist(), lcp[edges].tolist()):
        b = a + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, []
        if len(small) == 1:
            insort(large, small[0])
        else:
            large += small
            large.sort()  # of two ordered parts: a merge
        own = set(small)
        for p in small:
            k = bisect_left(large, p)
            for x in (k - 1, k):
                if x >= 0 and x + 1 < len(large) and (q := large[x + 1] - large[x]) <= shared and q + shared >= min_length and not (large[x] in own and large[x + 1] in own):
                    key = (q, large[x + 1] + shared)
                    if found.get(key, n) > large[x]:
                        found[key] = large[x]
    # sets of one level are united one after another: neighbours for a while only have a multiple of the period
    runs, starts = [], {}
    for (q, end), s in sorted(found.items()):
        if starts.get(end, n) > s:
            starts[end] = s
            runs.append((s, end - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words are in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _detect(min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or b"").split()  # of bytes: the six white-space characters of ASCII
                number: dict[bytes, int] = {}
                runs = find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int32), min_length)
                if runs:
                    gone = repeated(runs, len(words))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                out.append((i, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return run


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: one row per input row.

    Words are runs of anything but the six white-space characters of ASCII, told apart by their bytes. A run is a stretch
    of ``min_length`` words or more, of two periods or more, that can be extended to neither side. ``collapsed`` is
    the text without what repeats: words that some run holds after its first period go, the others are joined by one space. A null, empty or
    blank text has no words, no runs and an empty collapsed text. Repeated rows give repeated results; a null doc_id stays
    null; other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return arrow_map(own, _detect(min_length), _SQL)


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id, text as the query's contract asks: a tenth of the documents, by a hash of their id, repeats its end with a period. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    due = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(SPACE_WORD)
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(due, F.regexp_extract_all("text", F.lit(SPACE_WORD), 0)).alias("w"))
    cut = cut.withColumn("n", F.size("w")).withColumn("a", F.pmod("g", "n").cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeats = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(repeats, F.lit(1), rest)), " ")
    return cut.select("doc_id", F.when(F.col("w").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest of them, and a digest of the collapsed text."""
    found = periodic_runs(with_planted(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), (-F.col("best.l")).alias("length"), F.col("best.period"),
        F.expr("floor(1000 * -best.l / best.period)").cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
