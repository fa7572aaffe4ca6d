"""Benchmark decontamination: a stored positional inverted index of training tokens, asked for the benchmark's windows.

The index is split by document and written once: each row is a shard of documents with the postings (term -> ascending
positions) of all their terms, closed at a number of tokens. Test items then ask every shard: the postings of a window's rarest
term in the shard, shifted by the term's offset, are the candidate starts; the shifted postings of the other terms, rarest first,
are intersected with them, exactly or within a distance. A shard looks at windows whose rarest test term it holds, if it holds all.
Terms meet by 64-bit hashes.
Texts are read once, whatever the number of test blocks, and no posting is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import Scratch, arrow_map, table

#: Words in a window; tokens after which a shard is closed; bytes of test text that one pass takes; words out of place in a proximity match.
WIDTH, SHARD_TOKENS, BLOCK_BYTES, SLOP = 13, 1_000_000, 8_000_000, 1
#: Of shards that a task reads at once; a shard has some MB.
BATCH_MB = 8
#: Words are runs of ASCII digits, letters (lower-cased) and anything beyond ASCII; all else separates.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of a block of test items, built once by the driver and sent to the tasks as arrays.

    ``terms``: sorted hashes of the block's words, whose places are the numbers of terms. ``ids``: the terms of all items, one after another;
    window k is ``ids[at[k] : at[k] + size[k]]``, and has the items ``member[of[k] : of[k + 1]]``. Windows stand by their rarest term in the
    block: those of term t from ``by[t]`` to ``by[t + 1]``. A text takes 12 bytes a word and 20 a different window, so that a block stays below 60 MB.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int) -> None:
        texts = [np.fromiter(map(xxhash.xxh3_64_intdigest, tokens(t)), np.uint64) for _, t in items]
        self.items, item = np.unique([f"1{i}" if i is not None else "2" for i, _ in items], return_inverse=True)  # by name, null last
        self.items = [None if i == "2" else i[1:] for i in self.items.tolist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        self.terms, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_inverse=True)
        self.ids = ids.astype(np.int32)
        windows = np.where(lengths > 0, np.maximum(lengths - width + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), windows)
        at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(lengths) - lengths, windows)
        size = np.minimum(lengths, width)[of]
        often = np.bincount(self.ids, minlength=len(self.terms))
        h, rarest, least = size.astype(np.uint64), np.zeros(len(at), np.int64), np.full(len(at), np.iinfo(np.int64).max)
        for k in range(width):
            here = np.flatnonzero(size > k)
            t = self.ids[at[here] + k]
            h[here] = (h[here] ^ self.terms[t]) * np.uint64(0x9E3779B97F4A7C15)
            h[here] ^= h[here] >> np.uint64(29)
            fewer = often[t] < least[here]
            least[here[fewer]], rarest[here[fewer]] = often[t[fewer]], t[fewer]
        order = np.lexsort((item[of], h, rarest))  # windows by their rarest term, equal ones next to each other
        h, new = h[order], np.ones(len(order), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        self.at, self.size = at[order[first]].astype(np.int32), size[order[first]].astype(np.int32)
        self.of, self.member = np.r_[first, len(order)].astype(np.int32), item[of[order]].astype(np.int32)
        self.by = np.searchsorted(rarest[order[first]], np.arange(len(self.terms) + 1)).astype(np.int32)

    def window(self, k: int) -> tuple[int, ...]:
        return tuple(self.ids[self.at[k] : self.at[k] + self.size[k]].tolist())

    def possible(self, counts: np.ndarray) -> np.ndarray:
        """The windows all of whose terms a shard has, by its counts of the block's terms."""
        here = np.flatnonzero(counts)
        n = self.by[here + 1] - self.by[here]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.by[here], n)
        for j in range(int(self.size.max(initial=0))):
            inside = np.minimum(j, self.size[k] - 1)
            k = k[counts[self.ids[self.at[k] + inside]] > 0]
        return k


#: The index: documents of a shard by number of words; its terms, their counts, and their positions one after another.
_INDEX = pa.schema([
    ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
])
_INDEX_SQL = "shard long, doc_ids array<long>, keys array<long>, sizes array<long>, terms binary, counts binary, places binary"


def _starts(sizes: list[int]) -> np.ndarray:
    """Where documents start in a shard, and its end: one empty place follows each."""
    return np.cumsum([0, *(n + 1 for n in sizes)])


def _index(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that makes shards of documents (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        rows, vocabulary, size = [], {}, 0

        def close() -> pa.RecordBatch:
            ids, sizes = np.concatenate([r[2] for r in rows]), [len(r[2]) for r in rows]
            at = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)
            places = at[np.argsort(ids, kind="stable")].astype(np.int32)
            counts = np.bincount(ids, minlength=len(vocabulary)).astype(np.int32)
            columns = [shard, [r[0] for r in rows], [r[1] for r in rows], sizes, b" ".join(vocabulary), counts.tobytes(), places.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)

        for batch in batches:
            for i, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = tokens(t.as_py())
                rows.append((i, key, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)))
                if (size := size + len(words) + 1) >= most:
                    yield close()
                    shard, rows, vocabulary, size = shard + 1, [], {}, 0
        if rows:
            yield close()

    return run


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))


def index_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_tokens: int | None = None) -> DataFrame:
    """The positional index of all documents, one row a shard; to be written, since a number of the task tells shards apart.

    ``shard_tokens`` (else SHARD_TOKENS) bounds what a task holds; a longer text is a shard of its own.
    """
    return arrow_map(_own(docs, doc_id, text), _index(shard_tokens or SHARD_TOKENS), _INDEX_SQL)


class Shard:
    """A row of the index, for the terms of a test block."""

    def __init__(self, sizes: list[int], terms: bytes, counts: np.ndarray, places: np.ndarray, asked: np.ndarray) -> None:
        self.starts, self.places = _starts(sizes), places
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms.split()), np.uint64, len(counts))
        at = np.minimum(np.searchsorted(asked, h), max(len(asked) - 1, 0))
        both = np.flatnonzero(asked[at] == h) if len(asked) else np.zeros(0, np.int64)
        self.counts, self.ends = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        self.counts[at[both]], self.ends[at[both]] = counts[both], np.cumsum(counts, dtype=np.int64)[both]

    def listed(self, term: int) -> np.ndarray:
        """The postings of a term."""
        return self.places[self.ends[term] - self.counts[term] : self.ends[term]].astype(np.int64)

    def find(self, window: tuple[int, ...]) -> np.ndarray:
        """Starts of the window: all its terms in place."""
        order = sorted(range(len(window)), key=lambda k: self.counts[window[k]])
        starts = self.listed(window[order[0]]) - order[0]
        starts = starts[starts >= 0]
        for k in order[1:]:
            if not len(starts):
                break
            listed, due = self.listed(window[k]), starts + k
            starts = starts[listed[np.minimum(np.searchsorted(listed, due), len(listed) - 1)] == due]
        return starts

    def near(self, window: tuple[int, ...], slop: int) -> np.ndarray:
        """Documents with a start, inside or not, from which each term is at most ``slop`` words out of place: the same in any shard."""
        order = sorted(range(len(window)), key=lambda k: self.counts[window[k]])
        rarest, shifts = self.listed(window[order[0]]), np.arange(-slop, slop + 1)
        starts, of = np.add.outer(rarest - order[0], shifts).ravel(), np.repeat(self.document(rarest), len(shifts))
        for k in order[1:]:
            if not len(starts):
                break
            listed, low, high = self.listed(window[k]), np.maximum(starts + k - slop, self.starts[of]), starts + k + slop
            found = listed[np.minimum(np.searchsorted(listed, low), len(listed) - 1)]
            good = (low <= found) & (found <= high) & (found < self.starts[of + 1])
            starts, of = starts[good], of[good]
        return of

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _answer(shard: Shard, n_docs: int, asked: Windows, slop: int) -> tuple[list, list, list]:
    """For each document: hit words as [first, after] runs, items with a window, items with one by proximity."""
    change = np.zeros(int(shard.starts[-1]) + 1, np.int32)
    exact: list[set] = [set() for _ in range(n_docs)]
    near: list[set] = [set() for _ in range(n_docs)]
    for k in asked.possible(shard.counts).tolist():
        window, items = asked.window(k), asked.member[asked.of[k] : asked.of[k + 1]].tolist()
        starts = shard.find(window)
        if len(starts):
            np.add.at(change, starts, 1)
            np.add.at(change, starts + len(window), -1)
            for d in set(shard.document(starts).tolist()):
                exact[d].update(items)
        if slop:
            for d in set(shard.near(window, slop).tolist()):
                near[d].update(items)
    edges = np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]]))
    first, after = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    runs: list[list] = [[] for _ in range(n_docs)]
    for d, a, b in zip(shard.document(first).tolist(), first.tolist(), after.tolist()):
        runs[d].append([a - int(shard.starts[d]), b - int(shard.starts[d])])
    return runs, exact, near


_FOUND = pa.schema([
    ("shard", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
])
_FOUND_SQL = "shard long, k long, doc_id long, key long, n_words long, runs array<array<long>>, items array<string>, near_items array<string>"


def _search(asked: Windows, slop: int, all_documents: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function of shards: what a block of test items finds, a row for every document, or for those with a match alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard_no, ids, keys, sizes, terms = (batch.column(c)[row].as_py() for c in range(5))
                counts, places = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in (5, 6))
                runs, exact, near = _answer(Shard(sizes, terms, counts, places, asked.terms), len(sizes), asked, slop)
                kept = [k for k in range(len(sizes)) if all_documents or runs[k] or near[k]]
                columns = [[shard_no] * len(kept), kept, *([x[k] for k in kept] for x in (ids, keys, sizes, runs)), *([[asked.items[i] for i in sorted(x[k])] for k in kept] for x in (exact, near))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def search(index: DataFrame, asked: Windows, slop: int, all_documents: bool) -> DataFrame:
    """What a block of test items finds in a written index."""
    return arrow_map(index, _search(asked, slop, all_documents), _FOUND_SQL, BATCH_MB)


def _united(found: DataFrame) -> DataFrame:
    """The answers of all blocks about one document as one row, its runs merged."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("shard", "k", "doc_id", "key", "n_words").agg(flat("runs"), flat("items"), flat("near_items"))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, r: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], r[1]))))
    step = lambda acc, r: F.when((F.size(acc) > 0) & (r[0] <= last(acc)[1]), longer(acc, r)).otherwise(F.concat(acc, F.array(r)))
    return found.withColumn("runs", F.aggregate("runs", F.array().cast("array<array<bigint>>"), step))


def find_passages(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slop: int = 0, shard_tokens: int | None = None, store: bool = True) -> DataFrame:
    """doc_id, key (a hash of id and text), n_words, runs (hit words as [first, after]), items (ids as strings), near_items: one row per input row.

    An item with fewer words than ``width`` is one window; one without words, or with a null text, none. Items with a null
    id hit like others and are together one null in ``items``, after the ids. A null or wordless document has no hits. ``near_items`` is
    filled for slop > 0: all words of a window at most ``slop`` words out of place. Test text goes to the tasks in blocks of
    about BLOCK_BYTES, one after another, by a hash of item_id and text; every block asks the whole index, and the answers about one
    document are united, so a test set of any size gives whole results. Without
    ``store`` a small test set, of one block, is asked within the task that makes a shard, which is then not kept. Repeated rows give repeated results; a null doc_id
    stays null; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    tests = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    read = lambda i: [(r[0], None if r[1] is None else bytes(r[1])) for r in tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]
    if n == 1 and not store:
        make, ask = _index(shard_tokens or SHARD_TOKENS), _search(Windows(read(0), width), slop, True)
        return arrow_map(_own(docs, doc_id, text), lambda batches: ask(make(batches)), _FOUND_SQL).select("doc_id", "key", "n_words", "runs", "items", "near_items")
    index = scratch.save(index_documents(docs, doc_id=doc_id, text=text, shard_tokens=shard_tokens), "index")
    found = None
    for i in range(n):
        one = search(index, Windows(read(i), width), slop, i == 0)
        one = one if n == 1 else scratch.save(one, f"found{i}")
        found = one if found is None else found.unionByName(one)
    if n > 1:
        scratch.drop("index")
    return (_united(found) if n > 1 else found).select("doc_id", "key", "n_words", "runs", "items", "near_items")


def n_hit():
    """Words of a document inside any window."""
    return F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, items, verdict, and items by proximity, for every document."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    digest = lambda c: F.sha2(F.array_join(F.array_sort(c), ","), 256)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"),
        F.size("near_items").cast("long").alias("n_near_items"), digest("near_items").alias("near_items_sha256"),
    ).withColumn("contaminated", contaminated())


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 11, 2)),
         lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b WHERE len(w) > 0
), x AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2),
         lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k
), m AS (SELECT x.doc_id, x.p, x.k, q.item_id FROM x JOIN q ON x.g = q.g AND x.k = q.k),
h AS (SELECT doc_id, count(DISTINCT z) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS z FROM m) GROUP BY doc_id),
v AS (SELECT row_number() OVER () AS win, k, g, string_split(g, ' ') AS w FROM (SELECT DISTINCT k, g FROM q)),
vt AS (SELECT win, k, unnest(range(k)) AS j, unnest(w) AS term FROM v),
pt AS (SELECT doc_id, p, term FROM (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM vt)),
df AS (SELECT term, count(*) AS n FROM pt GROUP BY term),
ra AS (SELECT win, arg_min(vt.j, (coalesce(n, 0), vt.j)) AS j, arg_min(vt.term, (coalesce(n, 0), vt.j)) AS term FROM vt LEFT JOIN df ON df.term = vt.term GROUP BY win),
ca AS (SELECT DISTINCT ra.win, pt.doc_id, pt.p - ra.j + s AS start FROM ra JOIN pt ON pt.term = ra.term CROSS JOIN (SELECT unnest([-1, 0, 1]) AS s)),
lo AS (SELECT DISTINCT vt.win, vt.j, pt.doc_id, pt.p - vt.j + s AS start FROM vt JOIN pt ON pt.term = vt.term CROSS JOIN (SELECT unnest([-1, 0, 1]) AS s)),
ne AS (SELECT ca.win, ca.doc_id, ca.start FROM ca JOIN lo ON lo.win = ca.win AND lo.doc_id = ca.doc_id AND lo.start = ca.start JOIN v ON v.win = ca.win GROUP BY 1, 2, 3, v.k HAVING count(*) = v.k),
nt AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT ne.doc_id, q.item_id::VARCHAR AS i FROM ne JOIN v ON v.win = ne.win JOIN q ON q.k = v.k AND q.g = v.g) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(nt.n_items, 0)::BIGINT AS n_near_items, sha256(coalesce(nt.ids, '')) AS near_items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN nt ON nt.doc_id = d.doc_id
"""
