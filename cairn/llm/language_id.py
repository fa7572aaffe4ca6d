"""Language ID by multilingual mixtures: expectation-maximisation over n-gram likelihoods, then a penalised choice.

Training sums byte-trigram counts of each language over all its documents: tasks add up dense counts, one shuffle adds up
the tasks. A document's proportions maximise the likelihood of its trigrams under a mixture of the languages. Languages
enter the set one by one, largest first; each set has proportions of its own, found by the same steps, and is taken
if its log likelihood exceeds that of the smaller set by a penalty that grows with length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._common import arrow_map, slices, table

#: Buckets of trigrams (hashed), trigrams of text that are expanded at once, smoothing, steps of a mixture at most and the change that ends them.
BUCKETS, PIECE, SMOOTH, STEPS, CLOSE = 1 << 15, 500_000, 0.5, 20, 1e-3
#: A further language must gain PENALTY * log(trigrams) in log likelihood, and have a share of at least SHARE.
PENALTY, SHARE = 2.0, 0.02
#: Languages that a model can have: it takes 128 KB of a task for each, training twice that.
MOST_LANGUAGES = 500
_LETTER = regex.compile(r"\p{L}")
_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UND = "und"


def _letters(text: str) -> bytes:
    """The lower-cased text between spaces, all but letters taken as space."""
    return f"  {text.lower()}  ".encode("utf-8", "replace").translate(_SPACE)


def _buckets(letters: bytes) -> np.ndarray:
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    ids = ((b[:-2] * np.uint32(961) + b[1:-1] * np.uint32(31) + b[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    return ids[(b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)]


def grams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of the lower-cased text, all but letters taken as space."""
    return _buckets(_letters(text))


def tally(text: str, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's trigrams and how often each occurs; ``piece`` of them are expanded at once."""
    letters, total = _letters(text), np.zeros(BUCKETS, np.int64)
    for i in range(0, len(letters) - 2, piece):
        total += np.bincount(_buckets(letters[i : i + piece + 2]), minlength=BUCKETS)
    seen = np.flatnonzero(total)
    return seen, total[seen]


def shares(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (likelihoods of the seen trigrams) by expectation-maximisation, and their log likelihood."""
    share, n = np.full(len(p), 1 / len(p)), counts.sum()
    for _ in range(STEPS if len(p) > 1 else 0):
        joint = share[:, None] * p
        new = (joint * (counts / joint.sum(axis=0))).sum(axis=1) / n
        moved, share = np.abs(new - share).max(), new
        if moved < CLOSE:
            break
    return share, float(counts @ np.log(share @ p))


@dataclass(frozen=True)
class Model:
    """Languages, and for each the log probability of every bucket."""

    languages: list[str]
    log_p: np.ndarray

    def mixture(self, ids: np.ndarray) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first, of a list of buckets."""
        return self.chosen(*np.unique(ids, return_counts=True))

    def chosen(self, seen: np.ndarray, counts: np.ndarray) -> list[tuple[str, float]]:
        """The same of distinct buckets and how often each occurs."""
        log_p = self.log_p[:, seen]
        p = np.exp(log_p - log_p.max(axis=0))
        share, _ = shares(p, counts)
        order = np.argsort(-share, kind="stable")
        chosen = order[:1]
        found, best = shares(p[chosen], counts)
        for i in order[1:]:
            if share[i] < SHARE:
                break
            more = np.r_[chosen, i]
            next_found, gained = shares(p[more], counts)
            if gained - best <= PENALTY * np.log(counts.sum()):
                break
            chosen, found, best = more, next_found, gained
        return sorted(((self.languages[i], float(w)) for i, w in zip(chosen, found)), key=lambda x: (-x[1], x[0]))


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a text and a language; what reaches the driver is BUCKETS numbers a language at most.

    More than MOST_LANGUAGES values of ``lang`` are an error: they are not languages, and none is left out silently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            open_: dict[str, list[str]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                open_.setdefault(name, []).append(t.as_py())
            for name, texts in open_.items():
                add(sums, name, texts)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    def add(sums: dict[str, np.ndarray], name: str, texts: list[str]) -> None:
        total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
        open_, size = [], 0
        for piece in (t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)):  # cuts depend on the text alone
            open_.append(piece)
            size += len(piece)
            if size >= PIECE:
                total += np.bincount(grams("   ".join(open_)), minlength=BUCKETS)  # no trigram reaches across
                open_, size = [], 0
        if open_:
            total += np.bincount(grams("   ".join(open_)), minlength=BUCKETS)

    used = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    if used.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = arrow_map(used, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    total = np.zeros((len(languages), BUCKETS))
    total[np.searchsorted(np.array(languages, dtype=object), counts["lang"].to_numpy(dtype=object)), counts["bucket"]] = counts["n"]
    total += SMOOTH
    return Model(languages, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """row (all columns of the input, as a struct), lang_pred, score, languages (lang, share): one row per input row.

    ``score`` is the share of lang_pred. A null text, one without a letter, and any text under a model without languages
    get ``und``, 0 and no languages.
    """
    out = T.StructType([
        T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in slices(batches):
            found = []
            for t in batch.column(0).field(text):
                t = t.as_py()
                found.append(model.chosen(*tally(t)) if t and model.languages and _LETTER.search(t) else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0][0] if f else UND for f in found], pa.string()), pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                pa.array([[{"lang": a, "share": b} for a, b in f] for f in found], kind),
            ], names=["row", "lang_pred", "score", "languages"])

    return arrow_map(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), run, out)


def held_out():
    """Whether learning leaves a document out; not so for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and chosen languages (largest first) of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.filter(~held_out())))
    names = F.array_join(F.transform("languages", lambda x: x["lang"]), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", names.alias("languages")).withColumn("held_out", held_out())
