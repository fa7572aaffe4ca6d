"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Features of both views are computed once, for all documents, in one scan. Both classifiers start from a bounded sample of
labelled rows. In each round each labels, for the other, the unlabelled rows of the whole corpus that it is surest of: tasks
count margins in bins, and the bins give a threshold. A pseudo-label follows from the models and thresholds so far, so tasks find
it again where they need it and none is stored. Newton steps add up over tasks, and the sums alone reach the driver.
Held-out labels calibrate the views and weigh them against each other; then all documents are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import SPACE_WORD, Scratch, arrow_map, slices, table

#: Labelled rows that training takes at most, by a hash of the id.
LABELLED = 20_000
#: Rounds; probability from which a view is sure; share of the unlabelled rows that it may label in a round; weight penalty.
ROUNDS, SURE, PER_ROUND, RIDGE = 5, 0.95, 0.05, 1.0
#: Newton steps of a round over all rows, from the weights of the round before; bins of margins, and their width.
NEWTON, BINS, BIN = 6, 1024, 1 / 64
_HASHED = 32


def text_view(text: bytes | None) -> np.ndarray:
    """What the text itself shows: classes of characters, words, lines, and repetition."""
    t = text or b""
    n, words, lines = max(1, len(t)), t.split(), t.split(b"\n")
    seen = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    shares = [seen[a:b].sum() / n for a, b in ((65, 91), (97, 123), (48, 58), (33, 48), (58, 65), (91, 97), (123, 127), (128, 256), (0, 33))]
    single = [seen[c] / n for c in b"#*$%&|!.,<>"]
    k = max(1, len(words))
    runs = sum(a == b for a, b in zip(words, words[1:])) / k
    shape = [np.log1p(len(words)), len(t) / k, len(set(words)) / k, len(set(lines)) / len(lines), len(words) / len(lines), runs]
    return np.array([*shares, *single, *shape], np.float32)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """What is known without the text: source and language (hashed), and the stated length."""
    out = np.zeros(_HASHED + 2, np.float32)
    for name, value in (("source", source), ("lang", lang)):
        out[xxhash.xxh3_64_intdigest(f"{name}={value}".encode()) % _HASHED] += 1
    out[_HASHED:] = [np.log1p(max(0, n_chars or 0)), n_chars is None]
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features; then a calibrated line on its margin."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        new = cls(mean, scale, np.zeros(x.shape[1] + 1))
        return replace(new, weights=_newton(new.inputs(x), y))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.inputs(x) @ self.weights) + self.shift

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        slope, shift = _newton(np.c_[self.margin(x), np.ones(len(x))], y).tolist()
        return replace(self, slope=slope, shift=shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hessian (flat), gradient and value of the log loss."""
    z = x @ w
    p = _sigmoid(z)
    return np.r_[((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (p - y), (np.logaddexp(0, z) - y * z).sum()]


def _descended(weights: list[np.ndarray], sums: Callable[[list[np.ndarray]], list[np.ndarray]], steps: int) -> list[np.ndarray]:
    """Weights of several ridge regressions after Newton steps at once; a step that makes a loss larger is halved, until it does not."""
    best: list[tuple[float, np.ndarray]] = [(np.inf, w) for w in weights]
    for _ in range(steps):
        for k, (w, total) in enumerate(zip(weights, sums(weights))):
            d = len(w)
            ridge = np.full(d, RIDGE)
            ridge[-1] = 1e-6
            loss = total[-1] + (ridge * w * w).sum() / 2
            if loss > best[k][0] * (1 + 1e-12):
                weights = [(w + best[k][1]) / 2 if i == k else v for i, v in enumerate(weights)]
            else:
                best[k] = (loss, w)
                step = np.linalg.solve(total[: d * d].reshape(d, d) + np.diag(ridge), total[d * d : -1] + ridge * w)
                weights = [w - step if i == k else v for i, v in enumerate(weights)]
        if max(np.abs(w - b[1]).max() for w, b in zip(weights, best)) < 1e-6:
            break
    return [w for _, w in best]


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _descended([np.zeros(x.shape[1])], lambda w: [_sums(x, y, w[0])], 50)[0]


@dataclass
class Round:
    """The views at the start of a round; by view and label, the bin of the margin from which it labels a row for the other view."""

    views: list[Logistic]
    least: dict[tuple[int, int], int]


def _bins(model: Logistic, x: np.ndarray) -> dict[int, np.ndarray]:
    """For either label, the bin of each row's margin in its favour; -1 if the view is not sure."""
    z = model.margin(x)
    low = np.log(SURE / (1 - SURE))
    return {y: np.where(m >= low, np.minimum((np.maximum(m - low, 0) / BIN).astype(int), BINS - 1), -1) for y, m in ((1, z), (0, -z))}


def given(rounds: list[Round], x: list[np.ndarray]) -> list[np.ndarray]:
    """The pseudo-labels that each view has been given, NaN for none; the first one stays."""
    out = [np.full(len(x[0]), np.nan) for _ in range(2)]
    for r in rounds:
        for own in (0, 1):
            for y, at in _bins(r.views[own], x[own]).items():
                out[1 - own][(at >= r.least[own, y]) & (at >= 0) & np.isnan(out[1 - own])] = y
    return out


def _views(batch: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float) for i in (first, first + 1)]


def _added_up(rows: DataFrame, make: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of the vectors that ``make`` gives for a batch of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = make(_views(batch, 0))
                total = new if total is None else [a + b for a, b in zip(total, new)]
        for k, v in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v, pa.float64())], names=["k", "i", "v"])

    found = arrow_map(rows.select("text_view", "meta_view"), run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).orderBy("k", "i").toPandas()
    return [found["v"][found["k"] == k].to_numpy() for k in range(found["k"].max() + 1 if len(found) else 0)]


def _least(rounds: list[Round], views: list[Logistic], rows: DataFrame, pool: int, good: float) -> dict[tuple[int, int], int]:
    """The bins from which rows without a label of their own are labelled: whole bins from the top, PER_ROUND of the pool at most, one bin at least."""

    def count(x: list[np.ndarray]) -> list[np.ndarray]:
        have, out = given(rounds, x), []
        for own in (0, 1):
            for at in _bins(views[own], x[own]).values():
                out.append(np.bincount(at[(at >= 0) & np.isnan(have[1 - own])], minlength=BINS).astype(float))
        return out

    least = {}
    for (own, y), n in zip(((0, 1), (0, 0), (1, 1), (1, 0)), _added_up(rows, count)):
        most = max(1.0, PER_ROUND * pool * (good if y else 1 - good))
        from_top = np.cumsum(n[::-1])[::-1]
        fit = np.flatnonzero(from_top <= most)
        top = np.flatnonzero(n)
        least[own, y] = min(int(fit[0]) if len(fit) else BINS, int(top[-1]) if len(top) else BINS)
    return least


@dataclass
class CoTrained:
    """Both views and the weights of their calibrated margins."""

    views: list[Logistic]
    weights: np.ndarray
    rounds: list[Round]

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of both views together, then of each."""
        margins = [m.margin(x) for m, x in zip(self.views, views)]
        return [_sigmoid(np.c_[margins[0], margins[1], np.ones(len(margins[0]))] @ self.weights), *map(_sigmoid, margins)]


def co_train(labelled: list[np.ndarray], y: np.ndarray, rows: DataFrame, pool: int) -> CoTrained | float:
    """The model, or the share of good rows (0.5 without labels) where labels leave nothing to learn. ``rows``: all ``pool`` unlabelled rows."""
    if len(y) < 8 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    check = np.arange(len(y)) % 4 == 3
    if y[check].min() == y[check].max() or y[~check].min() == y[~check].max():
        check[:] = False
    fit = ~check
    used = check if check.any() else fit
    views, rounds = [Logistic.fit(x[fit], y[fit]) for x in labelled], []
    for _ in range(ROUNDS if pool else 0):
        rounds.append(Round(views, _least(rounds, views, rows, pool, y.mean())))

        def sums(weights: list[np.ndarray]) -> list[np.ndarray]:
            now = [replace(v, weights=w) for v, w in zip(views, weights)]

            def make(x: list[np.ndarray]) -> list[np.ndarray]:
                got = given(rounds, x)
                return [_sums(now[k].inputs(x[k][(new := ~np.isnan(got[k]))]), got[k][new], now[k].weights) for k in (0, 1)]

            return [s + _sums(now[k].inputs(labelled[k][fit]), y[fit], now[k].weights) for k, s in enumerate(_added_up(rows, make))]

        views = [replace(v, weights=w) for v, w in zip(views, _descended([v.weights for v in views], sums, NEWTON))]
    views = [v.calibrated(x[used], y[used]) for v, x in zip(views, labelled)]
    margins = [v.margin(x[used]) for v, x in zip(views, labelled)]
    return CoTrained(views, _newton(np.c_[margins[0], margins[1], np.ones(used.sum())], y[used]), rounds)


def features(docs: DataFrame, pages: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """doc_id, text_view, meta_view: one row per input row; page features are 0 where no page has the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = [text_view(x.as_py()) for x in batch.column(1)]
            m = [meta_view(*r) for r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.list_(pa.float32())) for c in (t, m))], names=["doc_id", "text_view", "meta_view"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(n_chars).cast("long").alias("n_chars"))
    made = arrow_map(own, run, "doc_id long, text_view array<float>, meta_view array<float>")
    count = lambda c, p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).cast("float")
    page = pages.filter("page_id IS NOT NULL").select(F.col("page_id").alias("p_id"), F.array(
        F.lit(1.0).cast("float"), F.coalesce(F.length("url"), F.lit(0)).cast("float"), count("url", "/"), count("url", r"[?#]"), count("url", "^https"),
        F.log1p(F.coalesce(F.length("html"), F.lit(0))).cast("float"), count("html", "<p>"), count("html", "<a "), count("html", SPACE_WORD),
    ).alias("page"))
    page = page.groupBy("p_id").agg(F.max("page").alias("page"))
    none = F.array_repeat(F.lit(0.0).cast("float"), 9)
    return made.join(page, F.col("doc_id") == F.col("p_id"), "left").select("doc_id", "text_view", F.concat("meta_view", F.coalesce("page", none)).alias("meta_view"))


def _first(rows: DataFrame, most: int):
    """The first ``most`` rows by a hash of the id, as pandas. A threshold on the hash lets tasks send little more than those."""
    n, parts = rows.count(), 1 << 20
    near = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(min(1.0, 1.1 * most / max(n, 1) + 1000 / max(n, 1)) * parts) + 1)
    return near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)), "doc_id", "text_view", "meta_view").limit(most).toPandas()


def classify_quality(docs: DataFrame, pages: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, **columns: str) -> DataFrame:
    """doc_id, score, text_score, meta_score: one row per input row, scores being probabilities of good quality.

    At most ``labelled`` labelled rows, the first by a hash of the id (ties by id, then features), train the model; that bound is
    the only one. Every row without a label can get pseudo-labels. Null labels are left out; a document's largest label
    counts. Null texts, sources, languages and lengths have features of their own. With no labels or one class all
    scores are the share of good rows, or 0.5. Repeated rows and null ids stay; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("m_id")).agg(F.max("quality").alias("quality"))
    made = features(docs, pages, **columns)
    made = scratch.save(made.join(marks, F.col("doc_id") == F.col("m_id"), "left").drop("m_id"), "features")
    known = _first(made.filter("quality IS NOT NULL"), labelled)
    others = made.filter("quality IS NULL")
    stack = lambda frame, c: np.stack(frame[c].to_list()).astype(float) if len(frame) else np.zeros((0, 1))
    model = co_train([stack(known, c) for c in ("text_view", "meta_view")], known["quality"].to_numpy(float), others, others.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if isinstance(model, float) or not rows:
                found = [np.full(rows, model if isinstance(model, float) else 0.5)] * 3
            else:
                found = model.scores(_views(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in found)], names=["doc_id", "score", "text_score", "meta_score"])

    return arrow_map(made.select("doc_id", "text_view", "meta_view"), run, "doc_id long, score double, text_score double, meta_score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    found = classify_quality(*(table(spark, sf_dir, t) for t in ("documents", "pages", "labels")))
    return found.withColumn("kept", F.col("score") >= 0.5)
