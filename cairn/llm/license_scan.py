"""Licence scans: matching statistics of each file against a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. Streaming a text through it gives, at each word, the longest run of
words ending there that occurs in some template. Runs that cannot grow are chained by their places in a
template into spans; a template whose words are covered well enough gives its label, unless another template covers
more words of the same place. Base phrases are substrings too: one ends wherever its state is the current one or a suffix
of it. One scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map, slices, table
from cairn.llm.decontaminate import tokens
from cairn.llm.licenses import TEMPLATES

#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Words of a run that counts; words between runs of a chain; covered share of a template that gives its label.
RUN, GAP, COVERED = 4, 8, 0.7


class Automaton:
    """Generalised suffix automaton (Blumer et al., 1985) of token sequences; state 0 is the empty run."""

    def __init__(self, sequences: Sequence[Sequence[int]], phrases: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.at = [-1], [0], [{}]  # at: template -> last words of occurrences
        for k, sequence in enumerate(sequences):
            state = 0
            for i, token in enumerate(sequence):
                state = self._extend(state, token)
                self.at[state].setdefault(k, []).append(i)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= RUN:  # shorter runs are not asked for their places
                for k, places in self.at[s].items():
                    self.at[self.link[s]].setdefault(k, []).extend(places)
        for own in self.at:
            for places in own.values():
                places.sort()
        #: Phrases that end where a run of this state ends, with their lengths.
        own: dict[int, list[tuple[int, int]]] = {}
        for p, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                state = self.next[state][token]
            own.setdefault(state, []).append((p, len(phrase)))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrases[s] = own.get(s, []) + self.phrases[self.link[s]]

    def _add(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.at.append({})
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, token: int, to: int) -> int:
        """The state of the run ``state`` + ``token``, cut off from the longer runs of ``to`` where there are any."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._add(self.length[state] + 1, to)
        self.link[to] = copy
        while state >= 0 and self.next[state].get(token) == to:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, state = self._add(self.length[last] + 1), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, token, self.next[state][token])
        return new


class Scanner:
    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        ids = lambda x: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(x.encode())]
        own = [ids(p) for p, _ in phrases]
        self.templates = [*own, *(ids(t) for t, _ in templates)]
        self.labels = [x for _, x in (*phrases, *templates)]
        self.n_base = len(own)
        self.automaton = Automaton(self.templates, own)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base places as (start, phrase); runs as (start, end, state), none of which could be longer."""
        a, places, runs = self.automaton, [], []
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        state = length = 0
        before = -1
        for i in np.flatnonzero(known).tolist():
            token = int(known[i])
            if i != before + 1 and length:  # an unknown word ended the run
                if length >= RUN:
                    runs.append((before + 1 - length, before, state))
                state = length = 0
            if token not in a.next[state]:
                if length >= RUN:
                    runs.append((before + 1 - length, before, state))
                while state and token not in a.next[state]:
                    state = a.link[state]
                length = a.length[state]
            if token in a.next[state]:
                state, length = a.next[state][token], length + 1
            places += [(i + 1 - n, p) for p, n in a.phrases[state] if n <= length]
            before = i
        if length >= RUN:
            runs.append((before + 1 - length, before, state))
        return sorted(places), runs

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(start, end, template, covered share): runs of one template, in its order and at most GAP words apart.

        Of the places that a run has in a template the first that continues the chain is taken, else the first.
        """
        out, open_ = [], {}

        def close(k: int) -> None:
            start, end, _, covered = open_.pop(k)
            out.append((start, end, k, min(1.0, covered / len(self.templates[k]))))

        for start, end, state in runs:
            for k, places in self.automaton.at[state].items():
                if k < self.n_base:
                    continue
                last = None
                if k in open_:
                    if start - open_[k][1] - 1 <= GAP:
                        last = next((t for t in places if t > open_[k][2] and t - (end - start) > open_[k][2] - GAP), None)
                    if last is None:
                        close(k)
                if k in open_:
                    s, e, t, covered = open_[k]
                    open_[k] = (s, max(e, end), last, covered + max(0, min(end - e, last - t)))
                else:
                    open_[k] = (start, end, places[0], end - start + 1)
        for k in list(open_):
            close(k)
        return sorted(out)

    def spans(self, runs: list[tuple[int, int, int]], covered: float) -> list[tuple[int, int, int, float]]:
        """The chains that cover their template well enough; of those that share more than half of the shorter, the one that covers most words."""
        words = lambda x: x[3] * len(self.templates[x[2]])
        overlap = lambda x, y: 2 * (min(x[1], y[1]) - max(x[0], y[0]) + 1) > min(x[1] - x[0], y[1] - y[0]) + 1
        places: list[list[tuple[int, int, int, float]]] = []  # chains that reach into each other
        reach = -1
        for x in self.chains(runs):
            if x[3] < covered:
                continue
            if x[0] > reach:
                places.append([])
            places[-1].append(x)
            reach = max(reach, x[1])
        out = []
        for place in places:
            best: list[tuple[int, int, int, float]] = []
            for x in sorted(place, key=lambda x: (-words(x), -x[3], x)):
                if not any(overlap(x, y) for y in best):
                    best.append(x)
            out += sorted(best)
        return out


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, places (start, label of each base phrase), spans (start, end, label, score): one row per input row.

    Starts and ends count words from 0, the end inclusive; spans cover at least ``covered`` of a template, and more words than others at their place. A null
    or empty text has no words. Repeated rows and null ids stay; other columns are not read.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches):
            n, places, spans = [], [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                found, runs = scanner.scan(words)
                n.append(len(words))
                places.append([{"start": s, "label": scanner.labels[p]} for s, p in found])
                spans.append([{"start": s, "end": e, "label": scanner.labels[k], "score": c} for s, e, k, c in scanner.spans(runs, covered)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((n, places, spans), list(schema)[1:]))], schema=schema)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return arrow_map(own, run, "doc_id long, n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,score:double>>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score, for every document."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    base = F.transform("places", lambda x: x["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(base, F.transform("spans", lambda x: x["label"])).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
