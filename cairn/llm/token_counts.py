"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where no token can reach across: at ASCII white space, if the tokenizer's file shows that it drops it. The
pieces repeat, so each task encodes a piece once, in batches balanced by bytes, and keeps the lengths of short pieces in a
table of bounded size; a text's count is the sum over its pieces. With any other tokenizer a text is one piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm._common import arrow_map, slices, table

#: Bytes of text that one call encodes; pieces whose length a task remembers, and their bytes at most; most tokens of a document.
BATCH_BYTES, REMEMBERED, SHORT, LIMIT = 1_000_000, 400_000, 64, 2048
_SPACES = " \t\n\v\f\r"


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once a process. Truncation and padding are switched off."""
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _parts(step: dict | None, name: str) -> list[dict]:
    return [] if not step else [p for x in step[name] for p in _parts(x, name)] if step["type"] == "Sequence" else [step]


def _splits(step: dict) -> bool:
    """Whether a pre-tokenizer drops ASCII white space and never looks across it."""
    if step["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if step["type"] != "Split" or step["behavior"] != "Removed" or not step["invert"] or "Regex" not in step["pattern"]:
        return False
    pattern = regex.compile(step["pattern"]["Regex"])
    return not any(s in m[0] for s in _SPACES for x, y in product(("", "a", "1", ".", "'", s), repeat=2) for m in pattern.finditer(x + s + y))


@lru_cache(maxsize=2)
def drops_space(path: str) -> bool:
    """Whether the file's tokenizer counts a text as the sum over its runs of anything but ASCII white space."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in _parts(file.get("normalizer"), "normalizers"))
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or set(_SPACES) & set(t["content"])) for t in file.get("added_tokens") or [])
    first = _parts(file.get("pre_tokenizer"), "pretokenizers")[:1]
    return plain and added and bool(first) and _splits(first[0])


def lengths(tokenizer: Tokenizer, pieces: list[bytes]) -> list[int]:
    """Token counts of pieces of UTF-8, encoded in batches of about BATCH_BYTES."""
    out: list[int] = []
    start = size = 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= BATCH_BYTES or i + 1 == len(pieces):
            out += [len(e) for e in tokenizer.encode_batch_fast([p.decode() for p in pieces[start : i + 1]], add_special_tokens=False)]
            start, size = i + 1, 0
    return out


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens: one row per input row.

    ``path`` names a tokenizers file, readable on every executor. A null text is empty. Special strings inside texts count
    as the library counts them by default. Repeated rows and null ids stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, split, known = load(path), drops_space(path), {}
        for batch in slices(batches, 2000):
            texts = [(t.as_py() or b"") for t in batch.column(1)]
            pieces = [t.split() if split else [t] for t in texts]
            new = list({p: 0 for own in pieces for p in own if p not in known})
            counts = dict(zip(new, lengths(tokenizer, new)))
            n = [sum(counts[p] if p in counts else known[p] for p in own) for own in pieces]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
            if len(known) + len(counts) > REMEMBERED:
                known = {}
            known.update((p, k) for p, k in counts.items() if len(p) <= SHORT)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return arrow_map(own, run, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether the limit is passed, for every document."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
