"""From lines to chunks: boilerplate, titles, sections, windows, ids, flags, supersession, reports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as X

PREAMBLE, CAP, OVERLAP = "preâmbulo", 1200, 150
HEADING = r"^\d+(\.\d+)*\s+[A-ZÀ-Ú]"


def boilerplate(lines: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Doc, key of digit-normalised lines that are on at least ``min_share`` of a document's pages, of which it has several."""
    keyed = lines.withColumn("key", X.digit_key(F.col("text"))).filter("key <> ''")
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("n_pages")).filter("n_pages > 1")
    on = keyed.groupBy("doc", "key").agg(F.count_distinct("page").alias("n"))
    return on.join(pages, "doc").filter(F.col("n") >= min_share * F.col("n_pages")).select("doc", "key", "n", "n_pages")


def without_boilerplate(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines whose key is not boilerplate in their document."""
    return lines.withColumn("key", X.digit_key(F.col("text"))).join(keys.select("doc", "key"), ["doc", "key"], "left_anti")


def without_frequent_lines(lines: DataFrame, min_share: float = 1.0) -> DataFrame:
    """The simpler rule: lines as they stand, dropped if they occur at least as often as the document has pages."""
    pages = lines.groupBy("doc").agg((F.count_distinct("page") * min_share).alias("bound"))
    often = lines.groupBy("doc", "text").agg(F.count("*").alias("n")).join(pages, "doc").filter("n >= bound")
    return lines.join(often.select("doc", "text"), ["doc", "text"], "left_anti")


def titles(lines: DataFrame, header: str = X.DOC_HEADER, unit: Sequence[str] = ("doc",)) -> DataFrame:
    """The line above the first header line of each unit; units without one are left out."""
    above = lines.withColumn("title", F.lag("text").over(W.partitionBy(*unit).orderBy("page", "line_no")))
    first = F.min_by("title", F.struct("page", "line_no"))
    return above.filter(F.col("text").rlike(header) & F.col("title").isNotNull()).groupBy(*unit).agg(first.alias("title"))


def sections(lines: DataFrame, is_heading: Column, unit: Sequence[str] = ("doc",)) -> DataFrame:
    """Unit, section_no, heading, body, page_from, page_to. Lines before a heading are the preamble; bodies are not empty."""
    order = W.partitionBy(*unit).orderBy("page", "line_no")
    marked = lines.withColumn("h", is_heading).withColumn("section_no", F.sum(F.col("h").cast("long")).over(order))
    head = F.coalesce(F.max(F.when(F.col("h"), F.col("text"))), F.lit(PREAMBLE))
    body = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("page", "line_no", "text"))))
    made = marked.groupBy(*unit, "section_no").agg(head.alias("heading"), body.alias("rows")).filter(F.size("rows") > 0)
    at = lambda i: F.element_at("rows", i)["page"]
    return made.select(*unit, "section_no", "heading", F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("body"), at(1).alias("page_from"), at(-1).alias("page_to"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _windows(texts: pd.Series, caps: pd.Series, overlaps: pd.Series) -> pd.Series:
    def cut(text: str | None, cap: int, overlap: int) -> list[str]:
        pieces, start = [], 0
        while text and start < len(text):
            end = min(start + cap, len(text))
            if end < len(text) and (space := text.rfind(" ", start, end)) - start >= cap // 3:
                end = space + 1
            if piece := text[start:end].strip():
                pieces.append(piece)
            if end >= len(text):
                break
            start = max(end - overlap, start + 1)
        return pieces

    return pd.Series([cut(*row) for row in zip(texts, caps, overlaps)])


def windows(text: Column, cap: int = CAP, overlap: int = OVERLAP) -> Column:
    """Overlapping pieces of at most ``cap`` characters, cut after a space unless that leaves less than a third.

    Where a piece starts depends on where the one before ended, which column functions cannot say over texts of any
    length; texts that fit in one piece do not reach the Arrow function.
    """
    return F.when(F.length(text) <= cap, F.filter(F.array(F.trim(text)), lambda p: p != "")).otherwise(_windows(text, F.lit(cap), F.lit(overlap)))


def chunk_ids(pieces: DataFrame, unit: Sequence[str] = ("code",)) -> DataFrame:
    """``code#vVersion#slug``, with ``-n`` from the second piece of a heading on."""
    n = F.row_number().over(W.partitionBy(*unit, "version", "heading").orderBy("section_no", "piece"))
    return pieces.withColumn("n", n).withColumn("id", F.concat("code", F.lit("#v"), "version", F.lit("#"), X.slug(F.col("heading")), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n"))).otherwise(F.lit(""))))


def flagged(chunks: DataFrame, phone: str = X.PHONE_BR) -> DataFrame:
    """pii_kinds, contains_pii and the masked text; a table is also flagged if a header matched."""
    kinds = X.pii_kinds(F.col("text"), phone)
    header = F.col("header_hit") if "header_hit" in chunks.columns else F.lit(False)
    return chunks.withColumns({"pii_kinds": kinds, "contains_pii": (F.size(kinds) > 0) | header, "text": X.redact(F.col("text"), phone)})


def superseded(docs: DataFrame, history: DataFrame) -> DataFrame:
    """Docs (code, version, effective_date) with superseded and reason.

    A version that the history (code, by_version, version, status) of any document of its code calls ``superada`` is
    superseded by that declaration, the largest by_version naming the reason; else by the latest later date.
    """
    declared = history.filter(F.lower("status").contains("superada")).groupBy("code", "version").agg(F.max("by_version").alias("by_version"))
    newest = docs.groupBy("code").agg(F.max_by(F.struct("version", "effective_date"), F.struct("effective_date", "version")).alias("newest"))
    all_ = docs.join(declared, ["code", "version"], "left").join(newest, "code")
    later = F.col("newest.effective_date") > F.col("effective_date")
    reason = F.when(F.col("by_version").isNotNull(), F.concat(F.lit("superada @ "), "code", F.lit(" v"), "by_version", F.lit(" Histórico"))).when(
        later, F.concat(F.lit("later effective "), F.col("newest.version"), F.lit(" "), F.col("newest.effective_date").cast("string"))
    )
    return all_.select("code", "version", "effective_date", (F.col("by_version").isNotNull() | later).alias("superseded"), reason.alias("reason"))


def _counts() -> tuple[Column, ...]:
    return F.count("*").alias("n_chunks"), F.count_if(F.col("contains_pii")).alias("n_pii"), F.count_if(F.col("superseded")).alias("n_superseded")


def report(chunks: DataFrame) -> DataFrame:
    """Counts per (code, version), and a row of totals whose code is null."""
    return chunks.groupingSets([["document_code", "version"], []], "document_code", "version").agg(*_counts())


def write_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Stores the chunks and returns the report on them, without making them twice.

    The totals are observed while the rows are written. The lines of documents are as many as documents, which no observation can
    hold: they are counted from the four columns they need of what was stored; no text is read again.
    """
    seen = Observation()
    chunks.observe(seen, *_counts()).write.parquet(path)
    lines = chunks.sparkSession.read.schema(chunks.schema).parquet(path).groupBy("document_code", "version").agg(*_counts())
    totals = [None, None, *(seen.get[c] for c in lines.columns[2:])]
    return lines.unionByName(chunks.sparkSession.createDataFrame([tuple(totals)], lines.schema))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, and distinct (code, version)."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("document_code", "version").alias("n_versions"))
