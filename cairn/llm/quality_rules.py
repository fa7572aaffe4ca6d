"""Quality rules [native]: a threshold table compiled into one projection of ratios.

``RULES`` states each rule as (name, ratio, least, most). ``quality_rules`` turns the text into counts with
array functions and the table into one boolean expression per rule: no user function, no shuffle, one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import SPACE_WORD, table, words_of

SYMBOLS = r"[#*$%&|<>]"

#: Function words of the languages that the rules are meant for (parameter of ``quality_rules``).
STOP_WORDS = (
    "the of and to in a is that it for with as was on be by "
    "le la les de des et un une que qui en dans pour "
    "der die das und ein eine zu den von mit ist nicht "
    "el los las y del se por con para una"
).split()

#: Rule, count, what it is divided by (None: nothing), least and most allowed value (None: no bound).
Rule = tuple[str, str, str | None, float | None, float | None]
RULES: tuple[Rule, ...] = (
    ("length", "n_words", None, 50, 200_000),
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("repetition", "n_repeat_words", "n_words", None, 0.5),
)


def _counts(docs: DataFrame, doc_id: str, text: str, stop_words: Sequence[str]) -> DataFrame:
    """One row per document with the counts that rules refer to.

    Every step is its own projection whose columns the next one uses more than once, so that Catalyst keeps them
    apart and evaluates each once.
    """
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(SPACE_WORD))
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    split = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("*", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    flat = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)).alias("windows"),
    )
    # Equal windows are neighbours once sorted; a window's words are its position and the two after it.
    ordered = flat.withColumn("windows", F.sort_array("windows"))
    same = lambda k, j: F.coalesce(F.get("windows", k)["h"] == F.get("windows", j)["h"], F.lit(False))
    at = lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get("windows", k)["i"])
    found = ordered.withColumn("windows", F.when(F.size("windows") >= 2, F.array_compact(F.transform(F.sequence(F.lit(0), F.size("windows") - 1), at))))
    covered = F.array_distinct(F.concat("windows", F.transform("windows", lambda i: i + 1), F.transform("windows", lambda i: i + 2)))
    return found.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("windows")


def _compiled(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row breaks. A ratio without a value (no words, no lines) breaks nothing."""
    broken = []
    for name, count, per, least, most in rules:
        value = F.try_divide(count, per) if per else F.col(count)
        outside = [test(value, F.lit(bound)) for test, bound in ((lambda v, b: v < b, least), (lambda v, b: v > b, most)) if bound is not None]
        broken.append(F.when(F.coalesce(F.greatest(*outside, F.lit(False)), F.lit(False)), F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] = tuple(STOP_WORDS),
) -> DataFrame:
    """Counts and broken rules of every row: one output row per input row, repeated rows included.

    A null or empty text has no words; it breaks ``length``. A null ``doc_id`` stays null. Other columns are not
    read, whatever their names. Windows are compared by a 64-bit hash of their three words.
    """
    counts = _counts(docs, doc_id, text, stop_words)
    return counts.withColumn("broken", _compiled(rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, the base verdict and the verdict of all rules, for every document."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & (F.size("broken") == 0)).alias("kept"),
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT *, CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1),
         lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) ELSE [] END AS grams FROM w
), e AS (
  SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g
), r AS (
  SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), n AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM g LEFT JOIN c ON g.doc_id = c.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 200000 AND word_chars / n_words BETWEEN 2.0 AND 15.0
       AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.02
       AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, TRUE)
       AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""
