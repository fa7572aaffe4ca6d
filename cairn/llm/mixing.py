"""Mixing sources to target weights [native]: entropy balancing, then rounding into whole copies.

Among all document rates 0 <= r <= 2 whose words meet each source's target, the balanced ones stay closest in relative
entropy to r = 1. They are exponential tilts, held at the bound: r = min(2, exp(lambda * size / mean size)), with one multiplier
a source, the root of a convex dual, found by Newton steps whose sums Spark takes over a histogram of (source, size).
Rates become copies by a threshold on a random key of the row, set so that the words taken meet the target; smaller documents
then fill what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm._common import SPACE_WORD, Scratch, table

#: Weights by rank of the source, repeating; share of all words that the mix has; most copies of a document.
WEIGHTS, SHARE, COPIES = (3.0, 1.0, 2.0), 1.5, 2
#: Newton stops when every source is within this share of its target; then buckets of the rounding threshold.
CLOSE, STEPS, BUCKETS, FILLS = 1e-6, 60, 4096, 3
#: Equal rows that one task counts out again.
REPEATS = 4096
#: Sources whose one row each is broadcast to the documents; more are joined by a shuffle, whose skew Spark splits.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame) -> DataFrame:
    """Words due from each source (column ``source``, ``source_size``): shares by weight, at most ``COPIES`` times its size.

    Sources above their bound are set to it and the excess is shared by weight among the rest, until none is above. With
    sources in order of bound / weight that is one running sum: a source is bound if the level which all before it
    leave reaches its bound. One row a source goes through these windows.
    """
    ranked = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    r = ranked.withColumns({"weight": F.get(weights, F.col("k") % len(WEIGHTS)), "bound": F.col("source_size") * float(COPIES)})
    everything, before = W.partitionBy(), W.orderBy(F.col("bound") / F.col("weight"), "k").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumns({
        "due": SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    r = r.withColumn("free", F.col("due") / F.col("left") * F.col("weight") < F.col("bound"))
    level = F.max(F.when(F.col("free"), F.struct(-F.col("bound") / F.col("weight"), -F.col("k"), F.col("due") / F.col("left"))))
    r = r.withColumn("level", level.over(everything)["col3"])
    return r.select("source", "source_size", F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("bound")).alias("target"))


def _rate(size: Column) -> Column:
    return F.least(F.lit(float(COPIES)), F.exp(F.col("lambda") * size / F.col("mean")))


def _by_source(rows: DataFrame, facts: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with the facts of their source; a null source matches a null source. The facts' other names must be new."""
    facts = facts.withColumnRenamed("source", "f_source")
    return rows.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("f_source")), how).drop("f_source")


def balance(scratch: Scratch, histogram: DataFrame, due: DataFrame, few: bool) -> DataFrame:
    """The multiplier of each source: safeguarded Newton steps on the dual, all sources at once.

    A source at its bound has no finite multiplier: its documents all get ``COPIES``. One without words keeps its start. A step
    at most doubles the multiplier, and one that leaves the bracket of the root is replaced by its middle, so the steps cannot diverge.
    """
    mean = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = due.join(mean, due["source"].eqNullSafe(mean["source"])).select(
        due["source"], "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"),
        (F.col("target") < F.col("source_size") * (COPIES - 1e-9)).alias("free"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
        F.coalesce(F.ln(F.try_divide("target", "source_size")), F.lit(0.0)).alias("lambda"),
        F.lit(1.0).alias("off"),
    )
    state = scratch.save(state.coalesce(1), "step0")
    for i in range(1, STEPS + 1):
        one = _by_source(histogram, state, few)
        words = F.col("n") * F.col("size")
        r = _rate(F.col("size"))
        sums = one.groupBy(*(F.col(c) for c in state.columns)).agg(
            F.sum(words * r).alias("taken"), F.sum(F.when(r < COPIES, words * F.col("size") / F.col("mean") * r).otherwise(0.0)).alias("slope")
        )
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("lambda")).otherwise(F.col("low")), F.when(gap > 0, F.col("lambda")).otherwise(F.col("high"))
        most = 2 * F.abs("lambda") + 4
        step = F.greatest(F.least(F.col("lambda") - gap / F.greatest("slope", F.lit(1e-12)), most), -most)
        moved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        off = F.abs(gap) / F.greatest("target", F.lit(1.0))
        done = ~F.col("free") | (F.col("source_size") == 0) | (off < CLOSE)
        new = {"low": low, "high": high, "lambda": F.when(done, F.col("lambda")).otherwise(moved), "off": F.when(done, 0.0).otherwise(off)}
        state = scratch.save(sums.select(*(new.get(c, F.col(c)).alias(c) for c in state.columns)).coalesce(1), f"step{i}")
        scratch.drop(f"step{i - 1}")
        if state.agg(F.max("off")).first()[0] in (None, 0.0):
            break
    return state.select("source", "source_size", "target", "mean", "free", "lambda")


def _fill(docs: DataFrame, first: bool, few: bool) -> DataFrame:
    """One more copy for documents in order of ``key`` while a source's words stay within its target.

    The order is cut at a bucket by sums of whole buckets; a window runs only over each source's cut bucket.
    ``first``: else only documents that fit what is left take part, so that the cut can skip large ones.
    """
    left = docs.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("have"))
    d = _by_source(docs, left.select("source", F.greatest(F.col("target") - F.col("have"), F.lit(0.0)).alias("left")), few)
    may = (F.col("copies") < COPIES) & (F.col("size") > 0) & (F.lit(True) if first else F.col("size") <= F.col("left"))
    d = d.withColumn("bucket", F.when(may, F.floor((F.col("key") + 1) / 2 * BUCKETS)))
    sums = d.filter("bucket IS NOT NULL").groupBy("source", "bucket", "left").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    cut = sums.withColumn("upto", upto).filter("upto > left").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("cut"))
    d = _by_source(d, cut, few, "left")
    whole = F.coalesce(F.col("bucket") < F.col("cut.bucket"), F.col("bucket").isNotNull())
    at_cut = d.filter(F.col("bucket") == F.col("cut.bucket"))
    run = F.sum("size").over(W.partitionBy("source").orderBy("key", "row_id", "size").rowsBetween(W.unboundedPreceding, 0))
    inside = at_cut.withColumn("more", (F.col("cut.before") + run <= F.col("left")).cast("int"))
    rest = d.filter(F.coalesce(F.col("bucket") != F.col("cut.bucket"), F.lit(True))).withColumn("more", whole.cast("int"))
    return rest.unionByName(inside).select(*docs.drop("copies").columns, (F.col("copies") + F.col("more")).alias("copies"))


def _numbered(counted: DataFrame) -> DataFrame:
    """The rows that were counted (``m``), equal ones with ``row_id`` hashed with their number. Many equal rows are counted out in blocks by many tasks."""
    sizes = counted.withColumn("blocks", F.ceil(F.col("m") / REPEATS))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    many = sizes.filter("blocks > 1").select("*", block).repartition("row_id", "block")
    all_rows = sizes.filter("blocks = 1").withColumn("block", F.lit(0).cast("long")).unionByName(many)
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS), F.col("m") - F.col("block") * REPEATS))).alias("k")
    numbered = all_rows.select("doc_id", "source", "size", "row_id", "block", number)
    return numbered.select("doc_id", "source", "size", F.when((F.col("block") == 0) & (F.col("k") == 1), F.col("row_id")).otherwise(F.xxhash64("row_id", "block", "k")).alias("row_id"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: one row per input row.

    Sizes are counts of words; a null text has none and is taken with none. A null source is a source, last in order. Rows
    are told apart by a hash of doc_id, source and text, and equal rows by a number among them, so each row has a rounding key of its
    own. Copies are 0 to ``COPIES``; which rows get the odd copy depends on those keys alone, so reruns agree. An empty
    table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(doc_id), F.col(source), F.col(text)).alias("row_id"))
    counted = scratch.save(own.groupBy(*own.columns).agg(F.count("*").alias("m")), "counted")  # equal rows meet as counts
    sizes = scratch.save(_numbered(counted), "sizes")
    histogram = scratch.save(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    due = targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    few = histogram.select("source").distinct().count() <= BROADCAST_SOURCES
    state = balance(scratch, histogram, due, few)
    unit = F.pmod(F.xxhash64("row_id", F.lit("round")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rated = _by_source(sizes, state, few)
    rate = F.when(F.col("free"), _rate(F.col("size"))).otherwise(F.lit(float(COPIES)))
    rated = rated.select("doc_id", "source", "size", "row_id", "source_size", "target", rate.alias("rate"))
    start = rated.withColumns({"copies": F.floor("rate").cast("int"), "key": unit - (F.col("rate") - F.floor("rate"))})
    filled = start
    for i in range(FILLS):
        filled = scratch.save(_fill(filled, i == 0, few), f"fill{i}")
        if i:
            scratch.drop(f"fill{i - 1}")
    scratch.keep(f"fill{FILLS - 1}")
    return filled.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken, for every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
