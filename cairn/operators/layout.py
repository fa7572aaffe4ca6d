"""Tables on pages: overlap, captions, footnotes, markers, history rows, Markdown, blanked columns.

Inputs: ``lines`` (doc, page, line_no, x0, y0, x1, y1, text) and ``tables`` (doc, page, table_no, x0, y0, x1, y1, headers, rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X

# Fixed values that results depend on.
CAPTION = r"^Tabela\s+\d+\s*[-–—]\s+\S"
FOOTNOTE = r"^\((\d+)\)\s+[A-ZÀ-Ú].+"
MARKER = r"\((\d+)\)"
CAPTION_ABOVE, CAPTION_BELOW, NOTE_GAP = 40.0, 2.0, 20.0
#: Height of the strips of a page by which lines and tables meet.
STRIP = 50.0
_KEYS = ["doc", "page"]


def _boxes(tables: DataFrame, *more: str) -> DataFrame:
    return tables.select(*_KEYS, "table_no", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")), *more)


def _cells(low: Column, high: Column, height: float) -> Column:
    """Numbers of the strips of a page that an interval reaches; none if a bound is null or they are the wrong way round."""
    strip = lambda y: F.floor(y / height)
    return F.when(low <= high, F.sequence(strip(low), strip(high)))


def outside_tables(lines: DataFrame, tables: DataFrame, height: float = STRIP) -> DataFrame:
    """Lines that overlap no table of their page; bounds are closed.

    Lines and tables meet by strips of ``height`` of their page, so that a line meets the tables at its own height only.
    """
    box = ["x0", "y0", "x1", "y1"]
    t = _boxes(tables).withColumn("cell", F.explode(_cells(F.col("t_y0"), F.col("t_y1"), height)))
    places = lines.select(*_KEYS, "line_no", *box).distinct().withColumn("cell", F.explode(_cells(F.col("y0"), F.col("y1"), height)))
    apart = (F.col("l.x1") < F.col("t.t_x0")) | (F.col("l.x0") > F.col("t.t_x1")) | (F.col("l.y1") < F.col("t.t_y0")) | (F.col("l.y0") > F.col("t.t_y1"))
    same = [F.col(f"l.{c}") == F.col(f"t.{c}") for c in (*_KEYS, "cell")]
    hit = places.alias("l").join(t.alias("t"), [*same, ~apart], "left_semi").select(*_KEYS, "line_no", *box).distinct()
    return lines.alias("l").join(hit.alias("h"), [F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*_KEYS, "line_no", *box)], "left_anti")


def prose(lines: DataFrame, *dropped: DataFrame) -> DataFrame:
    """Lines that none of the listed tables (doc, page, line_no) names: headers, titles, notes and captions."""
    for d in dropped:
        lines = lines.join(d.select(*_KEYS, "line_no"), [*_KEYS, "line_no"], "left_anti")
    return lines


def captions(lines: DataFrame, tables: DataFrame, pattern: str = CAPTION) -> DataFrame:
    """The nearest matching line above each table: doc, page, table_no, caption.

    Lines and tables meet by strips as high as the range in which a caption may end, of which each table reaches two.
    """
    height = CAPTION_ABOVE + CAPTION_BELOW
    near = _boxes(tables).withColumn("cell", F.explode(_cells(F.col("t_y0") - CAPTION_ABOVE, F.col("t_y0") + CAPTION_BELOW, height)))
    near = near.join(lines.filter(F.col("text").rlike(pattern)).withColumn("cell", F.floor(F.col("y1") / height)), [*_KEYS, "cell"])
    gap = F.col("t_y0") - F.col("y1")
    return near.filter(gap.between(-CAPTION_BELOW, CAPTION_ABOVE)).groupBy(*_KEYS, "table_no").agg(F.min_by("text", F.struct(gap, "text")).alias("caption"))


def caption_or_default(caption: Column, external: Column, n: Column, pattern: str = CAPTION) -> Column:
    """The caption found, else a matching external header, else ``Tabela n``."""
    return F.coalesce(caption, F.when(external.rlike(pattern), external), F.concat(F.lit("Tabela "), n))


def markers(cells: Column) -> Column:
    """Distinct (n) markers of an array of cells, in order."""
    return F.array_distinct(F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MARKER), 1))))


def footnotes(lines: DataFrame, tables: DataFrame, stops: str = CAPTION) -> DataFrame:
    """Doc, page, table_no, note, text: notes below a table whose marker a cell holds.

    A note goes on through the next lines while each is at most NOTE_GAP below the last and matches neither a note's start nor
    ``stops``; anything else ends it. So the notes of a page do not depend on its tables: they are read once, and meet tables by their number.
    """
    order = W.partitionBy(*_KEYS).orderBy("y0", "line_no")
    starts = F.col("text").rlike(FOOTNOTE)
    breaks = ~starts & (F.col("text").rlike(stops) | (F.col("y0") - F.coalesce(F.lag("y1").over(order), F.col("y0")) > NOTE_GAP))
    told = lines.withColumns({"starts": starts, "breaks": breaks}).withColumn("run", F.sum((F.col("starts") | F.col("breaks")).cast("int")).over(order))
    head = told.groupBy(*_KEYS, "run").agg(F.array_sort(F.collect_list(F.struct("y0", "line_no", "text", "starts"))).alias("parts"))
    first = F.col("parts")[0]
    notes = head.filter(first["starts"]).select(*_KEYS, first["y0"].alias("y0"), F.regexp_extract(first["text"], FOOTNOTE, 1).alias("note"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
    marked = _boxes(tables, F.explode(markers(F.flatten("rows"))).alias("note"))
    return marked.join(notes, [*_KEYS, "note"]).filter(F.col("y0") >= F.col("t_y1")).select(*_KEYS, "table_no", "note", "text")


def history_rows(tables: DataFrame) -> DataFrame:
    """Doc, version, status from tables with a ``vers*`` and a ``situa*`` column; short and blank rows are left out."""
    column = lambda prefix: F.array_position(F.transform("headers", lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))).startswith(prefix)), True)
    found = tables.select("doc", "rows", column("vers").alias("v"), column("situa").alias("s")).filter("v > 0 AND s > 0")
    row = found.select("doc", "v", "s", F.explode("rows").alias("row")).filter(F.size("row") >= F.greatest("v", "s"))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at("row", F.col(i).cast("int")), F.lit("")))
    return row.select("doc", cell("v").alias("version"), cell("s").alias("status")).filter("version <> '' AND status <> ''")


def markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table; rows are padded and cut to the headers, bars escaped, line ends taken as spaces."""
    clean = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), r"\|", r"\\|")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(headers)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, lambda r: line(fit(r)))), "\n")


def blanked(headers: Column, rows: Column, pattern: str = X.PII_HEADER) -> Column:
    """Rows with the cells of personal columns emptied."""
    hit = F.transform(headers, lambda h: F.coalesce(F.trim(h).rlike(pattern), F.lit(False)))
    return F.transform(rows, lambda r: F.transform(r, lambda c, i: F.when(F.coalesce(F.get(hit, i), F.lit(False)) & c.isNotNull(), F.lit("")).otherwise(c)))


def header_hit(headers: Column, pattern: str = X.PII_HEADER) -> Column:
    """Whether a personal column was found: it flags the table's chunk."""
    return F.exists(headers, lambda h: F.coalesce(F.trim(h).rlike(pattern), F.lit(False)))
