"""A1, A5: files of text lines as a data source of Spark's, in batch and as a stream: ``cairn_lines`` and ``cairn_pages``.

A file is read in ranges of bytes, a block of lines at a time; a task takes ranges of some MB, of several files if they are small; a line belongs to the range in which it
begins. A stream's offset is how much of each file has been taken: it has an entry for each file of the folder.
Folders are listed and files opened by ``pyarrow.fs``, by their URI, on the driver and in tasks alike. Names that begin with ``_`` or ``.`` are left out.

- ``cairn_lines``: file, start (the byte at which the line begins), value. A stream takes what is appended to a file, but no line before its end has come.
- ``cairn_pages``: file, start (of the range), mark, line, text: marks of pages and lines since the last mark, from the start of the range. ``read_pages`` makes pages of them.
  With the option ``tally`` a row for each range: file, start, marks, lines (those after its last mark). A stream takes files that are complete when they
  appear (moved in), each in one range, so that its counts are those of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window as W

from cairn.sources.index import PAGE, RUN

#: Bytes of a range; bytes of lines in a batch of rows; bytes read at once; bytes of ranges that a task of a batch read takes one after another;
#: bytes read at once where a line runs on behind its range.
RANGE, BATCH, READ, TASK, AHEAD = 64 << 20, 1 << 20, 1 << 20, 8 << 20, 1 << 14
_MARK = re.compile(PAGE.replace(r"\d", "[0-9]").encode())
_LINES = "file string, start long, value string"
_PAGES = "file string, start long, mark long, line long, text string"
_TALLY = "file string, start long, marks long, lines long"


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end); with ``last`` also an empty one at its end."""

    file: str
    start: int
    end: int
    last: bool = True


class Span(Range):
    """Whole ranges of a file that a task reads one after another."""


@dataclass
class Spans(InputPartition):
    """Several of them, where they are small."""

    parts: list[Span]


def listed(path: str) -> dict[str, int]:
    """Files under a folder, or the file itself, with their sizes, in order of their names. Empty files have no rows and are left out."""
    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    names = {f.path: f.size for f in found if f.type == fs.FileType.File and f.size and not any(p[0] in "_." for p in f.path[len(root) :].split("/") if p)}
    return dict(sorted(names.items()))


def _opened(path: str, file: str) -> pa.NativeFile:
    return fs.FileSystem.from_uri(path)[0].open_input_file(file)


def whole_lines(path: str, file: str, size: int, least: int = 0) -> int:
    """Where the last whole line of a file ends, from the end backwards; ``least`` if none ends after it."""
    with _opened(path, file) as f:
        while size > least:
            at = max(least, size - READ)
            if (cut := f.read_at(size - at, at).rfind(b"\n")) >= 0:
                return at + cut + 1
            size = at
    return least


def lines_of(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """The lines that belong to a range, with the places where they begin; what is read ahead is one block, and little more than the range is read."""
    with _opened(path, part.file) as f:
        size, at, rest = f.size(), part.start, []
        if at:  # a line that begins before the range is another's
            at -= 1
            while block := f.read_at(AHEAD, at):
                if (cut := block.find(b"\n")) >= 0:
                    at += cut + 1
                    break
                at += len(block)
            else:
                return
        begin = at
        while begin < part.end and (block := f.read_at(min(READ, max(part.end - at, AHEAD)), at)):
            at += len(block)
            *whole, tail = block.split(b"\n")
            for piece in whole:
                line = b"".join([*rest, piece])
                rest = []
                if begin >= part.end:
                    return
                yield begin, line
                begin += len(line) + 1
            rest.append(tail)
        if begin < part.end and rest or part.last and begin == size == part.end:
            yield begin, b"".join(rest)


class _Reader:
    """What batch and stream share. ``path`` and ``range_bytes`` are options."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range, self.tally = options["path"], int(options.get("range_bytes", RANGE)), options.get("tally", "false").lower() == "true"

    def ranges(self, file: str, start: int, end: int, last: bool = True) -> list[Range]:
        cuts = [*range(start, end, self.range), end]
        return [Range(file, a, b, last and b == end) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: Range | Spans | None) -> Iterator[pa.RecordBatch]:
        for one in part.parts if isinstance(part, Spans) else [part] if part else []:  # None: there are no ranges
            for own in self.ranges(one.file, one.start, one.end, one.last) if isinstance(one, Span) else [one]:
                yield from self.rows(self.path, own, self.tally)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is text, in batches of bounded size."""
    open_, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*open_), schema)], schema=schema)
    for row in rows:
        open_.append(row)
        size += len(row[-1]) + 32
        if size >= BATCH:
            yield make()
            open_, size = [], 0
    if open_:
        yield make()


class _Lines(_Reader):
    @staticmethod
    def rows(path: str, part: Range, tally: bool) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("value", pa.string())])
        at_end = lambda begin, line: part.last and not line and begin == part.end  # a last line end opens no line
        return _batches(((part.file, begin, line.decode(errors="replace")) for begin, line in lines_of(path, part) if not at_end(begin, line)), schema)


class _Pages(_Reader):
    @staticmethod
    def rows(path: str, part: Range, tally: bool) -> Iterator[pa.RecordBatch]:
        marks = lines = 0

        def found() -> Iterator[tuple]:
            nonlocal marks, lines
            for _, text in lines_of(path, part):
                for i, piece in enumerate(_MARK.split(text)):
                    marks, lines = (marks + 1, 1) if i else (marks, lines + 1)
                    yield part.file, part.start, marks, lines, piece.decode(errors="replace")

        if not tally:
            names = ("file", pa.string()), ("start", pa.int64()), ("mark", pa.int64()), ("line", pa.int64()), ("text", pa.string())
            yield from _batches(found(), pa.schema(names))
            return
        for _ in found():
            pass
        yield pa.RecordBatch.from_arrays([pa.array([part.file]), *(pa.array([x], pa.int64()) for x in (part.start, marks, lines))], names=["file", "start", "marks", "lines"])


class _Batch(DataSourceReader):
    def partitions(self) -> list[Span | Spans]:
        """Ranges by some MB, so that the number of tasks follows the bytes and not the number of ranges or files."""
        step, found, size = self.range * max(1, TASK // self.range), [], 0
        for file, end in listed(self.path).items():
            for a in range(0, end, step):
                b = min(a + step, end)
                if not found or size + b - a > step:
                    found.append([])
                    size = 0
                found[-1].append(Span(file, a, b, b == end))
                size += b - a
        return [parts[0] if len(parts) == 1 else Spans(parts) for parts in found]


class _Stream(DataSourceStreamReader):
    """Offsets are {file: bytes taken}."""

    appended = False

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known = getattr(self, "known", {})
        sizes = listed(self.path)
        if self.appended:  # only files that have grown are looked into
            grown = {f: whole_lines(self.path, f, n, known.get(f, (0, 0))[1]) for f, n in sizes.items() if n != known.get(f, (0, 0))[0]}
            self.known = known | {f: (sizes[f], end) for f, end in grown.items()}
            sizes = {f: end for f, (_, end) in self.known.items() if end}
        else:
            self.known = sizes = known | {f: n for f, n in sizes.items() if f not in known}
        return sizes

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.appended:
            return [r for f, n in sorted(end.items()) if n > start.get(f, 0) for r in self.ranges(f, start.get(f, 0), n, False)]
        return [Range(f, 0, n) for f, n in sorted(end.items()) if f not in start]


class _LinesBatch(_Lines, _Batch):
    pass


class _LinesStream(_Lines, _Stream):
    appended = True


class _PagesBatch(_Pages, _Batch):
    pass


class _PagesStream(_Pages, _Stream):
    pass


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_lines"

    def schema(self) -> str:
        return _LINES

    def reader(self, schema) -> DataSourceReader:
        return _LinesBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LinesStream(self.options)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_pages"

    def schema(self) -> str:
        return _TALLY if self.options.get("tally", "false").lower() == "true" else _PAGES

    def reader(self, schema) -> DataSourceReader:
        return _PagesBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagesStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (LinesSource, PagesSource):
        spark.dataSource.register(source)


def read_pages(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A1: file, page, line_no, text of page-marked files of any size; what stands before the first mark of a file is page 0.

    A first pass counts the marks and lines of each range, a row a range; running sums of these place the lines of the second.
    """
    register(spark)
    source = spark.read.format("cairn_pages").option("path", path).option("range_bytes", range_bytes)
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    sums = source.option("tally", True).load().select(
        "file", "start", "marks", "lines", F.coalesce(F.sum("marks").over(before), F.lit(0)).alias("pages"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("sum")
    )
    marked = F.last(F.when(F.col("marks") > 0, F.col("sum")), ignorenulls=True).over(before)  # lines summed up before the range of the last mark
    placed = sums.select(F.col("file").alias("f"), F.col("start").alias("s"), "pages", (F.col("sum") - F.coalesce(marked, F.lit(0))).alias("since"))
    rows = source.option("tally", False).load().join(placed, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return rows.select("file", (F.col("pages") + F.col("mark")).alias("page"), (F.col("line") + F.when(F.col("mark") == 0, F.col("since")).otherwise(0)).alias("line_no"), "text")


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1 as a stream of files."""
    register(spark)
    return spark.readStream.format("cairn_pages").option("path", path).load().select("file", F.col("mark").alias("page"), F.col("line").alias("line_no"), "text")


def _records(lines: DataFrame) -> DataFrame:
    run = lines.select(F.from_json("value", RUN).alias("run"))
    return run.select("run.tag", F.explode("run.records").alias("r")).select("tag", "r.*")


def read_run_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """A5: one row a record of run logs, a line a run, by the same source that the stream has."""
    register(spark)
    return _records(spark.read.format("cairn_lines").option("path", path).option("range_bytes", range_bytes).load())


def stream_run_lines(spark: SparkSession, path: str) -> DataFrame:
    """A5 as a stream: runs as they are appended to the logs."""
    register(spark)
    return _records(spark.readStream.format("cairn_lines").option("path", path).load())
