import json
import random

import pytest

from cairn.sources import index, readers


def pages_of(text):
    """(page, line_no, text) of one file, the plain way."""
    import re

    return [(p, i + 1, line) for p, body in enumerate(re.split(index.PAGE, text)) for i, line in enumerate(body.split("\n"))]


TEXTS = {
    "a.txt": "head\n===== PAGE 1 =====\nx\ny\n===== PAGE 2 =====\nz",
    "b.txt": "===== PAGE 9 =====same line===== PAGE 9 =====\n\n",
    "c.txt": "no mark at all\nä€𝄞\n" * 7,
    "d.txt": "\n",
    "e.txt": "one line",
    "f.txt": "===== PAGE x =====\n==== PAGE 1 =====\n===== PAGE 12 ===== \r\nlast\n",
    "g.txt": "",
}


def written(folder, texts=TEXTS):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return str(folder)


def plain(rows):
    return sorted((r.file.rsplit("/", 1)[1], r.page, r.line_no, r.text) for r in rows)


WANT = sorted((name, *row) for name, text in TEXTS.items() if text for row in pages_of(text))


@pytest.mark.parametrize("size", [5, 33, readers.RANGE])
def test_pages_are_the_same_in_ranges_of_any_size(spark, tmp_path, size):
    path = written(tmp_path / "in")
    assert plain(readers.read_pages(spark, path, size).collect()) == WANT
    assert sorted((r.doc, r.page, r.line_no, r.text) for r in index.read_corpus(spark, path).collect() if r.doc != "g.txt") == WANT


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_every_line_belongs_to_one_range(tmp_path, monkeypatch, block):
    monkeypatch.setattr(readers, "READ", block)
    r = random.Random(block)
    for _ in range(60):
        text = "".join(r.choice("ab\n\n") for _ in range(r.randrange(1, 40)))
        (tmp_path / "t").write_text(text)
        reader = readers._LinesBatch({"path": str(tmp_path / "t"), "range_bytes": str(r.randrange(1, 12))})
        got = [row for part in reader.partitions() for row in readers.lines_of(reader.path, part)]
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        assert got == [(s, line.encode()) for s, line in zip(starts, text.split("\n"))]
        assert readers.whole_lines(str(tmp_path / "t"), str(tmp_path / "t"), len(text)) == text.rfind("\n") + 1


def run_line(i, n=2):
    return json.dumps({"run": i, "tag": f"t{i}", "records": [{"case_id": f"c{i}-{k}", "run": i, "meta": {"latency_ms": k}} for k in range(n)]})


def ids(rows):
    return sorted(r.case_id for r in rows)


def test_runs_of_batch_and_stream_are_the_same_and_appended_lines_come_once(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "x.json").write_text(run_line(0) + "\n" + run_line(1) + "\n" + run_line(2)[:20])
    (src / "_part.json").write_text(run_line(7) + "\n")

    def advance():
        job = readers.stream_run_lines(spark, str(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        job.awaitTermination()
        return ids(spark.read.parquet(out).collect())

    both = [f"c{i}-{k}" for i in (0, 1) for k in (0, 1)]
    assert advance() == both  # the line without an end waits
    assert advance() == both  # a restart takes nothing twice
    with open(src / "x.json", "a") as f:
        f.write(run_line(2)[20:] + "\n")
    (src / "y.json").write_text(run_line(3) + "\n")
    assert advance() == sorted(both + [f"c{i}-{k}" for i in (2, 3) for k in (0, 1)])
    assert ids(readers.read_run_lines(spark, str(src), 50).collect()) == ids(spark.read.parquet(out).collect())


def test_pages_as_a_stream(spark, tmp_path):
    path, out, state = written(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for more in (False, True):
        if more:
            (tmp_path / "in" / "h.txt").write_text("===== PAGE 1 =====\nnew")
        job = readers.stream_pages(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        job.awaitTermination()
    new = [("h.txt", *row) for row in pages_of("===== PAGE 1 =====\nnew")]
    assert plain(spark.read.parquet(out).collect()) == sorted(WANT + new)


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert readers.read_pages(spark, written(tmp_path / "in", {"g.txt": ""})).collect() == []
    assert readers.read_run_lines(spark, str(tmp_path / "in")).collect() == []


def test_tasks_follow_the_bytes_not_the_ranges(tmp_path, monkeypatch):
    path = written(tmp_path / "in", {f"{i}.txt": "===== PAGE 1 =====\n" + "a line of text\n" * 900 for i in range(8)})
    reader = readers._PagesBatch({"path": path, "range_bytes": "1000", "tally": "true"})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(readers, "TASK", 5000)
    assert len(reader.partitions()) == 24  # of 13.5 KB each, in parts of 5 KB
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    opened = readers._opened
    monkeypatch.setattr(readers, "_opened", lambda *a: Counted(opened(*a)))
    monkeypatch.setattr(readers, "AHEAD", 100)
    told = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert len(told) == 8 * 14 and sum(r["marks"] for r in told) == 8 and sum(r["lines"] for r in told) == 8 * 902
    assert sum(read) < 2 * sum(n for n in readers.listed(path).values())
