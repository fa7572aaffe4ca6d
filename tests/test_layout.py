import numpy as np
from pyspark.sql import functions as F

from cairn.operators import ingest as I
from cairn.operators import layout as L

LINE = "doc string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string"
TABLE = "doc string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, headers array<string>, rows array<array<string>>"


def lines(spark, *rows):
    return spark.createDataFrame([("d", 1, i, 50.0, float(y), 100.0, float(y) + 10, t) for i, (y, t) in enumerate(rows)], LINE)


def tables(spark, rows=(("a (3)",),), headers=("h",)):
    return spark.createDataFrame([("d", 1, 0, 40.0, 100.0, 200.0, 200.0, list(headers), [list(r) for r in rows])], TABLE)


def test_overlap_has_closed_bounds(spark):
    own = lines(spark, (89, "above"), (90, "touches"), (150, "inside"), (200, "touches"), (201, "below"))
    assert [r.text for r in L.outside_tables(own, tables(spark)).orderBy("line_no").collect()] == ["above", "below"]


def test_nearest_caption(spark):
    own = lines(spark, (40, "Tabela 1 - Longe"), (60, "Tabela 2 - Perto"), (85, "texto"))
    assert L.captions(own, tables(spark)).first().caption == "Tabela 2 - Perto"
    df = spark.createDataFrame([(None, "Tabela 9 – X", 3), (None, "nada", 4)], "c string, e string, n int")
    assert [r[0] for r in df.select(L.caption_or_default(F.col("c"), F.col("e"), F.col("n"))).collect()] == ["Tabela 9 – X", "Tabela 4"]


def test_footnotes_follow_their_marker_and_their_gap(spark):
    own = lines(spark, (205, "(1) Sem marca"), (220, "(3) Nota"), (235, "que segue"), (300, "longe demais"))
    assert [tuple(r)[3:] for r in L.footnotes(own, tables(spark)).collect()] == [("3", "(3) Nota que segue")]


def test_history_markdown_and_blanked_columns(spark):
    t = tables(spark, (("1.0", "Superada"), ("", "x"), ("2.0",)), ("Versão", "Situação"))
    assert [tuple(r) for r in L.history_rows(t).collect()] == [("d", "1.0", "Superada")]
    t = tables(spark, (("Ana|B", "1\n2"), ("C", None, "cut")), ("Segurado", "Status"))
    assert t.select(L.markdown(F.col("headers"), F.col("rows"))).first()[0] == "| Segurado | Status |\n| --- | --- |\n| Ana\\|B | 1 2 |\n| C |  |"
    assert t.select(L.blanked(F.col("headers"), F.col("rows"))).first()[0] == [["", "1\n2"], ["", None, "cut"]]
    assert t.select(L.header_hit(F.col("headers"))).first()[0]


def test_sections_titles_and_supersession(spark):
    own = lines(spark, (1, "intro"), (2, "1 Objeto"), (3, "a"), (4, "b"), (5, "2 Vazio"))
    made = I.sections(own, F.col("text").rlike(I.HEADING)).orderBy("section_no").collect()
    assert [(r.heading, r.body) for r in made] == [("preâmbulo", "intro"), ("1 Objeto", "a b")]
    docs = spark.createDataFrame([("C", "1", "2024-01-01"), ("C", "2", "2024-02-01"), ("T", "1", "2024-01-01"), ("T", "2", "2024-01-01")], "code string, version string, d string").selectExpr("code", "version", "cast(d as date) effective_date")
    history = spark.createDataFrame([("C", "2", "1", "SUPERADA")], "code string, by_version string, version string, status string")
    got = {(r.code, r.version): (r.superseded, r.reason) for r in I.superseded(docs, history).collect()}
    assert got == {("C", "1"): (True, "superada @ C v2 Histórico"), ("C", "2"): (False, None), ("T", "1"): (False, None), ("T", "2"): (False, None)}


def test_windows_cut_after_the_last_space(spark):
    text = "palavra " * 300
    got = spark.createDataFrame([(text,), ("x" * 2500,), (" ",), (None,)], "t string").select(I.windows(F.col("t")).alias("w")).collect()
    assert all(len(p) <= 1200 and p.endswith("palavra") for p in got[0].w)
    assert [len(p) for p in got[1].w] == [1200, 1200, 400] and got[2].w == [] and not got[3].w


def overlaps(l, t):
    return not (l[5] < t[3] or l[3] > t[5] or l[6] < t[4] or l[4] > t[6])


def test_strips_give_the_rows_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    text = lambda: str(rng.choice(["Tabela 1 - Perto", "texto", "(1) Nota um", "(2) Nota", "segue"]))
    page = lambda: ("d", int(rng.integers(0, 2)))
    ls = []
    for i in range(300):
        x, y = rng.integers(0, 400, 2).astype(float).tolist()
        ls.append((*page(), i, x, y, x + float(rng.integers(0, 80)), y + float(rng.integers(0, 30)), text()))
    ls += [("d", 0, 900, None, 1.0, 2.0, 3.0, "null"), ("d", 5, 901, 0.0, 0.0, 1.0, 1.0, "no table"), ls[0]]
    ts = [(*page(), k, float(x), float(y), float(x + w), float(y + h), ["h"], [["(1)"]]) for k, (x, y, w, h) in enumerate(rng.integers(0, 300, (12, 4)))]
    own, t = spark.createDataFrame(ls, LINE), spark.createDataFrame(ts, TABLE)
    whole = sorted(str(l) for l in ls if l[3] is None or not any(l[:2] == b[:2] and overlaps(l, b) for b in ts))
    for height in (3.0, 50.0, 1000.0):
        assert sorted(str(tuple(r)) for r in L.outside_tables(own, t, height).collect()) == whole
    near = {}
    for b in ts:
        found = [(b[4] - l[6], l[7]) for l in ls if l[:2] == b[:2] and l[7].startswith("Tabela") and -2 <= b[4] - l[6] <= 40]
        if found:
            near[b[:3]] = min(found)[1]
    assert {tuple(r)[:3]: r.caption for r in L.captions(own, t).collect()} == near and near


def test_notes_of_a_page_are_the_notes_below_each_table(spark):
    own = lines(spark, (10, "(1) Antes"), (205, "(1) Nota"), (216, "que segue"), (230, "(2) Sem marca"), (400, "(1) Depois"), (411, "(3) Outra"))
    t = [("d", 1, k, 0.0, y - 5, 10.0, y, ["h"], [["a (1)", "(3) (1)"]]) for k, y in enumerate((5.0, 200.0, 401.0))]
    got = sorted((r.table_no, r.note, r.text) for r in L.footnotes(own, spark.createDataFrame(t, TABLE)).collect())
    texts = [("1", "(1) Antes"), ("1", "(1) Nota que segue"), ("1", "(1) Depois"), ("3", "(3) Outra")]
    assert got == sorted([*((0, *x) for x in texts), *((1, *x) for x in texts[1:]), (2, *texts[3])])


def test_a_page_of_many_lines_and_boxes(spark):
    own = spark.range(100_000).selectExpr("'d' AS doc", "1 AS page", "CAST(id AS INT) AS line_no", "0.0D AS x0", "CAST(12 * id AS DOUBLE) AS y0", "9.0D AS x1", "CAST(12 * id + 10 AS DOUBLE) AS y1", "concat('l', id) AS text")
    t = spark.range(1000).selectExpr("'d' AS doc", "1 AS page", "CAST(id AS INT) AS table_no", "0.0D AS x0", "CAST(1200 * id AS DOUBLE) AS y0", "9.0D AS x1", "CAST(1200 * id + 100 AS DOUBLE) AS y1", "array(array('(1)')) AS rows")
    assert L.outside_tables(own, t).count() == 100_000 - 9 * 1000
