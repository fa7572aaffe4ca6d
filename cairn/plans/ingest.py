"""Ingest queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.operators import ingest as I
from cairn.operators import layout as L
from cairn.plans import standins as S
from cairn.plans.registry import query
from cairn.sources import index
from cairn.sources.scratch import new_dir
from cairn.sources.versioned import Versioned

_TRIM = "trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))"
_KEYED = f", keyed AS (SELECT *, regexp_replace({_TRIM}, '[0-9]+', '#', 'g') AS key FROM lines)"
_BOILER = _KEYED + """, boiler AS (SELECT k.doc, k.key, k.n, p.n_pages FROM
  (SELECT doc, key, count(DISTINCT page) AS n FROM keyed WHERE key <> '' GROUP BY doc, key) k
  JOIN (SELECT doc, count(DISTINCT page) AS n_pages FROM lines GROUP BY doc HAVING count(DISTINCT page) > 1) p ON p.doc = k.doc
  WHERE k.n >= 0.1 * p.n_pages)"""
CODES = ("CG-AUTO-1", "CG-RES-2", "CG-EMP-3", "FAQ-4", "ATA-5", "GLOS-6", "NI-014")


@query(S.sql("lines", "SELECT * FROM lines"))
def a1_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(spark, sf_dir)


@query("SELECT doc_id, regexp_matches(text, '(?i)licen[sc]e') AS has_header FROM documents")
def a2_header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, aside = index.split_by_header(S.table(spark, sf_dir, "documents"), "(?i)licen[sc]e")
    return ok.select("doc_id", F.lit(True).alias("has_header")).unionByName(aside.select("doc_id", F.lit(False).alias("has_header")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def a4_relational_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.read_relational(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


_UPSERT = """SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 = 0 THEN upper(d.lang) ELSE d.lang END AS lang,
 CASE WHEN d.doc_id % 2 = 0 AND d.doc_id % 4 = 0 THEN d.n_chars * 10 ELSE d.n_chars END AS embedding FROM documents d
 UNION ALL SELECT doc_id + 1000000000, upper(lang), CASE WHEN doc_id % 4 = 0 THEN n_chars * 10 END FROM documents WHERE doc_id % 2 = 0"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = S.table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("embedding"))
    even = d.filter("doc_id % 2 = 0")
    row = (F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") * 10).alias("embedding"))
    new = even.select(F.col("doc_id").alias("id"), *row).unionByName(even.select((F.col("doc_id") + 1000000000).alias("id"), *row))
    return old, new


@query(_UPSERT)
def a9_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upsert(*_changes(spark, sf_dir))


@query(_UPSERT)
def a9_versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into a stored table: two versions, of which the second is read."""
    old, new = _changes(spark, sf_dir)
    stored = Versioned.create(spark, new_dir(spark, "versioned"), old.schema)
    stored.plant(old)
    stored.upsert(new)
    return stored.read()


_PLANTED = "SELECT count(*) AS n_start, count(*) + count(*) FILTER (doc_id % 10 = 0) AS n_planted, count(*) AS n_end FROM documents"


@query(_PLANTED)
def a11_versioned_plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows planted into a stored table and removed again; each version can still be read."""
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    new = d.filter("id % 10 = 0").withColumn("id", F.col("id") + 1000000000)
    stored = Versioned.create(spark, new_dir(spark, "versioned"), d.schema)
    versions = (stored.plant(d), stored.plant(new), stored.remove(new.select("id")))
    start, planted, end = (stored.read(v).agg(F.count("*").alias(c)) for v, c in zip(versions, ("n_start", "n_planted", "n_end")))
    return start.crossJoin(planted).crossJoin(end)


@query(_PLANTED)
def a11_plant_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    new = d.filter("id % 10 = 0").withColumn("id", F.col("id") + 1000000000)
    planted = index.plant(d, new)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(d, "n_start").crossJoin(n(planted, "n_planted")).crossJoin(n(index.remove(planted, new.select("id")), "n_end"))


_HEADED = """(SELECT doc_id, 'Código do documento: ' || upper(source) || '-' || lang_up || ' Versão: ' || doc_id % 3 || '.0 Vigência a partir de: 2024-0' || (doc_id % 9 + 1) || '-15 ' || text AS t
 FROM (SELECT *, upper(lang) AS lang_up FROM documents))"""


@query(rf"""SELECT doc_id, regexp_extract(t, '{X.DOC_HEADER}', 1) AS code, regexp_extract(t, '{X.DOC_HEADER}', 2) AS version,
 regexp_extract(t, '{X.DOC_HEADER}', 3)::DATE AS effective_date FROM {_HEADED}""")
def b1_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents")
    head = F.concat(F.lit("Código do documento: "), F.upper("source"), F.lit("-"), F.upper("lang"), F.lit(" Versão: "), F.col("doc_id") % 3, F.lit(".0 Vigência a partir de: 2024-0"), F.col("doc_id") % 9 + 1, F.lit("-15 "), "text")
    return d.select("doc_id", X.metadata(head).alias("m")).select("doc_id", "m.*")


_CODE = f"{list(CODES)}[(doc_id % {len(CODES)} + 1)::INT]"


@query(f"""SELECT doc_id, c AS code, CASE WHEN starts_with(c, 'CG-AUTO') THEN 'Auto' WHEN starts_with(c, 'CG-RES') THEN 'Residencial'
 WHEN starts_with(c, 'CG-EMP') THEN 'Empresarial' ELSE 'All' END AS product,
 CASE WHEN starts_with(c, 'FAQ') THEN 'pointer' WHEN starts_with(c, 'ATA') THEN 'minutes' WHEN starts_with(c, 'GLOS') THEN 'glossary' ELSE 'normative' END AS doc_role
 FROM (SELECT doc_id, {_CODE} AS c FROM documents)""")
def b2_b3_product_and_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = S.pick(F.col("doc_id"), CODES)
    return S.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), X.product_for(code).alias("product"), X.role_for(code).alias("doc_role"))


@query(S.sql("lines", _KEYED + " SELECT key, count(*) AS n FROM keyed GROUP BY key"))
def b4_digit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(spark, sf_dir).groupBy(X.digit_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query(S.sql("lines", _BOILER + " SELECT * FROM boiler"))
def b5_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.boilerplate(S.lines(spark, sf_dir), min_share=0.1)


@query(S.sql("lines", _BOILER + " SELECT k.doc, k.page, k.line_no, k.text FROM keyed k ANTI JOIN boiler b ON b.doc = k.doc AND b.key = k.key"))
def b6_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(spark, sf_dir)
    return I.without_boilerplate(rows, I.boilerplate(rows, min_share=0.1)).select("doc", "page", "line_no", "text")


@query(S.sql("lines", """, often AS (SELECT doc, text FROM lines GROUP BY doc, text
 HAVING count(*) >= 0.1 * (SELECT count(DISTINCT page) FROM lines p WHERE p.doc = lines.doc))
 SELECT l.doc, l.page, l.line_no, l.text FROM lines l ANTI JOIN often o ON o.doc = l.doc AND o.text = l.text"""))
def b7_without_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.without_frequent_lines(S.lines(spark, sf_dir), min_share=0.1).select("doc", "page", "line_no", "text")


@query(S.sql("lines", """, a AS (SELECT *, lag(text) OVER (PARTITION BY doc, page ORDER BY line_no) AS title FROM lines)
 SELECT doc, page, arg_min(title, line_no) AS title FROM a WHERE regexp_matches(text, '(?i)licen[sc]e') AND title IS NOT NULL GROUP BY doc, page"""))
def b8_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.titles(S.lines(spark, sf_dir), "(?i)licen[sc]e", ("doc", "page"))


_SECTIONS = f""", s AS (SELECT *, length(text) <= {S.HEADING_MOST} AS h, sum((length(text) <= {S.HEADING_MOST})::INT) OVER (PARTITION BY doc, page ORDER BY line_no) AS section_no FROM lines),
 sections AS (SELECT doc, page, section_no::BIGINT AS section_no, coalesce(max(text) FILTER (h), 'preâmbulo') AS heading,
 string_agg(text, ' ' ORDER BY line_no) FILTER (NOT h) AS body FROM s GROUP BY doc, page, section_no HAVING count(*) FILTER (NOT h) > 0)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sections(S.lines(spark, sf_dir), F.length("text") <= S.HEADING_MOST, ("doc", "page"))


@query(S.sql("lines", _SECTIONS + " SELECT doc, page, section_no, heading, body FROM sections"))
def b18_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc", "page", "section_no", "heading", "body")


_WINDOWS = _SECTIONS + """, full_ AS (SELECT doc, page, section_no, heading, heading || ' ' || body AS t FROM sections),
 steps AS (SELECT doc, page, section_no, heading, t, 0 AS s,
   CASE WHEN length(t) > 1200 AND strpos(reverse(substr(t, 1, 1200)), ' ') > 0 AND 1200 - strpos(reverse(substr(t, 1, 1200)), ' ') >= 400
        THEN 1200 - strpos(reverse(substr(t, 1, 1200)), ' ') + 1 ELSE least(1200, length(t)) END AS e FROM full_
  UNION ALL
  SELECT doc, page, section_no, heading, t, s2, CASE WHEN s2 + 1200 < length(t) AND strpos(reverse(substr(t, s2 + 1, 1200)), ' ') > 0
        AND 1200 - strpos(reverse(substr(t, s2 + 1, 1200)), ' ') >= 400 THEN s2 + 1200 - strpos(reverse(substr(t, s2 + 1, 1200)), ' ') + 1
        ELSE least(s2 + 1200, length(t)) END
  FROM (SELECT *, greatest(e - 150, s + 1) AS s2 FROM steps WHERE e < length(t))),
 pieces AS (SELECT doc, page, section_no, heading, row_number() OVER (PARTITION BY doc, page, section_no ORDER BY s) AS piece, trim(substr(t, s + 1, e - s)) AS text
  FROM steps WHERE trim(substr(t, s + 1, e - s)) <> '')"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    full = _sections(spark, sf_dir).select("doc", "page", "section_no", "heading", I.windows(F.concat("heading", F.lit(" "), "body")).alias("w"))
    rows = full.select("doc", "page", "section_no", "heading", F.posexplode("w").alias("i", "text"))
    return rows.select("doc", "page", "section_no", "heading", (F.col("i") + 1).cast("long").alias("piece"), "text")


@query(S.sql("lines", _WINDOWS + " SELECT * FROM pieces", recursive=True))
def b19_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


@query(S.sql("lines", _WINDOWS + """, n AS (SELECT *, row_number() OVER (PARTITION BY doc, page, heading ORDER BY section_no, piece) AS k,
 substr(trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) AS slug FROM pieces)
 SELECT doc, page, section_no, piece, doc || '#v' || page || '#' || CASE slug WHEN '' THEN 'chunk' ELSE slug END || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM n""", recursive=True))
def b20_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pieces(spark, sf_dir).withColumns({"code": F.col("doc"), "version": F.col("page")})
    return I.chunk_ids(rows).select("doc", "page", "section_no", "piece", "id")


@query(rf"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '{X.EMAIL}') THEN 'email' END,
 CASE WHEN regexp_matches(text, '{S.PHONE}') THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS kinds FROM documents""")
def b21_pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.pii_kinds(F.col("text"), S.PHONE), ",").alias("kinds"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '{X.EMAIL}', '[EMAIL]', 'g'), '{S.PHONE}', '[TELEFONE]', 'g') AS text FROM documents""")
def b22_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text"), S.PHONE).alias("text"))


def _sql_check(n: int) -> str:
    total = " + ".join(f"d[{i}]::INT * {n + 2 - i}" for i in range(1, n + 1))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


@query(f"""SELECT o_orderkey, d AS digits, {_sql_check(9)} = d[10]::INT AND {_sql_check(10)} = d[11]::INT AS valid
 FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 % 100000000000)::VARCHAR, 11, '0') AS d FROM orders)""")
def b23_cpf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits")).withColumn("valid", X.cpf_valid(F.col("digits")))


@query(rf"""SELECT doc_id AS id, regexp_matches(text, '{X.EMAIL}') OR regexp_matches(text, '{S.PHONE}') OR doc_id % 50 = 0 AS contains_pii,
 (regexp_matches(text, '{X.EMAIL}')::INT + regexp_matches(text, '{S.PHONE}')::INT) AS n_kinds FROM documents""")
def b24_chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 50 == 0).alias("header_hit"))
    return I.flagged(c, S.PHONE).select("id", "contains_pii", F.size("pii_kinds").alias("n_kinds"))


@query(S.sql("chunks", """, docs AS (SELECT DISTINCT document_code AS code, version, effective_date FROM chunks),
 history AS (SELECT DISTINCT document_code AS code, '2' AS by_version, '1' AS version FROM chunks WHERE document_code LIKE '%1'),
 newest AS (SELECT code, arg_max(version, (effective_date, version)) AS v, max(effective_date) AS e FROM docs GROUP BY code)
 SELECT d.code, d.version, d.effective_date, h.version IS NOT NULL OR n.e > d.effective_date AS superseded,
 CASE WHEN h.version IS NOT NULL THEN 'superada @ ' || d.code || ' v' || h.by_version || ' Histórico' WHEN n.e > d.effective_date THEN 'later effective ' || n.v || ' ' || n.e::VARCHAR END AS reason
 FROM docs d LEFT JOIN history h ON h.code = d.code AND h.version = d.version JOIN newest n ON n.code = d.code"""))
def b25_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.chunks(spark, sf_dir).select(F.col("document_code").alias("code"), "version", "effective_date").distinct()
    history = docs.filter("code LIKE '%1'").select("code", F.lit("2").alias("by_version"), F.lit("1").alias("version"), F.lit("Superada").alias("status")).distinct()
    return I.superseded(docs, history)


_REPORT = S.sql("chunks", """SELECT document_code, version, count(*) AS n_chunks, count(*) FILTER (contains_pii) AS n_pii, count(*) FILTER (superseded) AS n_superseded
 FROM chunks GROUP BY GROUPING SETS ((document_code, version), ())""")


@query(_REPORT)
def b26_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.report(S.chunks(spark, sf_dir))


@query(_REPORT)
def b26_written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while the chunks are stored."""
    return I.write_chunks(S.chunks(spark, sf_dir), new_dir(spark, "chunks"))


@query(S.sql("chunks", "SELECT count(*) AS n_chunks, count(DISTINCT (document_code, version)) AS n_versions FROM chunks"))
def b27_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus_stats(S.chunks(spark, sf_dir))


_BOXED = ", boxed AS (SELECT *, 50.0::DOUBLE AS x0, (line_no * 14)::DOUBLE AS y0, (50 + length(text))::DOUBLE AS x1, (line_no * 14 + 12)::DOUBLE AS y1 FROM lines), boxes AS (SELECT DISTINCT page, 40.0 AS x0, (14 * (page % 3 + 2))::DOUBLE AS y0, 400.0 AS x1, (14 * (page % 3 + 3))::DOUBLE AS y1 FROM lines)"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("line_no") * 14
    return S.lines(spark, sf_dir).select("*", F.lit(50.0).alias("x0"), y.cast("double").alias("y0"), (F.length("text") + 50).cast("double").alias("x1"), (y + 12).cast("double").alias("y1"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"))
    y = lambda k: (14 * (F.col("page") % 3 + k)).cast("double")
    return d.select("*", F.lit(0).alias("table_no"), F.lit(40.0).alias("x0"), y(2).alias("y0"), F.lit(400.0).alias("x1"), y(3).alias("y1"), F.array(F.array(F.lit("x (1)"), F.lit("y (2)"))).alias("rows"))


@query(S.sql("lines", _BOXED + " SELECT l.page, l.line_no FROM boxed l ANTI JOIN boxes t ON t.page = l.page AND NOT (l.x1 < t.x0 OR l.x0 > t.x1 OR l.y1 < t.y0 OR l.y0 > t.y1)"))
def b10_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outside_tables(_boxed(spark, sf_dir), _boxes(spark, sf_dir)).select("page", "line_no")


@query(S.sql("lines", _BOXED + """ SELECT l.page, arg_min(text, (t.y0 - l.y1, text)) AS caption FROM boxed l JOIN boxes t ON t.page = l.page
 WHERE t.y0 - l.y1 BETWEEN -2 AND 40 AND regexp_matches(text, '^[A-Z]') GROUP BY l.page"""))
def b11_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.captions(_boxed(spark, sf_dir), _boxes(spark, sf_dir), "^[A-Z]").select("page", "caption")


_NOTED = _BOXED + r""", noted AS (SELECT page, line_no, x0, y0, x1, y1, CASE WHEN line_no % 4 = 0 THEN '(' || (line_no // 4 % 3 + 1)::INT || ') Nota ' || text WHEN line_no % 11 = 0 THEN 'Tabela 1 - ' || text ELSE text END AS text FROM boxed),
 b13 AS (SELECT l.page, l.line_no, l.y0, l.text, regexp_matches(l.text, '^\((\d+)\)\s+[A-ZÀ-Ú].+') AS starts FROM noted l JOIN boxes t ON t.page = l.page AND l.y0 >= t.y1),
 told AS (SELECT *, sum((starts OR regexp_matches(text, '^Tabela\s+\d+\s*[-–—]\s+\S'))::INT) OVER (PARTITION BY page ORDER BY y0, line_no) AS run FROM b13)
 SELECT page, regexp_extract(arg_min(text, line_no), '^\((\d+)\)', 1) AS note, sha256(string_agg(text, ' ' ORDER BY y0, line_no)) AS text_sha256 FROM told GROUP BY page, run
 HAVING arg_min(starts, line_no) AND regexp_extract(arg_min(text, line_no), '^\((\d+)\)', 1) IN ('1', '2')"""


@query(S.sql("lines", _NOTED))
def b13_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line is made a note, some lines captions; notes (1) and (2) are marked in the tables, (3) is not."""
    n, text = F.col("line_no"), F.col("text")
    mark = F.concat(F.lit("("), (F.floor(n / 4) % 3 + 1).cast("string"), F.lit(") Nota "), text)
    noted = _boxed(spark, sf_dir).withColumn("text", F.when(n % 4 == 0, mark).when(n % 11 == 0, F.concat(F.lit("Tabela 1 - "), text)).otherwise(text))
    return L.footnotes(noted, _boxes(spark, sf_dir)).select("page", "note", F.sha2("text", 256).alias("text_sha256"))


_RAW = """(SELECT o_orderkey AS id, ['Linha', ' CPF ', 'Valor'] AS headers, list([l_linenumber::VARCHAR, l_partkey::VARCHAR || '|' || l_suppkey::VARCHAR, l_comment_] ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows
 FROM (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS l_comment_ FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.array(F.col("l_linenumber").cast("string"), F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_suppkey").cast("string")), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")))
    rows = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cell.alias("row")))).alias("r"))
    return rows.select("id", F.array(F.lit("Linha"), F.lit(" CPF "), F.lit("Valor")).alias("headers"), F.transform("r", lambda x: x["row"]).alias("rows"))


@query(f"""SELECT id, '| Linha |  CPF  | Valor |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(r, lambda c: replace(coalesce(c, ''), '|', '\\|')), ' | ') || ' |'), chr(10)) AS text FROM {_RAW}""")
def b16_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", L.markdown(F.col("headers"), F.col("rows")).alias("text"))


@query(f"SELECT id, array_to_string(list_transform(rows, lambda r: r[1] || '/' || '' || '/' || coalesce(r[3], '')), ';') AS cells FROM {_RAW}")
def b17_blank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.blanked(F.col("headers"), F.col("rows"))
    return _raw(spark, sf_dir).select("id", F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "/")), ";").alias("cells"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\((\d+)\)', 1))), ',') AS markers FROM documents")
def b14_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(L.markers(F.array("text"))), ",").alias("markers"))


@query(S.sql("lines", _BOILER + f""" SELECT k.doc, k.page, k.line_no, k.text FROM keyed k ANTI JOIN boiler b ON b.doc = k.doc AND b.key = k.key
 WHERE length(k.text) > {S.HEADING_MOST} AND NOT regexp_matches(k.text, '(?i)licen[sc]e')"""))
def b9_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(spark, sf_dir)
    kept = I.without_boilerplate(rows, I.boilerplate(rows, min_share=0.1)).drop("key")
    return L.prose(kept, rows.filter(F.length("text") <= S.HEADING_MOST), rows.filter(F.col("text").rlike("(?i)licen[sc]e")))


@query("""SELECT o_orderkey AS doc, l_linenumber::VARCHAR AS version, CASE WHEN l_returnflag = 'R' THEN 'Superada' ELSE 'Vigente' END AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber % 3 > 0""")
def b15_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber").cast("string")).otherwise(F.lit(" "))
    row = F.array(F.col("l_linestatus"), version, F.when(F.col("l_returnflag") == "R", "Superada").otherwise("Vigente"))
    t = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(row).alias("rows"))
    return L.history_rows(t.withColumn("headers", F.array(F.lit("Linha"), F.lit("Versão"), F.lit("Situação"))))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Tabela ' || doc_id WHEN doc_id % 3 = 1 THEN 'Tabela 2 - ' || source ELSE 'Tabela ' || doc_id END AS caption FROM documents")
def b12_caption_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Tabela 2 - "), "source"))
    return S.table(spark, sf_dir, "documents").select("doc_id", L.caption_or_default(F.lit(None).cast("string"), external, F.col("doc_id")).alias("caption"))
