"""Retrieval queries: the benchmark's items are the questions, documents the chunks, ``embeddings`` their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.functions.stem import stem_sql
from cairn.operators import pruned as P
from cairn.operators import retrieval as R
from cairn.operators.phrases import holding
from cairn.operators.probe import probed_split
from cairn.plans import standins as S
from cairn.plans.registry import query
from cairn.sources.index import plant
from cairn.sources.scratch import new_dir

_T = X.TERM
_TOK = rf""", qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '{_T}')) AS term FROM questions) GROUP BY 1, 2),
 tk AS (SELECT id, regexp_extract_all(lower(section || ' ' || text), '{_T}') AS t FROM chunks),
 po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY 1, 2, 3),
 n AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM tk),
 df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
 wt AS (SELECT question_id, qt.term, qtf, ln((greatest(n.n, 1) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS w FROM qt CROSS JOIN n LEFT JOIN df ON df.term = qt.term)"""
_LEX = _TOK + """, lexs AS (SELECT question_id, po.id, round(0.1 * sum(tf) / (0.1 * sum(tf) + 1) * (1 + sum(w)), 9) AS score FROM wt JOIN po ON po.term = wt.term
 JOIN chunks c ON c.id = po.id WHERE NOT c.superseded GROUP BY 1, 2),
 lex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM lexs QUALIFY rank <= 50)"""
_BM = _TOK + """, bms AS (SELECT question_id, id, round(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 9) AS score FROM wt JOIN po ON po.term = wt.term CROSS JOIN n GROUP BY 1, 2)"""
_VEC = """, vecs AS (SELECT q.vec_id AS question_id, c.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS distance
 FROM embeddings q CROSS JOIN embeddings c JOIN chunks k ON k.id = c.vec_id AND NOT k.superseded WHERE q.vec_id IN (SELECT question_id FROM questions)),
 vec AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM vecs QUALIFY rank <= 50)"""
_FUSED = _LEX + _VEC + """, fused AS (SELECT coalesce(l.question_id, v.question_id) AS question_id, coalesce(l.id, v.id) AS id, l.rank AS lex_rank, v.rank AS vec_rank,
 round(coalesce(1.0::DOUBLE / (15 + l.rank), 0) + coalesce(1.0::DOUBLE / (15 + v.rank), 0), 9) AS score FROM lex l FULL JOIN vec v ON v.question_id = l.question_id AND v.id = l.id)"""
_ROLE = "CASE doc_role WHEN 'normative' THEN 1.0 WHEN 'minutes' THEN 0.9 WHEN 'pointer' THEN 0.8 WHEN 'glossary' THEN 0.7 ELSE 1.0 END"
_BOOSTED = _FUSED + f""", hyd AS (SELECT f.question_id, f.id, f.score, row_number() OVER (PARTITION BY f.question_id ORDER BY f.score DESC, f.id) AS rank, c.document_code, c.doc_role
 FROM fused f JOIN chunks c ON c.id = f.id QUALIFY rank <= 50),
 boosted AS (SELECT question_id, id, document_code, doc_role, round(score * {_ROLE}::DOUBLE, 9) AS score FROM hyd)"""
_CAPPED = _BOOSTED + """, cap AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_code ORDER BY score DESC, id) AS ic FROM boosted QUALIFY ic <= 2)"""
_QC = "questions chunks"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Question terms, their weights over all chunks, the index of asked terms, and the lengths of all chunks."""
    qt = R.query_terms(S.questions(spark, sf_dir))
    stored = R.chunk_index(S.chunks(spark, sf_dir), qt, new_dir(spark, "terms"), ("superseded",))
    length = R.lengths(stored)
    return qt, R.term_weights(qt, R.by_term(stored), length.select("n")), stored, length.select("avg_dl")


def _open(c: DataFrame) -> DataFrame:
    return R.eligible(c, c)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, weights, stored, _ = _inputs(spark, sf_dir)
    # statistics cover all chunks; only chunks that may answer are scored
    return R.cover_ranked(weights, _open(stored), R.CANDIDATES)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = S.table(spark, sf_dir, "embeddings")
    asked = e.join(S.questions(spark, sf_dir), F.col("vec_id") == F.col("question_id")).select("question_id", "embedding")
    c = _open(S.chunks(spark, sf_dir)).select("id").join(e, F.col("id") == F.col("vec_id")).select("id", "embedding")
    return c, asked


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vector_rank(*_vectors(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_lexical(spark, sf_dir), _vector(spark, sf_dir))


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = S.chunks(spark, sf_dir).select("id", "document_code", "doc_role")
    return R.role_boost(R.hydrate(_fused(spark, sf_dir).select("question_id", "id", "score"), facts)).drop("rank")


def bm25_ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    _, weights, stored, length = _inputs(spark, sf_dir)
    return R.bm25(weights, stored, length, k)


@query(S.sql(_QC, _TOK + " SELECT po.id, po.dl, po.term, po.tf FROM po SEMI JOIN qt ON qt.term = po.term"))
def c1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(S.chunks(spark, sf_dir), R.query_terms(S.questions(spark, sf_dir))).select("id", F.col("dl").cast("long").alias("dl"), "term", "tf")


_STEM = _TOK[: _TOK.index(" n AS (")] + f""" {stem_sql("st", "(SELECT term FROM po UNION SELECT term FROM qt)")},
 qs AS (SELECT question_id, stem AS term, sum(qtf)::BIGINT AS qtf FROM qt JOIN st ON st.term = qt.term GROUP BY 1, 2),
 ps AS (SELECT id, dl, stem AS term, sum(tf)::BIGINT AS tf FROM po JOIN st ON st.term = po.term GROUP BY 1, 2, 3),
 n AS (SELECT count(*) AS n FROM tk), df AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
 wt AS (SELECT question_id, qs.term, qtf, ln((greatest(n.n, 1) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS w FROM qs CROSS JOIN n LEFT JOIN df ON df.term = qs.term)"""


def _stemmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stems of the questions, the index of these stems, lengths of all chunks."""
    qs = R.query_stems(R.query_terms(S.questions(spark, sf_dir)))
    stored = R.stem_index(S.chunks(spark, sf_dir), qs, new_dir(spark, "stems"), ("superseded",))
    return qs, stored, R.lengths(stored)


@query(S.sql(_QC, _STEM + " SELECT id, dl, ps.term AS stem, tf FROM ps SEMI JOIN qs ON qs.term = ps.term"))
def c1_stemmed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_term(_stemmed(spark, sf_dir)[1]).select("id", F.col("dl").cast("long").alias("dl"), F.col("term").alias("stem"), "tf")


@query(S.sql(_QC, _STEM + """, s AS (SELECT question_id, ps.id, round(0.1 * sum(tf) / (0.1 * sum(tf) + 1) * (1 + sum(w)), 9) AS score FROM wt JOIN ps ON ps.term = wt.term
 JOIN chunks c ON c.id = ps.id WHERE NOT c.superseded GROUP BY 1, 2)
 SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 50"""))
def c7_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs, stored, length = _stemmed(spark, sf_dir)
    weights = R.term_weights(qs, R.by_term(stored), length.select("n"))
    return R.cover_ranked(weights, _open(stored), R.CANDIDATES).withColumn("score", F.round("score", 6))


@query(S.sql(_QC, _TOK + " SELECT question_id, id, count(*) AS n_terms FROM qt JOIN po ON po.term = qt.term GROUP BY 1, 2"))
def c2_or_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    qt, _, stored, _ = _inputs(spark, sf_dir)
    return R.matched(qt, stored).select("question_id", "id", "n_terms")


@query(S.sql(_QC, _TOK + """, need AS (SELECT question_id, count(*) AS n_terms FROM qt GROUP BY 1), h AS (SELECT question_id, id, count(*) AS k FROM qt JOIN po ON po.term = qt.term GROUP BY 1, 2)
 SELECT need.question_id, n_terms, count(*) FILTER (k = n_terms) AS and_matches, count(k) AS or_matches FROM need LEFT JOIN h ON h.question_id = need.question_id GROUP BY 1, 2"""))
def c3_and_or_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    qt, _, stored, _ = _inputs(spark, sf_dir)
    return R.and_or_counts(qt, stored)


@query(S.sql(_QC, _TOK + " SELECT df.term, df.df FROM df SEMI JOIN qt ON qt.term = df.term"))
def c4_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequency(R.by_term(_inputs(spark, sf_dir)[2]))


@query(S.sql(_QC, _TOK + " SELECT question_id, term, qtf, round(w, 6) AS w FROM wt"))
def c5_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir)[1].withColumn("w", F.round("w", 6))


@query(S.sql(_QC, _TOK + " SELECT question_id, id, round(0.1 * sum(tf) / (0.1 * sum(tf) + 1), 6) AS r FROM qt JOIN po ON po.term = qt.term GROUP BY 1, 2"))
def c6_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    qt, _, stored, _ = _inputs(spark, sf_dir)
    return R.matched(qt, stored).select("question_id", "id", F.round(R.cover_density(F.col("hits")), 6).alias("r"))


@query(S.sql(_QC, _LEX + " SELECT question_id, id, rank, round(score, 6) AS score FROM lex"))
def c7_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(S.sql(_QC, _BM + " SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM bms QUALIFY rank <= 5"))
def c8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_ranked(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, weights, stored, length = _inputs(spark, sf_dir)
    return P.bm25(weights, stored, length, 5)


@query(S.sql(_QC, _BM + " SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM bms QUALIFY rank <= 5"))
def c8_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 without the postings that cannot enter the five best."""
    return _pruned(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query()
def c8_pruned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings each question has, and of how many ``c8_pruned`` took candidates."""
    return _pruned(spark, sf_dir)[1]


@query(S.sql(_QC, """ SELECT q.question_id, c.id FROM questions q JOIN chunks c ON NOT c.superseded AND NOT c.contains_pii
 AND (c.product = ['Auto', 'Residencial', 'Empresarial'][(q.question_id % 3 + 1)::INT] OR c.product = 'All')"""))
def c9_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.questions(spark, sf_dir).withColumn("product", S.pick(F.col("question_id"), ("Auto", "Residencial", "Empresarial")))
    return R.eligible(S.chunks(spark, sf_dir), q, pii=False, by_product=True).select("question_id", "id")


@query(S.sql(_QC, _VEC + " SELECT question_id, id, rank, round(distance, 5) AS distance FROM vec"))
def c10_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir).withColumn("distance", F.round("distance", 5))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks, asked = _vectors(spark, sf_dir)
    path, centroids = new_dir(spark, "lists"), P.coarse_centroids(chunks)
    stored, radius = P.vector_lists(chunks, centroids, f"{path}/lists")
    return P.vector_top(stored, centroids, radius, asked, R.CANDIDATES, path)


@query(S.sql(_QC, _VEC + " SELECT question_id, id, rank, round(distance, 5) AS distance FROM vec"))
def c10_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 by lists of vectors, of which those too far away are not read."""
    return _listed(spark, sf_dir)[0].withColumn("distance", F.round("distance", 5))


@query()
def c10_lists_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists of vectors there are for each question, and how many ``c10_lists`` read."""
    return _listed(spark, sf_dir)[1]


@query(S.sql(_QC, _FUSED + " SELECT question_id, id, lex_rank, vec_rank, score FROM fused"))
def c11_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(S.sql(_QC, _BOOSTED + " SELECT h.question_id, h.id, h.rank, h.score, c.document_code, c.section, c.version, c.product FROM hyd h JOIN chunks c ON c.id = h.id"))
def c12_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = S.chunks(spark, sf_dir).select("id", "document_code", "section", "version", "product")
    return R.hydrate(_fused(spark, sf_dir).select("question_id", "id", "score"), facts)


@query(S.sql(_QC, _LEX + " SELECT question_id, id, round(1.0::DOUBLE / (15 + rank), 9) AS score FROM lex"))
def c13_lexical_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arms("lexical", _lexical(spark, sf_dir), None)


@query(S.sql(_QC, _VEC + " SELECT question_id, id, round(1.0::DOUBLE / (15 + rank), 9) AS score FROM vec"))
def c13_vector_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arms("vector", None, _vector(spark, sf_dir))


@query(S.sql(_QC, _FUSED + " SELECT question_id, id, score FROM fused"))
def c13_hybrid_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arms("hybrid", _lexical(spark, sf_dir), _vector(spark, sf_dir))


@query(S.sql(_QC, _BOOSTED + " SELECT question_id, id, document_code, doc_role, score FROM boosted"))
def c14_role_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).select("question_id", "id", "document_code", "doc_role", "score")


@query(S.sql(_QC, _CAPPED + " SELECT question_id, id, document_code, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM cap QUALIFY rank <= 5"))
def c15_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped(_boosted(spark, sf_dir)).select("question_id", "id", "document_code", "score", "rank")


@query(S.sql("chunks", " SELECT id, product FROM chunks WHERE product IN ('Auto', 'All') ORDER BY id LIMIT 20"))
def c16_fixed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fixed_set(S.chunks(spark, sf_dir), "Auto", 20).select("id", "product")


_KEY = "sha256('own' || chr(10) || text)"


_SPLIT = f"""SELECT count(*) FILTER (k IN (SELECT {_KEY} FROM documents WHERE doc_id % 3 = 0)) AS n_hits,
 count(DISTINCT k) FILTER (k NOT IN (SELECT {_KEY} FROM documents WHERE doc_id % 3 = 0)) AS n_misses FROM (SELECT {_KEY} AS k FROM documents)"""


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    key = R.cache_key(F.lit("own"), F.col("text")).alias("key")
    return t, t.filter("id % 3 = 0").select(key, F.array(F.lit(0.0)).alias("vector")).dropDuplicates(["key"])


@query(_SPLIT)
def c17_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, misses = R.cache_split(*_cached(spark, sf_dir), "own")
    return hits.agg(F.count("*").alias("n_hits")).crossJoin(misses.agg(F.count("*").alias("n_misses")))


@query(_SPLIT)
def c17_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17 with filters of keys in front of the joins."""
    hits, misses, _ = probed_split(*_cached(spark, sf_dir), "own")
    return hits.agg(F.count("*").alias("n_hits")).crossJoin(misses.agg(F.count("*").alias("n_misses")))


@query()
def c17_probed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts there are and how many met the cache in ``c17_probed``, and the same of the cache's rows."""
    return probed_split(*_cached(spark, sf_dir), "own")[2]


@query("""SELECT vec_id, len(v)::INT AS dim, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS total
 FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN embedding[1:48] ELSE list_concat(embedding, list_transform(range(32), lambda x: 0.0::FLOAT)) END AS v FROM embeddings)""")
def c19_fit_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "embeddings")
    v = F.when(F.col("vec_id") % 2 == 0, R.fit_dimension(F.col("embedding"), 48)).otherwise(R.fit_dimension(F.col("embedding"), 96))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return e.select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(total, 4).alias("total"))


@query(S.sql(_QC, _CAPPED + """, p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r FROM boosted QUALIFY r <= 50),
 k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r FROM cap QUALIFY r <= 50),
 t AS (SELECT DISTINCT question_id, id FROM chunks CROSS JOIN questions WHERE strpos(lower(chunks.text), lower(questions.question)) > 0)
 SELECT t.question_id, t.id, p.r AS rank_plain, k.r AS rank_capped FROM t LEFT JOIN p ON p.question_id = t.question_id AND p.id = t.id LEFT JOIN k ON k.question_id = t.question_id AND k.id = t.id"""))
def c20_rank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_probe(_boosted(spark, sf_dir), expected(spark, sf_dir).select("question_id", "id"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, id, document_code of the chunks that hold a question's text: one pass over the texts."""
    return holding(S.chunks(spark, sf_dir), S.questions(spark, sf_dir), keep=("document_code",))


_EXPECTED = ", expected AS (SELECT question_id, id, document_code FROM chunks JOIN questions ON strpos(lower(text), lower(question)) > 0)"
_TOP5 = ", top5 AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM bms QUALIFY rank <= 5)"


@query(S.sql(_QC, _BM + _TOP5 + _EXPECTED + """, g AS (SELECT t.question_id, c.document_code AS code, t.id FROM top5 t JOIN chunks c ON c.id = t.id),
 m AS (SELECT e.question_id, count(DISTINCT e.document_code) AS n_expected, count(DISTINCT e.document_code) FILTER (g.code IS NOT NULL) AS n_found
  FROM expected e LEFT JOIN g ON g.question_id = e.question_id AND g.code = e.document_code GROUP BY 1)
 SELECT question_id, n_expected, n_found, n_expected = n_found AS hit FROM m"""))
def h1_recall_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.operators.metrics import recall

    codes = S.chunks(spark, sf_dir).select("id", "document_code")
    return recall(bm25_ranked(spark, sf_dir, 5).join(codes, "id"), expected(spark, sf_dir), "document_code")


@query(S.sql(_QC, _BM + _TOP5 + _EXPECTED + """, m AS (SELECT e.question_id, count(DISTINCT e.id) AS n_expected, count(DISTINCT e.id) FILTER (t.id IS NOT NULL) AS n_found
  FROM expected e LEFT JOIN top5 t ON t.question_id = e.question_id AND t.id = e.id GROUP BY 1) SELECT question_id, n_expected, n_found, n_expected = n_found AS hit FROM m"""))
def h2_recall_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.operators.metrics import recall

    return recall(bm25_ranked(spark, sf_dir, 5), expected(spark, sf_dir), "id")


@query(S.sql(_QC, _BM + " SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM bms QUALIFY rank <= 4"))
def h4_probe_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_ranked(spark, sf_dir, 4).select("question_id", "id", "rank")


_PLANTED = f"WITH {S._SQL['questions']}, chunks AS (SELECT doc_id AS id, 'part ' || doc_id % 7 AS section, text FROM documents UNION ALL SELECT question_id + 1000000000, 'planted', question FROM questions)"


@query(_PLANTED + _BM + " SELECT question_id, id, id = question_id + 1000000000 AS is_planted FROM bms QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) = 1")
def c21_planted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question is planted as a chunk; the best chunk of every question, and whether it is the planted one."""
    c, q = S.chunks(spark, sf_dir).select("id", "section", "text"), S.questions(spark, sf_dir)
    planted = plant(c, q.select((F.col("question_id") + 1_000_000_000).alias("id"), F.lit("planted").alias("section"), F.col("question").alias("text")))
    qt = R.query_terms(q)
    stored = R.chunk_index(planted, qt, new_dir(spark, "planted"))
    length = R.lengths(stored)
    best = R.bm25(R.term_weights(qt, R.by_term(stored), length.select("n")), stored, length.select("avg_dl"), 1)
    return best.select("question_id", "id", (F.col("id") == F.col("question_id") + 1_000_000_000).alias("is_planted"))
