from pyspark.sql import functions as F

from cairn.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("v")).first()[0]


def test_cpf(spark):
    ok = lambda v: one(spark, X.cpf_valid(F.col("x")), x=v)
    assert ok("111.111.111-11") and ok("52998224725")
    assert not ok("529.982.247-26") and not ok("123") and not ok("12345678901")


def test_kinds_need_valid_digits_but_every_formatted_number_is_masked(spark):
    kinds = lambda v: one(spark, X.pii_kinds(F.col("x")), x=v)
    masked = lambda v: one(spark, X.redact(F.col("x")), x=v)
    assert kinds("cpf 529.982.247-26") == [] and masked("cpf 529.982.247-26") == "cpf [CPF]"
    assert kinds("52998224725, (11) 98765-4321 e a.b@c.com") == ["cpf", "email", "phone"]
    assert masked("52998224725 12345678901 (11) 98765-4321 a.b@c.com") == "[CPF] 12345678901 [TELEFONE] [EMAIL]"


def test_money_slug_fold_and_terms(spark):
    assert one(spark, X.brl(F.col("x")), x=-1234567.5) == "-R$ 1.234.567,50"
    assert one(spark, X.slug(F.col("x")), x="1.2 Franquia — Vidros!") == "1-2-franquia-vidros"
    assert one(spark, X.slug(F.col("x")), x="—") == "chunk"
    assert one(spark, X.fold(F.col("x")), x="  Ação, NÃO: é 10%") == "acao nao e 10"
    assert one(spark, X.fold_any(F.col("x")), x="Ação ﬁm Ș") == "acao fim s"
    assert sorted(one(spark, X.content_terms(F.col("x")), x="Para a ação 12345 limite limite")) == ["acao", "limite"]
    assert one(spark, X.terms(F.col("x")), x=None) == []


def test_metadata_and_prefixes(spark):
    text = "Código do documento: NI-014 Versão: 2.0 Vigência a partir de: 2024-05-01"
    assert tuple(map(str, one(spark, X.metadata(F.col("x")), x=text))) == ("NI-014", "2.0", "2024-05-01")
    assert one(spark, X.metadata(F.col("x")), x="none") is None
    assert one(spark, X.role_for(F.col("x")), x="ATA-1") == "minutes" and one(spark, X.product_for(F.col("x")), x="NI-1") == "All"


def test_snippet_masks_before_it_cuts(spark):
    assert one(spark, X.snippet(F.col("x")), x="x" * 230 + " a.b@c.com " + "y" * 50).endswith("x [EMAIL...")
