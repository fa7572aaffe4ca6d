"""Text functions over columns: keys, metadata, personal data, folding, terms, money, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
DOC_HEADER = r"Código do documento:\s*([A-Z0-9\-]+)\s+Versão:\s*(\S+)\s+Vigência a partir de:\s*(\d{4}-\d{2}-\d{2})"
PRODUCT_PREFIXES = {"CG-AUTO": "Auto", "CG-RES": "Residencial", "CG-EMP": "Empresarial"}
ROLE_PREFIXES = {"FAQ": "pointer", "ATA": "minutes", "GLOS": "glossary"}
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_BR = r"\(\d{2}\)\s*\d{4,5}-?\d{4}"
CPF_FORMATTED = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
CPF_BARE = r"\b\d{11}\b"
PII_HEADER = r"(?i)^(segurado|nome|cpf|telefone|e-?mail)$"
PII_REQUEST = r"\b(nomes?\s+completos?|nomes?\b|cpf|telefones?|e-?mails?|dados\s+pessoais|segurados?\s+citados?|identifica\w*)\b"
STOPWORDS = (
    "para como que com por uma dos das nos nas pelo pela pelos pelas este esta esse essa isso aquele aquela sobre quando "
    "onde qual quais existe quanto quantos quantas deve devem pode podem esta estao estar ser sao tem teem seu sua seus "
    "suas nao sim mais menos muito todo toda todos todas entre desde ate apos antes cada outro outra outros outras mesmo "
    "mesma caso conforme segundo portanto tambem porem contudo entretanto assim entao alem ainda apenas somente "
    "inclusive qualquer ambos posso podemos voce voces"
).split()
TERM = r"[a-zà-ú0-9]{3,}"

#: Letters that lose their mark when folded, and what is left of them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Rows of an Arrow batch of texts at most.
ARROW_ROWS = 500
BLANK = " \t\r\n\x0b\f"


def digit_key(line: Column) -> Column:
    """A line with its outer white space cut and digit runs as ``#``."""
    return F.regexp_replace(F.btrim(line, F.lit(BLANK)), "[0-9]+", "#")


def metadata(text: Column, pattern: str = DOC_HEADER) -> Column:
    """B1: (code, version, effective_date) from a header; null without one."""
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("code"), part(2).alias("version"), F.to_date(part(3)).alias("effective_date")))


def by_prefix(code: Column, prefixes: Mapping[str, str], default: str) -> Column:
    """The value of the first prefix that a code has."""
    return F.coalesce(*(F.when(code.startswith(p), F.lit(v)) for p, v in prefixes.items()), F.lit(default))


def product_for(code: Column) -> Column:
    return by_prefix(code, PRODUCT_PREFIXES, "All")


def role_for(code: Column) -> Column:
    return by_prefix(code, ROLE_PREFIXES, "normative")


def slug(value: Column, most: int = 48) -> Column:
    """Lower-case letters and digits joined by hyphens, at most ``most`` characters, ``chunk`` if none."""
    cut = F.substring(F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)
    return F.when(cut == "", F.lit("chunk")).otherwise(cut)


def cpf_valid(value: Column) -> Column:
    """Eleven digits whose last two are the weighted sums (mod 11) of those before them."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    digit = lambda i: F.substring(digits, i, 1).cast("int")

    def check(n: int) -> Column:
        total = sum((digit(i) * (n + 2 - i) for i in range(1, n + 1)), F.lit(0))
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    return F.when(F.length(digits) == 11, (check(9) == digit(10)) & (check(10) == digit(11))).otherwise(F.lit(False))


def pii_kinds(text: Column, phone: str = PHONE_BR) -> Column:
    """The sorted kinds of personal data in a text: cpf (only with valid digits), email, phone."""
    cpf = F.exists(F.concat(F.regexp_extract_all(text, F.lit(CPF_FORMATTED), 0), F.regexp_extract_all(text, F.lit(CPF_BARE), 0)), cpf_valid)
    return F.array_compact(F.array(F.when(cpf, F.lit("cpf")), F.when(text.rlike(EMAIL), F.lit("email")), F.when(text.rlike(phone), F.lit("phone"))))


def redact(text: Column, phone: str = PHONE_BR) -> Column:
    """E-mails, formatted CPFs, valid bare CPFs and phones, masked in this order."""
    masked = F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), CPF_FORMATTED, "[CPF]")
    bare = F.filter(F.regexp_extract_all(masked, F.lit(CPF_BARE), 0), cpf_valid)
    masked = F.aggregate(F.array_distinct(bare), masked, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"\b"), x, F.lit(r"\b")), F.lit("[CPF]")))
    return F.regexp_replace(masked, phone, "[TELEFONE]")


def fold(text: Column) -> Column:
    """Lower case, marks stripped, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch, so that functions over long texts hold few of them: a setting of the session, lowered where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """E1 for any script: full compatibility decomposition, which column functions do not have, a text at a time in Arrow batches."""

    def fold_one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = re.sub(r"[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text.lower()))
        return re.sub(r"[^a-z0-9]+", " ", plain).strip()

    return texts.map(fold_one)


def content_terms(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The set of folded words of four letters or more, without stop words and numbers."""
    words = F.filter(F.split(fold(text), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*stopwords) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(words)


def terms(text: Column, pattern: str = TERM) -> Column:
    """Plain terms of three characters or more."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), F.array().cast("array<string>"))


def brl(value: Column) -> Column:
    """``R$ 1.234,56``, the sign in front."""
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$ "), F.translate(F.format_number(F.abs(value), 2), ",.", ".,"))


def call_text(query: Column, params: Mapping[str, Column]) -> Column:
    """``claims.query(key="value", ...)``; parameters that are null are left out."""
    parts = [F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in params.items()]
    return F.concat(F.lit("claims."), query, F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def evidence_id(query: Column, params: Mapping[str, Column]) -> Column:
    """Eight hex digits over the sorted JSON of a query and its parameters that are not null."""
    pairs = sorted({**params, "query": query}.items())
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": "'), v.cast("string"), F.lit('"')) for k, v in pairs))
    return F.concat(F.lit("claims:"), query, F.lit(":"), F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 8))


def snippet(text: Column, most: int = 240, phone: str = PHONE_BR) -> Column:
    """Masked first, then white space collapsed, then cut."""
    flat = F.trim(F.regexp_replace(redact(text, phone), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)
