"""Stems by column expressions against a plain walk through the published rules."""

import re

from pyspark.sql import functions as F

from cairn.functions import stem
from cairn.functions import text as X

V = set("aeiouáéíóúâêô")


def past(w, at, vowel):
    """The place after the next letter that is a vowel, or is none; None at the end."""
    while at < len(w):
        at += 1
        if (w[at - 1] in V) == vowel:
            return at
    return None


def regions(w):
    p1 = p2 = pv = len(w)
    if (a := past(w, 0, True)) and (a := past(w, a, False)):
        p1 = a
        if (a := past(w, a, True)) and (a := past(w, a, False)):
            p2 = a
    if len(w) >= 2:
        if w[1] not in V:
            pv = past(w, 2, True) or pv
        elif w[0] in V:
            pv = past(w, 2, False) or pv
        elif len(w) >= 3:
            pv = 3
    return p1, p2, pv


def longest(w, suffixes):
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def plain_stem(term):
    w = term.replace("ã", "a~").replace("õ", "o~")
    p1, p2, pv = regions(w)

    def standard():
        s = longest(w, [*stem.PLAIN, *stem.REPLACED, *stem.BEFORE, "amente", "ira", "iras"])
        b = w[: len(w) - len(s)]
        drop = lambda x, t: x[: -len(t)] if t and len(x) - len(t) >= p2 else x
        if not s:
            return None
        if s == "amente":
            if len(b) < p1:
                return None
            t = longest(b, ["iv", *stem.AMENTE])
            shorter = drop(b, t)
            return drop(shorter, longest(shorter, ["at"])) if t == "iv" and shorter != b else shorter
        if s in ("ira", "iras"):
            return b + "ir" if len(b) >= pv and b.endswith("e") else None
        if len(b) < p2:
            return None
        if s in stem.REPLACED:
            return b + stem.REPLACED[s]
        return drop(b, longest(b, stem.BEFORE[s])) if s in stem.BEFORE else b

    out = standard()
    if out is None and (s := longest(w[pv:], stem.VERB)):
        out = w[: -len(s)]
    if out is not None:
        if out.endswith("ci") and len(out) - 1 >= pv:
            out = out[:-1]
    else:
        s = longest(w, stem.RESIDUE)
        out = w[: -len(s)] if s and len(w) - len(s) >= pv else w
    if out.endswith(("e", "é", "ê")):
        if len(out) - 1 >= pv:
            out = out[:-1]
            if out.endswith(("gu", "ci")) and len(out) - 1 >= pv:
                out = out[:-1]
    elif out.endswith("ç"):
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")


# Pairs as the project publishes them, and as its rules give them.
KNOWN = {
    "boa": "boa", "bobagem": "bobag", "bobagens": "bobagens", "quilométricas": "quilométr", "quilombo": "quilomb", "químico": "químic", "negociação": "negoc",
    "constitucionalmente": "constitucional", "administrativamente": "administr", "primeiras": "primeir", "psicologias": "psicolog", "existências": "existent", "consegue": "conseg",
    "dança": "danc", "jornalista": "jornal", "decisivamente": "decis", "solução": "soluçã", "e": "e", "á": "á", "ão": "ão",
}


def test_known_stems(spark):
    df = spark.createDataFrame([(t, 1) for t in KNOWN], "term string, w int")
    got = stem.with_stems(df)
    assert got.columns == ["term", "stem"] and {r.term: r.stem for r in got.collect()} == KNOWN
    assert {t: plain_stem(t) for t in KNOWN} == KNOWN


def test_stems_of_all_terms_and_suffixes(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    terms = d.select(F.explode(X.terms(F.col("text"))).alias("term")).distinct()
    suffixes = [*stem.PLAIN, *stem.REPLACED, *stem.BEFORE, *stem.VERB, *stem.RESIDUE, "amente", "ivamente", "ativamente", "adamente", "abilidade", "eira", "gue", "cie"]
    made = [h + s.replace("a~", "ã").replace("o~", "õ") for h in ("b", "ab", "con", "aeg", "contr", "restaur", "ouvi", "prç", "eci") for s in suffixes]
    made = spark.createDataFrame([(m,) for m in made], "term string")
    got = stem.with_stems(terms.unionByName(made)).collect()
    assert len(got) > 10_000 and all(re.search(".", r.term) for r in got)
    assert [(r.term, r.stem, plain_stem(r.term)) for r in got if r.stem != plain_stem(r.term)] == []
