"""Stems of Portuguese words, after the published suffix-stripping rules of the Snowball project.

The rules are tables; they are compiled into SQL expressions over columns that build on each other, in the part of the language
that Spark and other engines share. So stems come from built-in functions, and the same rules give the SQL to compare with. Stems are
meant to be made of distinct terms, not of every word of every text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published rules. A nasal vowel is two letters, of which the second is no vowel.
VOWEL = "aeiouáéíóúâêô"
#: Deleted after the second vowel-consonant pair (region 2).
PLAIN = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos "
    "adora ador aça~o adoras adores aço~es ante antes ância"
).split()
#: Replaced in region 2.
REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
#: Deleted in region 2, and with them one of the endings that may stand before.
BEFORE = {"mente": ("ante", "avel", "ível"), "idade": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"), "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",)}
AMENTE = ("os", "ic", "ad")
VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam "
    "iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas "
    "idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes "
    "estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados "
    "idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos "
    "íssemos imos armos ermos irmos eu iu ou ira iras"
).split()
RESIDUE = ("os", "a", "i", "o", "á", "í", "ó")


def _ending(of: str, suffixes) -> str:
    """The longest of the suffixes that a word ends in, or nothing: the match that starts first."""
    return f"regexp_extract({of}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"


def _less(of: str, n: str) -> str:
    return f"substr({of}, 1, CAST(length({of}) - {n} AS INT))"


def _steps() -> list[tuple[str, str]]:
    """Columns by name, each an expression over those before it; the first is ``term``, the last ``stem``."""
    v, c = f"[{VOWEL}]", f"[^{VOWEL}]"
    region = lambda p: f"CASE WHEN regexp_extract(w, '{p}', 0) = '' THEN length(w) ELSE length(regexp_extract(w, '{p}', 0)) END"
    listed = lambda words: ", ".join(f"'{x}'" for x in words)
    in2 = lambda of, n: f"length({of}) - {n} >= p2"
    steps = [
        ("w", "replace(replace(term, 'ã', 'a~'), 'õ', 'o~')"),
        ("p1", region(f"^{c}*{v}+{c}")),
        ("p2", region(f"^{c}*{v}+{c}+{v}+{c}")),
        ("pv", region(f"^({v}{c}+{v}|{v}{v}+{c}|{c}{c}+{v}|{c}{v}.)")),
        ("s", _ending("w", [*PLAIN, *REPLACED, *BEFORE, "amente", "ira", "iras"])),
        ("b", _less("w", "length(s)")),  # before the suffix
        ("ok2", "length(b) >= p2"),
        ("t", "CASE WHEN s = 'amente' THEN " + _ending("b", ("iv", *AMENTE)) + "".join(f" WHEN s = '{k}' THEN {_ending('b', x)}" for k, x in BEFORE.items()) + " ELSE '' END"),
        ("b2", f"CASE WHEN t <> '' AND {in2('b', 'length(t)')} THEN {_less('b', 'length(t)')} ELSE b END"),
        ("b3", f"CASE WHEN s = 'amente' AND t = 'iv' AND b2 <> b AND {_ending('b2', ['at'])} = 'at' AND {in2('b2', '2')} THEN {_less('b2', '2')} ELSE b2 END"),
        ("one", f"CASE WHEN s IN ({listed(PLAIN)}) AND ok2 THEN b"
         + "".join(f" WHEN s = '{k}' AND ok2 THEN b || '{x}'" for k, x in REPLACED.items())
         + f" WHEN s = 'amente' AND length(b) >= p1 THEN b3 WHEN s IN ({listed(BEFORE)}) AND ok2 THEN b2"
         + f" WHEN s IN ('ira', 'iras') AND length(b) >= pv AND {_ending('b', ['e'])} = 'e' THEN b || 'ir' END"),
        ("sv", _ending("substr(w, CAST(pv + 1 AS INT))", VERB)),
        ("two", f"CASE WHEN one IS NOT NULL THEN one WHEN sv <> '' THEN {_less('w', 'length(sv)')} END"),
        ("three", f"CASE WHEN {_ending('two', ['ci'])} = 'ci' AND length(two) - 1 >= pv THEN {_less('two', '1')} ELSE two END"),
        ("sr", _ending("w", RESIDUE)),
        ("four", f"CASE WHEN three IS NOT NULL THEN three WHEN sr <> '' AND length(w) - length(sr) >= pv THEN {_less('w', 'length(sr)')} ELSE w END"),
        ("e", f"{_ending('four', ['e', 'é', 'ê'])} <> '' AND length(four) - 1 >= pv"),
        ("five", f"CASE WHEN e THEN {_less('four', '1')} WHEN {_ending('four', ['ç'])} = 'ç' THEN {_less('four', '1')} || 'c' ELSE four END"),
        ("six", f"CASE WHEN e AND {_ending('five', ['gu', 'ci'])} <> '' AND length(five) - 1 >= pv THEN {_less('five', '1')} ELSE five END"),
        ("stem", "replace(replace(six, 'a~', 'ã'), 'o~', 'õ')"),
    ]
    return steps


STEPS = _steps()


def with_stems(terms: DataFrame) -> DataFrame:
    """term, stem of the distinct terms (a column ``term``, lower case).

    The last grouping, by the key of the first, costs no shuffle; conditions on the stem stay above it, which would else be
    written out through all steps.
    """
    out = terms.select("term").distinct()
    for name, expression in STEPS:
        out = out.withColumn(f"_{name}" if name != "stem" else name, F.expr(_named(expression)))
    return out.groupBy("term").agg(F.min("stem").alias("stem"))


def _named(expression: str) -> str:
    """The expression over the columns of ``with_stems``, whose names are no one else's."""
    names = "|".join(sorted((n for n, _ in STEPS), key=len, reverse=True))
    return re.sub(rf"'[^']*'|\b({names})\b", lambda m: f"_{m[1]}" if m[1] else m[0], expression)


def stem_sql(name: str, terms: str) -> str:
    """Common table expressions, the last of which is ``name`` with term and stem of ``terms`` (a query with a column ``term``): the same rules."""
    parts, last = [f"{name}_ AS MATERIALIZED (SELECT term FROM {terms})"], f"{name}_"
    for step, expression in STEPS:
        parts.append(f"{name}_{step} AS MATERIALIZED (SELECT *, {expression} AS {step} FROM {last})")
        last = f"{name}_{step}"
    return ", ".join([*parts, f"{name} AS MATERIALIZED (SELECT term, stem FROM {last})"])
