"""PII [native]: patterns propose spans, validators confirm them, context words adjust the score.

Positions come from the text alone: the pieces between matches (``split``) and the matches (``regexp_extract_all``)
alternate, so running sums of their lengths give code-point offsets. Sums run in blocks and texts are cut by
pattern, so that a text takes time in proportion to its length and its matches. Everything is a projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import table

#: A run may only be entered at its first character or where the last match ended, and runs never give back
#: characters. That leaves the matches as they are and keeps the search linear in the text.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
_LABEL = r"[A-Za-z0-9-]++"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``needs``: text without it has no match. ``score``: before any adjustment.

    ``context``: a pattern of words which, within ``WINDOW`` code points before a match, add ``CONTEXT`` to its score.
    """

    name: str
    pattern: str
    needs: str
    score: float
    context: str
    base: bool = True


WINDOW, CONTEXT, CONFIRMED, ACCEPT = 40, 0.3, 0.3, 0.5
#: Values of a running sum, and code points of a text, that are handled as one block.
BLOCK = 512

KINDS: tuple[Kind, ...] = (
    Kind("email", rf"{_LOCAL}@{_LABEL}(?:\.{_LABEL})++", "@", 0.6, r"(?i)mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)address|host|server|\bip\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.6, r"(?i)card|visa|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"(?i)phone|call|tel|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "", 0.2, r"(?i)iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.2, r"(?i)ssn|social|security", False),
    Kind("secret", r"(?:token|secret|password|api_key) ?[=:] ?\"[^\"\n]{8,}+\"", "\"", 0.6, r"(?i)key|auth", False),
)
_SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an account number: four characters go to the end, letters count as 10 to 35."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(number(c) > 9, 100).otherwise(10) + number(c), F.lit(97))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def valid(kind: str, value: Column) -> Column:
    """Whether the validator of this kind accepts a match: false drops it."""
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(value, r"\."), lambda p: part(p) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return _mod97(value) == 1
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, however often the body's functions look at it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's numbers (0 and up, one at least), the sum or maximum of those before it, in two levels of blocks."""
    scan = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(v, b * BLOCK + 1, BLOCK)))
    starts = lambda blocks: F.slice(scan(F.transform(blocks, lambda a: F.element_at(a, -1))), 1, F.size(blocks))
    moved = lambda a, o: F.transform(F.slice(a, 1, F.size(a) - 1), lambda v: op(v, o))
    return _let(values, lambda v: _let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), moved))))


def _placed(text: Column, found: Column, kind: Kind) -> Column:
    """Start, end and value of each match, from the lengths of pieces and matches; and the ``WINDOW`` code points before it."""
    pieces = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
    all_pairs = F.zip_with(pieces, found, lambda p, v: F.struct(p.alias("p"), v.alias("v"), F.length(p).alias("gap"), (F.length(p) + F.length(v)).alias("len")))
    end = lambda t: F.substring(t, -WINDOW, WINDOW)
    earlier = lambda pairs, i: F.array_join(F.transform(F.slice(pairs, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW))), lambda x: F.concat(x["p"], x["v"])), "")
    before = lambda pairs: F.transform(pairs, lambda x, i: end(F.when(x["gap"] >= WINDOW, x["p"]).otherwise(F.concat(earlier(pairs, i), x["p"]))))
    lengths = lambda pairs: _running(F.transform(pairs, lambda x: x["len"]), lambda a, b: a + b)
    span = lambda x: F.struct((x["at"] + x["x"]["gap"]).alias("start"), (x["at"] + x["x"]["len"]).alias("end"), x["x"]["v"].alias("value"), x["before"].alias("before"))
    return _let(all_pairs, lambda pairs: F.transform(F.arrays_zip(pairs.alias("x"), lengths(pairs).alias("at"), before(pairs).alias("before")), span))


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per input row: doc_id, text and ``findings``, an array of (kind, start, end, value, score, base).

    Offsets are code points, the end exclusive; order is by kind as listed, then start. A null text is empty. Matches
    that a validator rejects are dropped and not tried again. A base kind is kept once valid; the other kinds
    need a score of ``ACCEPT``: their own, plus ``CONFIRMED`` for a checksum, plus ``CONTEXT`` for a nearby word.
    Repeated rows and null ids stay as they are; other columns are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    all_found = lambda k: F.regexp_extract_all("text", F.lit(k.pattern), 0)
    matched = own.select("*", *((F.when(F.contains("text", F.lit(k.needs)), all_found(k)).otherwise(none) if k.needs else all_found(k)).alias(f"m{i}") for i, k in enumerate(kinds)))
    placed = matched.select("doc_id", "text", *(F.when(F.size(f"m{i}") > 0, _placed(F.col("text"), F.col(f"m{i}"), k)).otherwise(F.array().cast(_SPAN)).alias(f"s{i}") for i, k in enumerate(kinds)))

    def scored(i: int, k: Kind) -> Column:
        score = lambda x: F.lit(k.score) + (CONFIRMED if k.name in ("card", "iban") else 0.0) + F.when(x["before"].rlike(k.context), CONTEXT).otherwise(0.0)
        row = lambda x: F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.round(F.least(score(x), F.lit(1.0)), 3).alias("score"), F.lit(k.base).alias("base"))
        kept = F.transform(F.filter(f"s{i}", lambda x: valid(k.name, x["value"])), row)
        return kept if k.base else F.filter(kept, lambda x: x["score"] >= ACCEPT)

    return placed.select("doc_id", "text", F.concat(*(scored(i, k) for i, k in enumerate(kinds))).alias("findings"))


def mask_pii(docs: DataFrame, *, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows with every finding in ``text`` replaced by ``<KIND>``; all columns and their order stay.

    Findings that overlap are merged and take the name of the first. A text without findings, and a null, stay
    as they are. ``n_chars``, where there is such a column, follows the new text.
    """
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    found = find_pii(whole.select("row", F.col(f"row.`{text}`").alias("text")), doc_id="row", kinds=kinds).withColumnRenamed("doc_id", "row")
    spans = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = found.withColumn("spans", spans)
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)
    block = lambda blocks, i: F.coalesce(F.get(blocks, i), F.lit(""))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        inside = F.substring(block(blocks, i), a % BLOCK + 1, b - a)
        across = F.concat(F.substring(block(blocks, i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(block(blocks, j), F.lit(1), b % BLOCK))
        return F.when(i == j, inside).otherwise(across)

    def masked(blocks: Column) -> Column:
        ends = F.transform("spans", lambda x: x["end"])
        part = lambda x, at: F.when(x["start"] >= at, F.concat(between(blocks, at, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
        parts = F.zip_with("spans", _running(ends, lambda a, b: F.greatest(a, b)), part)
        return F.concat(F.array_join(parts, ""), between(blocks, F.array_max(ends), F.length("text")))

    done = found.withColumn("text", F.when(F.size("spans") > 0, _let(cut, masked)).otherwise(F.col(f"row.`{text}`")))
    new = {text: F.col("text")} | ({"n_chars": F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("row.n_chars"))} if "n_chars" in names else {})
    kinds_of = dict(docs.dtypes)
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).cast(kinds_of[c]).alias(c) for c in names))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the base kinds, all spans and their number, for every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("findings", lambda x: x["base"])
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k.name) for k in KINDS if k.base),
        F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", named), ",").alias("spans"), F.size("findings").cast("long").alias("n_spans"),
    )


def _sql_kind(name: str, pattern: str, ok: str) -> str:
    """Spans of one kind in SQL, from the same alternation of pieces and matches."""
    return f"""
SELECT doc_id, text, '{name}' AS kind, v, s, s + length(v) AS e FROM (
  SELECT doc_id, text, m[i] AS v,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, text, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p
    FROM d WHERE regexp_matches(text, '{pattern}')))) WHERE {ok}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j:
  CASE WHEN (length({_DIGITS}) - j) % 2 = 0 THEN {_DIGITS}[j]::INT
       ELSE {_DIGITS}[j]::INT * 2 - CASE WHEN {_DIGITS}[j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_NEAR = "regexp_matches(substr(text, (greatest(s - 40, 0) + 1)::BIGINT, least(s, 40)::BIGINT), '(?i){}')"
_PARTS = [
    _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    _sql_kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right('000' || x, 3)::INT > 255)) = 0"),
    _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    _sql_kind("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "list_reduce(list_transform(string_split(v[5:] || v[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, n: (a * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97) % 97 = 1"),
    _sql_kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _NEAR.format("ssn|social|security")),
    _sql_kind("secret", r'(?:token|secret|password|api_key) ?[=:] ?"[^"\n]{8,}"', "TRUE"),
]
_ORDER = "CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 WHEN 'phone' THEN 4 WHEN 'iban' THEN 5 WHEN 'ssn' THEN 6 ELSE 7 END"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(_PARTS)}),
k AS (SELECT doc_id, kind, s::BIGINT AS s, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x, {_ORDER} AS o FROM f)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(x, ',' ORDER BY o, s) FILTER (o <= 4), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY o, s), '') AS spans, count(x) AS n_spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""
