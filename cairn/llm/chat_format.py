"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Turns are dealt by conversation and sorted within partitions; both the writer and the reader then stream over a
partition with the state of one conversation at a time, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import table


@dataclass(frozen=True)
class Template:
    """What stands before and after each role's text, which roles are learned, and which role may follow which.

    A role without an entry is written in full between ``other``'s three marks. ``escape`` is put before each control
    string inside a text, and before itself; in reading it makes the next character an ordinary one.
    """

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("<r> ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE] ", " [IS] ", " [/ROLE]")
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    escape: str = "\\"

    def controls(self) -> list[str]:
        marks = {c for pair in [*self.roles.values(), self.other] for m in pair for c in re.findall(r"<[^>]+>|\[[^\]]+\]", m)}
        return sorted(marks, key=lambda c: (-len(c), c))

    def escaping(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, [self.escape, *self.controls()])))

    def segments(self, role: str, text: str, guard: re.Pattern) -> list[tuple[str, bool]]:
        safe = lambda x: guard.sub(lambda m: self.escape + m[0], x)
        if role in self.roles:
            before, after = self.roles[role]
        else:
            before, after = self.other[0] + safe(role) + self.other[1], self.other[2]
        return [(before, False), (safe(text), role in self.learned), (after, False)]


CHAT = Template()


class Reader:
    """Reads turns back from formatted text alone."""

    def __init__(self, template: Template) -> None:
        self.t = template
        self.mark = re.compile("(" + re.escape(template.escape) + ".)|" + "|".join(map(re.escape, template.controls())), re.S)
        self.plain = re.compile(re.escape(template.escape) + "(.)", re.S)

    def _until(self, text: str, at: int, mark: str) -> int:
        """Where ``mark`` starts at or after ``at``, outside escapes."""
        lead = len(mark) - len(mark.lstrip(" "))
        for m in self.mark.finditer(text, at):
            if not m[1] and text.startswith(mark, m.start() - lead):
                return m.start() - lead
        raise ValueError(f"no {mark!r} after {at}")

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            role = next((r for r, (before, _) in self.t.roles.items() if text.startswith(before, at)), None)
            if role is not None:
                at, after = at + len(self.t.roles[role][0]), self.t.roles[role][1]
            else:
                at += len(self.t.other[0])
                end = self._until(text, at, self.t.other[1])
                role, at, after = self.plain.sub(r"\1", text[at:end]), end + len(self.t.other[1]), self.t.other[2]
            end = self._until(text, at, after)
            yield role, self.plain.sub(r"\1", text[at:end])
            at = end + len(after)


def format_chats(turns: DataFrame, template: Template = CHAT, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, position, segments (text, loss), in_order: one row per input row, in order within each conversation.

    Rows of a conversation are ordered by turn, then role and text (nulls first), which settles ties; repeated rows are
    repeated turns. A null role or text is empty. A null conv_id is a conversation. ``in_order`` is false from the first
    turn that the role machine refuses. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard, now, position, state, good = template.escaping(), object(), 0, "", True
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                r, t = r or "", t or ""
                if conv != now:
                    now, position, state, good = conv, 0, "", True
                good = good and r in template.follows.get(state, ())
                for column, value in zip(out, (conv, position, [{"text": s, "loss": loss} for s, loss in template.segments(r, t, guard)], good)):
                    column.append(value)
                position, state = position + 1, r
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("in_order", pa.bool_())])
    own = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, position long, segments array<struct<text:string,loss:boolean>>, in_order boolean")


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of what can be read back from the output of ``format_chats``, one row a conversation.

    It must follow ``format_chats`` directly: rows of a conversation have to be in one partition, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, open_, row = Reader(template), False, []

        def close() -> list:
            return [row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5], row[6] and row[7] in template.ends]

        for batch in batches:
            done = []
            for conv, segments, good in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not open_ or conv != row[0]:
                    if open_:
                        done.append(close())
                    open_, row = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                whole = "".join(s["text"] for s in segments)
                for role, text in reader.turns(whole):
                    row[1] += 1
                    row[2].update(f"{role}\n{text}\n".encode())
                    row[7] = role
                learned = reader.plain.sub(r"\1", "".join(s["text"] for s in segments if s["loss"]))
                row[3] += len(learned)
                row[4].update(learned.encode())
                row[5] += len(whole)
                row[6] = row[6] and good
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [()] * len(schema), schema)], schema=schema)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(close(), schema)], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


#: The conversation that tests escaping: both turns hold control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the extra one, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(turns.unionByName(extra)))


_CONTROL = "|".join(re.escape(c) for c in ["\\", *CHAT.controls()])
_OUTER = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in CHAT.roles.items())
_NEXT = " OR ".join(f"(before = '{a}' AND role IN ({', '.join(repr(b) for b in bs)}))" for a, bs in CHAT.follows.items())
OP4_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(regexp_replace(text, '({_CONTROL})', '_\\1', 'g')) AS safe, length(regexp_replace(role, '({_CONTROL})', '_\\1', 'g')) AS safe_role,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(safe + CASE role {_OUTER} ELSE {sum(map(len, CHAT.other))} + safe_role END)::BIGINT AS formatted_chars,
       bool_and({_NEXT}) AND arg_max(role, turn) = 'assistant' AS valid
FROM f GROUP BY conv_id
"""
