"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says how a turn begins and ends, which turns may follow which, and
which roles' texts carry loss. Turns become text segments with a loss flag each.
Inside texts and roles every control string is escaped with a backslash (and so
is the backslash), so the formatted text can be read back exactly.

Conversations are sorted within partitions and streamed: a conversation of any
length uses the memory of one batch of turns.

Cases: null text counts as empty, a null role as the empty role. Roles outside
the machine are formatted like any other and make the conversation invalid, as
does a turn out of order. Turns with the same number are ordered by role, then
text; rows that repeat are turns of their own. Null ids form one conversation.
Texts of any length are formatted whole. An empty table gives an empty table.
Other columns, also such with the names of the outputs, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, escapes, allowed order of roles, and roles under loss."""

    begin: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    follows: dict = field(default_factory=lambda: {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    final: frozenset = frozenset({"assistant"})
    loss: frozenset = frozenset({"assistant"})
    control: tuple = ("\\", "###", "</turn>")

    def escape(self, text: str, more: tuple = ()) -> str:
        return re.sub("|".join(map(re.escape, (*self.control, *more))), lambda m: "\\" + m[0], text)

    def unescape(self, text: str, more: tuple = ()) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, (*self.control, *more))) + ")", lambda m: m[1], text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn: (text, loss)."""
        name = self.names.get(role) or "=" + self.escape(role, (":",))
        return [(self.begin + name + self.colon, False), (self.escape(text), role in self.loss), (self.end, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text: (role, text)."""
        token = re.compile(r"\\(?:" + "|".join(map(re.escape, (*self.control, ":"))) + ")|" + "|".join(map(re.escape, (self.end, self.colon))))
        roles = {v: k for k, v in self.names.items()}
        turns, at, name = [], 0, None
        for m in token.finditer(formatted):
            if name is None and m[0] == self.colon:
                name, at = formatted[at + len(self.begin) : m.start()], m.end()
            elif name is not None and m[0] == self.end:
                role = roles[name] if name in roles else self.unescape(name[1:], (":",))
                turns.append((role, self.unescape(formatted[at : m.start()])))
                name, at = None, m.end()
        return turns


DEFAULT = Template()
SEGMENT = "conv_id long, turn_no long, segment int, text string, loss boolean, state string"


def segments(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Rows of ``SEGMENT``: the segments of all turns in order within their partition.

    ``state`` is the machine's state after the turn, or ``error`` from the first turn out of order on.
    """
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = emit
        state, number = "start", 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now:
                    now, state, number = conv, "start", 0
                role = role or ""
                state = role if role in template.follows.get(state, ()) else "error"
                rows += [(conv, number, k, part, loss, state) for k, (part, loss) in enumerate(template.turn(role, text or ""))]
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())], names=names)

    turns = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(emit, SEGMENT)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(parts: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation of ``READ``, from the rows of ``segments`` in their order."""
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False
        done: list[tuple] = []

        def close() -> None:
            if open_:
                done.append((now, n, turns.hexdigest(), lost, loss.hexdigest(), chars, state in template.final))

        for batch in batches:
            for conv, number, segment, text, flag, state_ in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if not open_ or conv != now:
                    close()
                    now, open_, n, lost, chars, buffer = conv, True, 0, 0, 0, []
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    state = "start"
                state = state_ if state != "error" else "error"
                chars += len(text)
                buffer.append(text)
                if flag:
                    plain = template.unescape(text)
                    lost += len(plain)
                    loss.update(plain.encode())
                if text == template.end and segment == 2:
                    for role, body in template.read("".join(buffer)):
                        n += 1
                        turns.update(f"{role}\n{body}\n".encode())
                    buffer = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    return parts.mapInArrow(read, READ)


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own marks, formatted and read back."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    return read_back(segments(chats.unionByName(probe.select("conv_id", "t.turn", "t.role", F.lit(hard).alias("text")))))
