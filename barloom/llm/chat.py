"""Chat formatting: a finite-state machine over roles and a declarative template.

``ChatTemplate`` names, for each role, the marks around a turn and whether its
text is under the loss.  ``format_turns`` orders the rows of each conversation
by ``(turn, role, text)``, walks the machine and emits one row per segment:
marks and texts apart, each with its own loss flag, and ``valid`` false from the
first turn that the machine doesn't allow.  Control strings inside texts are
broken by an escape character, reversibly; ``read_turns`` parses the formatted
text back.

Rows are streamed: a conversation is never held whole, so one conversation may
hold any share of the table.  Null roles are formatted as the role ``''`` (an
unknown role gets the template's generic mark); null texts are empty; null
turns sort first; repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch, map_batches, table

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role: ``(before, after, under the loss)``; a before-mark must be unique."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    #: Any other role: the name, escaped, stands between the first two marks.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    #: From each state (the last role, "" at the start) the roles that may follow.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def controls(self) -> list[str]:
        return sorted({m for a, b, _ in self.roles.values() for m in (a, b)} | set(self.other))

    def escaper(self) -> re.Pattern:
        """Every place after the first character of a control string, and every escape."""
        return re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls())]))


def escape(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    """The character before each escape stays, the escape goes; a doubled escape is one."""
    return re.sub(r"(?s)(.)\\", r"\1", text)


@dataclass
class Segment:
    text: str
    loss: bool


class Formatter:
    """The machine: state is the last role; feed it turns in order."""

    def __init__(self, template: ChatTemplate):
        self.template, self.pattern = template, template.escaper()
        self.state, self.valid = "", True

    def turn(self, role: str, text: str) -> list[Segment]:
        self.valid = self.valid and role in self.template.follows.get(self.state, ())
        self.state = role
        body = escape(self.pattern, text)
        if role in self.template.roles:
            before, after, loss = self.template.roles[role]
            return [Segment(before, False), Segment(body, loss), Segment(after, False)]
        opened, named, after = self.template.other
        return [Segment(opened + escape(self.pattern, role) + named, False), Segment(body, False), Segment(after, False)]


class Reader:
    """Parses formatted text, fed in parts, back into ``(role, text)`` turns."""

    def __init__(self, template: ChatTemplate):
        self.rest = ""
        self.role = {before: (role, after) for role, (before, after, _) in template.roles.items()}
        self.other = template.other
        self.mark = re.compile("|".join(re.escape(c) for c in sorted(template.controls(), key=len, reverse=True)))

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        at = 0
        while m := self.mark.match(self.rest, at):
            if m[0] == self.other[0]:
                named = self.rest.find(self.other[1], m.end())
                if named < 0:
                    break
                role, after, begin = unescape(self.rest[m.end() : named]), self.other[2], named + len(self.other[1])
            else:
                (role, after), begin = self.role[m[0]], m.end()
            end = self.rest.find(after, begin)
            if end < 0:
                break
            yield role, unescape(self.rest[begin:end])
            at = end + len(after)
        self.rest = self.rest[at:]


def read_turns(template: ChatTemplate, parts: Iterable[str]) -> list[tuple[str, str]]:
    reader = Reader(template)
    return [t for p in parts for t in reader.feed(p)]


SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_NONE = object()


def format_turns(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments in order; the rows of a conversation stay together, in one partition."""
    template = template or ChatTemplate()
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        last, formatter, n = _NONE, None, 0
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                out = ([], [], [], [], [], [])
                for conv, role, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if conv != last:
                        last, formatter, n = conv, Formatter(template), 0
                    for k, s in enumerate(formatter.turn(role, text)):
                        for column, v in zip(out, (conv, n, k, s.text, s.loss, formatter.valid)):
                            column.append(v)
                    n += 1
                yield batch(_SEGMENTS, *out)

    return map_batches(rows, run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def digest_segments(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation, read back from ``format_turns``' output (not reshuffled)."""
    template = template or ChatTemplate()

    def run(batches):
        last, state = _NONE, None
        out = ([], [], [], [], [], [], [])

        def close():
            conv, (_, turns, n, loss, chars, total, valid) = last, state
            for column, v in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid)):
                column.append(v)

        for b in batches:
            for conv, text, loss, valid in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if conv != last:
                    if state is not None:
                        close()
                    last, state = conv, [Reader(template), hashlib.sha256(), 0, hashlib.sha256(), 0, 0, True]
                for role, said in state[0].feed(text):
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                if loss:
                    plain = unescape(text)
                    state[3].update(plain.encode())
                    state[4] += len(plain)
                state[5] += len(text)
                state[6] = state[6] and valid
            if len(out[0]) >= 4096:
                yield batch(_DIGESTS, *out)
                out = ([], [], [], [], [], [], [])
        if state is not None:
            close()
        yield batch(_DIGESTS, *out)

    return map_batches(segments, run, DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest_segments(format_turns(rows.unionByName(probe)))
