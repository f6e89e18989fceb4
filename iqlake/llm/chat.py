"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, per role, the text before and after a turn and whether the turn's own text is learned. Turn marks and other
control strings inside a text are escaped reversibly. The machine checks the order of the turns (an optional system turn, then
user and assistant in alternation, the assistant optionally calling tools) and marks the turns from the first wrong one on.

Rows of one conversation meet in one task, sorted by turn, and stream through it: a conversation of any length takes the
memory of one Arrow batch. Defined results: null text or role counts as empty; rows with equal turn come in order of role, then
text; repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of common public chat formats.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")


@dataclass(frozen=True)
class Template:
    """``before`` may hold {role}. ``order`` maps a state to the roles that may follow; the state is the last role."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    control: tuple[str, ...] = CONTROL
    learned: frozenset[str] = frozenset({"assistant"})
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    last: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """Backslashes are doubled; a control string gets one after its first character."""
        text = text.replace("\\", "\\\\")
        return re.sub("|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True)), lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as (text, loss) in order."""
        return [(self.before.format(role=self.escape(role).replace("\n", "\\\n")), False), (self.escape(text), role in self.learned), (self.after, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text back from one formatted turn."""
        start, _, tail = self.before.partition("{role}")
        body = formatted[len(start) : len(formatted) - len(self.after)]
        at = re.match(r"(?:[^\\\n]|\\.)*", body, re.DOTALL).end()
        return self.unescape(body[:at]), self.unescape(body[at + len(tail) :])


TURNS = "conv_id long, seq long, valid boolean, segments array<struct<text:string,loss:boolean>>"


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per turn: conv_id, seq (from 0), valid (the order holds up to here) and its segments with loss flags."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, state, valid = object(), 0, "", True
        for b in batches:
            out: list[tuple] = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                role, text = role or "", text or ""
                if c != conv:
                    conv, seq, state, valid = c, 0, "", True
                valid = valid and role in template.order.get(state, ())
                out.append((c, seq, valid, [{"text": t, "loss": x} for t, x in template.segments(role, text)]))
                seq, state = seq + 1, role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), kind), strict=True)], names=["conv_id", "seq", "valid", "segments"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, TURNS)


def digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from what :func:`format_turns` put out, in its order and partitions: counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

        def done() -> tuple:
            return conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars, valid

        conv, n = None, 0
        for b in batches:
            out = []
            for c, ok, segments in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if n == 0 or c != conv:
                    if n:
                        out.append(done())
                    conv, n, chars, loss_chars, turns_hash, loss_hash = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                formatted = "".join(s["text"] for s in segments)
                role, text = template.read(formatted)
                turns_hash.update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = template.unescape(s["text"])
                        loss_chars += len(plain)
                        loss_hash.update(plain.encode())
                n, chars, valid = n + 1, chars + len(formatted), ok
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), types, strict=True)], names=names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
