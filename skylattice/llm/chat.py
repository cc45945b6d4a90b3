"""Chat formatting: a finite-state machine over roles and a declarative template make loss-flagged segments.

Turns are dealt by conversation, sorted inside each task and streamed: a conversation of any length is
formatted with one turn in memory, so neither it nor its output is ever collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_BYTES, small_batches


@dataclass(frozen=True)
class Template:
    """What is written around each turn, which texts carry loss, and which role may follow which.

    `opens`: marker by role; `other` marks any role not listed, with the role's own name in `{role}`.
    `closes`: the marker after every turn. `moves`: state -> role -> next state; a role with no move
    makes the conversation invalid from there on, yet it is still formatted. `finals`: states a valid
    conversation may end in.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"})
    other: str = "[ROLE {role}]"
    closes: str = "</s>"
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    finals: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        """The strings no text may hold in the output; `[ROLE ` stands for every other-role marker."""
        return [*self.opens.values(), self.other.partition("{role}")[0], self.closes]

    def escape(self, text: str) -> str:
        """A backslash goes after each backslash, and into each control string after its first character."""
        return self._escaping().sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"(?s)(.)\\", r"\1", text) if "\\" in text else text

    def _escaping(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(["\\", *self.controls()], key=len, reverse=True))))

    def marker(self, role: str | None) -> str:
        if role in self.opens:
            return self.opens[role]
        return self.other.replace("{role}", self.escape_role(role))

    def escape_role(self, role: str | None) -> str:
        """Roles go hex-coded into their marker unless plain words; null is `-`."""
        return "-" if role is None else role if re.fullmatch(r"\w+", role) else "=" + role.encode().hex()

    def read_role(self, shown: str) -> str | None:
        return None if shown == "-" else bytes.fromhex(shown[1:]).decode() if shown.startswith("=") else shown


SEGMENT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn_no", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("loss", T.BooleanType(), False),
        T.StructField("state", T.StringType()),
        T.StructField("valid", T.BooleanType(), False),
    ]
)


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about SLICE_BYTES; `size` is the position of the column whose length counts."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += 64 + len(row[size] or "")
        if n >= SLICE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def chat_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Segments of every conversation, in order inside each partition: marker, text, marker of each turn.

    Takes conv_id, turn, role, text; other columns are ignored. Null text is an empty text, a null role
    an unknown role that the machine refuses, a null turn comes first, a null conv_id is a conversation
    of its own. Equal turn numbers follow role, then text. `valid` is false from the first turn the
    machine refuses; the last segment of each conversation, kind `end`, has the verdict on all of it.
    An empty table gives no segment.
    """
    small_batches(turns.sparkSession)
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = turns.select("conv_id", "turn", "role", "text").repartition(n, "conv_id").sortWithinPartitions(*order)
    arrow = to_arrow_schema(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            here, state, no, valid = object(), template.start, 0, True
            for batch in batches:
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if conv != here:
                        if no:
                            yield here, no, "end", "", False, state, valid and state in template.finals
                        here, state, no, valid = conv, template.start, 0, True
                    to = template.moves.get(state, {}).get(role)
                    valid = valid and to is not None
                    state = to if valid else "refused"
                    yield conv, no, "open", template.marker(role), False, state, valid
                    yield conv, no, "text", template.escape(text or ""), role in template.loss, state, valid
                    yield conv, no, "close", template.closes, False, state, valid
                    no += 1
            if no:
                yield here, no, "end", "", False, state, valid and state in template.finals

        yield from batches_of(arrow, rows(), 3)

    return dealt.mapInArrow(run, SEGMENT)


DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("turns_sha256", T.StringType(), False),
        T.StructField("loss_chars", T.LongType(), False),
        T.StructField("loss_sha256", T.StringType(), False),
        T.StructField("formatted_chars", T.LongType(), False),
        T.StructField("valid", T.BooleanType(), False),
    ]
)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Parses the formatted stream of `chat_segments` into turns again and digests it, a row a conversation.

    Roles and turn bounds come from the control strings alone (`parse`), texts by unescaping; the loss
    digest takes what lies under the loss flags. Must be applied to the segments as they come, unshuffled.
    """
    arrow = to_arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            turns, loss, n, loss_chars, chars, shown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
            for batch in batches:
                for conv, kind, text, flag, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "text", "loss", "valid")), strict=True):
                    chars += len(text)
                    if kind == "end":
                        yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid
                        turns, loss, n, loss_chars, chars, shown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
                        continue
                    shown.append(text)
                    if flag:
                        plain = template.unescape(text)
                        loss_chars += len(plain)
                        loss.update(plain.encode())
                    if kind == "close":
                        for role, said in parse("".join(shown), template):
                            turns.update(f"{role or ''}\n{said}\n".encode())
                            n += 1
                        shown = []

        yield from batches_of(arrow, rows(), 2)

    return segments.mapInArrow(run, DIGEST)


def parse(formatted: str, template: Template) -> Iterator[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted string."""
    opens = {m: r for r, m in template.opens.items()}
    head, _, tail = template.other.partition("{role}")
    at = 0
    while at < len(formatted):
        marker = next((m for m in opens if formatted.startswith(m, at)), None)
        if marker is not None:
            role, at = opens[marker], at + len(marker)
        else:
            end = formatted.index(tail, at + len(head))
            role, at = template.read_role(formatted[at + len(head) : end]), end + len(tail)
        end = formatted.index(template.closes, at)
        yield role, template.unescape(formatted[at:end])
        at = end + len(template.closes)
