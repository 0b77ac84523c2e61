"""Chat formatting by a finite-state machine and a declarative template.

A template names the markers of a turn, the roles that may follow each other and the roles
whose texts are trained on. Inside texts and roles every character that could begin a
marker, and the escape character, is escaped, so that the output reads back exactly.

Edge cases. Null text or role: empty. Turns are ordered by turn (null first), then role and
text; repeated rows are kept as turns of their own. A conversation whose roles break the
machine's order is formatted all the same, with `valid` false and the number of the first
wrong turn. A null conv_id is a conversation like any other. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    escape: str = "\\"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: frozenset[str] = frozenset({"assistant"})
    #: Roles that may follow a role; "" is the start.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    def __post_init__(self) -> None:
        shown = list(self.names.values())
        if len(set(shown)) < len(shown) or any(not name or name[0] in self.special for name in shown):
            raise ValueError("display names must differ and begin with a character that needs no escape")

    @property
    def special(self) -> str:
        """Characters that are escaped: the first of each marker, and the escape itself."""
        return "".join(dict.fromkeys(self.escape + self.opening[0] + self.after_role[0] + self.closing[0]))

    def hide(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.special)}]", lambda m: self.escape + m[0], text)

    def show(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)

    def write_role(self, role: str) -> str:
        """The display name, or the role itself; one that reads like a display name starts escaped."""
        if role in self.names:
            return self.hide(self.names[role])
        guard = self.escape + role[0] if role in self.names.values() else ""
        return guard + self.hide(role[1:] if guard else role)

    def read_role(self, written: str) -> str:
        roles = {self.hide(name): role for role, name in self.names.items()}
        return roles[written] if written in roles else self.show(written)

    def turn(self) -> re.Pattern:
        plain = f"((?:[^{re.escape(self.special)}]|{re.escape(self.escape)}.)*)"
        return re.compile(
            re.escape(self.opening) + plain + re.escape(self.after_role) + plain + re.escape(self.closing), re.S
        )


DEFAULT = Template()

FORMATTED = "conv_id bigint, n_turns bigint, formatted string, valid boolean, wrong_turn bigint, segments array<struct<start:bigint,length:bigint,loss:boolean>>"


def format_turns(turns: list[tuple[str, str]], template: Template) -> tuple[str, bool, int | None, list[dict]]:
    """Text, validity, first wrong turn and segments with their loss flags."""
    parts, segments, at, state, wrong = [], [], 0, "", None
    for number, (role, text) in enumerate(turns):
        if wrong is None and role not in template.follows.get(state, ()):
            wrong = number
        state = role
        name = template.write_role(role)
        for piece, loss in (
            (template.opening + name + template.after_role, False),
            (template.hide(text), role in template.trained),
            (template.closing, False),
        ):
            parts.append(piece)
            segments.append({"start": at, "length": len(piece), "loss": loss})
            at += len(piece)
    return "".join(parts), wrong is None, wrong, segments


def read_turns(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at, pattern = [], 0, template.turn()
    while at < len(formatted):
        found = pattern.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        out.append((template.read_role(found[1]), template.show(found[2])))
        at = found.end()
    return out


def format_chat(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: its formatted text and its segments.

    A conversation is the unit of output, so its turns meet in one row.
    """
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                text, valid, wrong, segments = format_turns(turns, template)
                rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "formatted": text, "valid": valid, "wrong_turn": wrong, "segments": segments})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return turns.mapInArrow(work, FORMATTED)


_SCHEMA = pa.schema(
    {
        "conv_id": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "valid": pa.bool_(), "wrong_turn": pa.int64(),
        "segments": pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "loss": pa.bool_()})),
    }
)


READ_BACK = "conv_id bigint, n_turns bigint, turns string, loss_text string, formatted_chars bigint, valid boolean"


def read_chat(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Turns and loss text of each conversation, from its formatted text and mask alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns": pa.string(), "loss_text": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()})
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = read_turns(text, template)
                loss = "".join(template.show(text[s["start"] : s["start"] + s["length"]]) for s in row["segments"] if s["loss"])
                rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns": "".join(f"{r}\n{t}\n" for r, t in turns), "loss_text": loss, "formatted_chars": len(text), "valid": row["valid"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return formatted.mapInArrow(work, READ_BACK)
