"""Chat formatting with a grammar round trip.

A turn is written as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break; a conversation
is its turns one after the other.  Control strings of this and of other usual templates inside
a text or role are escaped by a backslash after their first character; one that has n backslashes there gets n + 1, so
that the escape is reversible.  Every turn is first written as it is, reparsed with a deterministic parser and
compared to its source; only where they differ it is escaped, and then must be equal.  Reading back, the whole
rendered conversation is reparsed from its first character on, whatever rows it came in.

The loss mask of a turn is the span of an assistant's text in the written turn.  Turns are written row by row; they
are put together per conversation as a sorted stream, so that no conversation needs to fit in memory.

Defined results: a null text or role is empty; a null turn comes first; rows that tie on the turn are
ordered as written, repeated rows are kept; a null conv_id is a conversation of its own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of usual chat templates.
CONTROLS = [START, END, "<|im_sep|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>"]
CONFLICT = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS))
TURNS = "conv_id long, turn long, written string, loss_start int, loss_end int"


class GrammarError(ValueError):
    """Written text that doesn't follow the grammar or doesn't give back its source."""


class Parser:
    """Reads a whole conversation as it streams by, wherever its pieces are cut; holds no more than one turn."""

    def __init__(self) -> None:
        self.left = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """role and text of the turns that are complete now."""
        self.left += piece
        cut = self.left.rfind(END + "\n") + len(END) + 1
        if cut <= len(END):
            return []
        turns = parse(self.left[:cut])
        self.left = self.left[cut:]
        return [(role, text) for role, text, _, _ in turns]

    def close(self) -> None:
        if self.left:
            raise GrammarError("the conversation ends inside a turn")


def escape(text: str) -> str:
    return CONFLICT.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m.group()[0] + m.group()[2:], text)


def write_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), role)


def parse(written: str) -> list[tuple[str, str, int, int]]:
    """role, text and the span of the text as written, of each turn."""
    turns, at = [], 0
    while at < len(written):
        line = written.find("\n", at)
        end = written.find(END, line + 1)
        if not written.startswith(START, at) or line < 0 or end < 0 or written[end + len(END) : end + len(END) + 1] != "\n":
            raise GrammarError(f"no turn at {at}")
        role, text = written[at + len(START) : line], written[line + 1 : end]
        for part in (role, text):
            if any(c in part for c in CONTROLS):
                raise GrammarError(f"a control string inside the turn at {at}")
        turns.append((read_role(unescape(role)), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def write(role: str, text: str) -> tuple[str, int, int]:
    """The written turn and the span of its text."""
    for change in (str, escape):
        written = f"{START}{change(write_role(role))}\n{change(text)}{END}\n"
        try:
            turns = parse(written)
        except GrammarError:
            continue
        if [(r, t) for r, t, _, _ in turns] == [(role, text)]:
            return written, turns[0][2], turns[0][3]
    raise GrammarError("a turn can't be written")


def write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r.as_py() or "", *write(r.as_py() or "", t.as_py() or "")) for r, t in zip(b.column(2), b.column(3), strict=True)]
        loss = [r[0] == "assistant" for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[i] if keep else None for r, keep in zip(rows, loss, strict=True)], pa.int32()) for i in (2, 3)]], names=["conv_id", "turn", "written", "loss_start", "loss_end"])


def formatted(conversations: DataFrame) -> DataFrame:
    """Every turn as written and its span under the loss mask: conv_id, turn, written, loss_start, loss_end. Map-only."""
    ship(__name__)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(write_rows, TURNS)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as written -> per conversation what the parser finds, hashed as it streams by."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: dict[str, Any] | None = None
    done: list[tuple] = []

    def close() -> None:
        if state is not None:
            state["parser"].close()
            done.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

    for b in batches:
        for conv, _, written, start, end in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if state is None or state["id"] != conv:
                close()
                state = {"id": conv, "parser": Parser(), "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
            for role, text in state["parser"].feed(written):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state["all"] += len(written)
            if start is not None:
                text = unescape(written[start:end])
                state["chars"] += len(text)
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its turns as written."""
    ship(__name__)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "written")
    return ordered.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def assembled(turns: DataFrame) -> DataFrame:
    """conv_id and the whole formatted conversation, for export where conversations fit in memory."""
    return turns.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("turn", "written"))), lambda x: x["written"])).alias("formatted"))
