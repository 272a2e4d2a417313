"""Chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio or document. A visitor walks the parts in order. Text is
written escaped; every other part becomes a numbered placeholder, its reference is recorded with the place of the
placeholder, and the tokens that it expands to are counted by the part's own measure. A part of a type that isn't known is
a placeholder ``<part:2>`` with its type and reference recorded, then its text if it has one.

The template is ``<turn:ROLE>CONTENT</turn>`` for each turn, placeholders are ``<image:0>``, ``<audio:1>`` and so on. An
unescaped ``<`` therefore marks a control string, and nothing else does: inside texts and roles a backslash is put before
each ``\\``, ``<`` and ``>``, which is undone by dropping the first of each pair. The loss mask is a list of [start, end)
spans of code points of the formatted string: the escaped text parts of assistant turns.

A conversation is one record, as its formatted string is one value; conversations are grouped by id with their texts
shuffled once. Memory is bounded by the longest conversation and a batch of 64.

Defined results: a null text is empty, a null role is the empty role, rows without a turn number come last, rows with the
same number are ordered by role and text, and repeated rows are turns of their own; rows without conv_id form one
conversation; a null part is no part; an empty table has no conversations; further columns of the input play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: one per image patch of so many pixels, so many per second of sound and per page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256

_ESCAPED = re.compile(r"([\\<>])")
_PLAIN = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"<(?:turn:((?:[^\\<>]|\\.)*)|(/turn)|(image|audio|document|part):(\d+))>", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]] = field(default_factory=list)
    #: (kind, reference, place of the placeholder, tokens it expands to)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)

    @property
    def expanded_tokens(self) -> int:
        return sum(x[3] for x in self.attachments)


def _patches(part: dict) -> int:
    return ceil((part.get("width") or 0) / PATCH) * ceil((part.get("height") or 0) / PATCH)


def _seconds(part: dict) -> int:
    return ceil((part.get("seconds") or 0) * PER_SECOND)


def _pages(part: dict) -> int:
    return (part.get("pages") or 0) * PER_PAGE


class Visitor:
    """Flattens parts into ordered placeholders and text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.made = Formatted("")

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit(self, part: dict, learnt: bool) -> None:
        known = {None: self.visit_text, "text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        known.get(part.get("type"), self.visit_other)(part, learnt)

    def visit_text(self, part: dict, learnt: bool) -> None:
        text = escape(part.get("text") or "")
        if learnt and text:
            self.made.loss.append((self.length, self.length + len(text)))
        self.write(text)

    def _attach(self, part: dict, tokens: int, mark: str | None = None) -> None:
        self.made.attachments.append((part["type"], part.get("ref") or "", self.length, max(1, tokens)))
        self.write(f"<{mark or part['type']}:{len(self.made.attachments) - 1}>")

    def visit_image(self, part: dict, learnt: bool) -> None:
        self._attach(part, _patches(part))

    def visit_audio(self, part: dict, learnt: bool) -> None:
        self._attach(part, _seconds(part))

    def visit_document(self, part: dict, learnt: bool) -> None:
        self._attach(part, _pages(part))

    def visit_other(self, part: dict, learnt: bool) -> None:
        """A type that isn't known: each measure that the part has counts."""
        self._attach(part, max(1, _patches(part)) * max(1, _seconds(part)) + _pages(part), "part")
        self.visit_text(part, learnt)

    def turn(self, role: str, parts: list[dict | None]) -> None:
        self.write(f"<turn:{escape(role)}>")
        for part in parts:
            if part:
                self.visit(part, role == "assistant")
        self.write("</turn>")


def format_turns(turns: list[tuple[str, list[dict | None]]]) -> Formatted:
    visitor = Visitor()
    for role, parts in turns:
        visitor.turn(role, parts)
    visitor.made.text = "".join(visitor.out)
    return visitor.made


def read_back(text: str) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(role, text, [(kind, number)]) of each turn of a formatted string."""
    turns, at, role, content, found = [], 0, "", [], []
    while True:
        lt = _unescaped(text, at)
        if lt < 0:
            return turns
        content.append(unescape(text[at:lt]))
        m = _CONTROL.match(text, lt)
        if not m:
            raise ValueError(f"no control string at {lt}")
        at = m.end()
        if m[2]:
            turns.append((role, "".join(content), found))
        elif m[3]:
            found.append((m[3], int(m[4])))
            continue
        else:
            role = unescape(m[1])
        content, found = [], []


_NEXT = re.compile(r"\\.|<", re.S)


def _unescaped(text: str, at: int) -> int:
    """Where the next ``<`` stands that no backslash escapes."""
    while m := _NEXT.search(text, at):
        if m[0] == "<":
            return m.start()
        at = m.end()
    return -1


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for row in batch.slice(at, 64).to_pylist():
                made = format_turns([(t["role"] or "", t["parts"] or []) for t in row["turns"]])
                rows.append({"conv_id": row["conv_id"], "formatted": made.text, "loss": [{"start": a, "end": b} for a, b in made.loss], "attachments": [dict(zip(("kind", "ref", "place", "tokens"), x, strict=True)) for x in made.attachments], "expanded_tokens": made.expanded_tokens})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_chats(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """Per conversation: conv_id, formatted, loss spans, attachments and expanded_tokens.

    turns: conv_id, turn, role and text, or with parts_col an array of PART structs instead of the text.
    """
    if parts_col:
        parts = F.coalesce(F.col(f"`{parts_col}`"), F.array().cast(f"array<{PART}>")).cast(f"array<{PART}>")
    else:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        null = F.lit(None)
        parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    grouped = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    schema = "conv_id long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,place:long,tokens:long>>, expanded_tokens long"
    return grouped.mapInArrow(_formatted, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for row in batch.slice(at, 64).to_pylist():
                text = row["formatted"]
                turns = read_back(text)
                said = sha256()
                for role, content, _ in turns:
                    said.update(f"{role}\n{content}\n".encode())
                learnt = "".join(unescape(text[x["start"] : x["end"]]) for x in row["loss"])
                rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": said.hexdigest(), "loss_chars": len(learnt), "loss_sha256": sha256(learnt.encode()).hexdigest(), "formatted_chars": len(text), "expanded_tokens": row["expanded_tokens"]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("expanded_tokens", pa.int64())]))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests: no column but formatted, loss and the token count is read."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"
    return formatted.select("conv_id", "formatted", "loss", "expanded_tokens").mapInArrow(_digests, schema)
