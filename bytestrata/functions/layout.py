"""Fixed-width headers: ``u32 a; bytes[4] b; skip[2]; i8 c``.

Fields follow one another without padding. Signed fields are sign-extended into 64 unsigned bits; bytes and skips take room
but give no field. ``column`` decodes the same integers inside Spark, for whole tables of blobs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"(?:([ui])(8|16|32|64)\s+(\w+)|bytes\[(\d+)\]\s+\w+|skip\[(\d+)\])\Z")


@dataclass(frozen=True)
class Field:
    name: str
    at: int
    width: int
    signed: bool


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...]
    span: int

    def read(self, data: bytes, base: int, endian: str) -> dict[str, int] | None:
        """The fields of the header at base; None if it doesn't fit."""
        if base < 0 or base + self.span > len(data):
            return None
        out = {}
        for f in self.fields:
            at = base + f.at
            out[f.name] = int.from_bytes(data[at : at + f.width], endian, signed=f.signed) & ((1 << 64) - 1)
        return out


def parse(source: str) -> Layout:
    at, fields = 0, []
    for part in _parts(source):
        m = _FIELD.match(part)
        if not m:
            raise ValueError(f"no field: {part!r}")
        if m[1]:
            width = int(m[2]) // 8
            fields.append(Field(m[3], at, width, m[1] == "i"))
        else:
            width = int(m[4] or m[5])
        at += width
    return Layout(tuple(fields), at)


def _parts(source: str) -> Iterator[str]:
    return filter(None, (re.sub(r"\s+", " ", p).strip() for p in source.split(";")))


def column(content: Column, at: int, width: int, endian: str, signed: bool = False) -> Column:
    """PRJ-2, PRJ-3: the integer at a place of a binary column; null past its end. Eight unsigned bytes are a decimal."""
    part = F.substring(content, at + 1, width)
    ordered = F.reverse(part) if endian == "little" else part
    number = F.conv(F.hex(ordered), 16, 10).cast("decimal(20,0)")
    if signed:
        number = F.when(number >= 1 << 8 * width - 1, number - (1 << 8 * width)).otherwise(number).cast("long")
    return F.when(F.octet_length(content) >= at + width, number if width == 8 and not signed else number.cast("long"))
