"""Identification: blobs in, findings out, in one pass over the blobs.

Each task matches all patterns at once, decodes headers, applies rules and validators, resolves overlaps and infers sizes, a
blob at a time; content never crosses the network and isn't part of the result. Findings are ordinary rows for the window
operators and aggregations of this library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validators
from ..sources.catalog import Signature
from .intervals import ENCLOSING, GAP, OWNER

#: MAT-3: smaller blobs have no findings.
LEAST = 4
_TIER_NAMES = {0: "reject", 25: "magic", 60: "structural", 85: "consistent", 99: "verified"}
_TIER_TEXT = {25: "magic bytes matched", 60: "header structure is plausible", 85: "header fields agree with one another", 99: "checksum or full parse verified"}


@dataclass
class Finding:
    offset: int
    size: int
    type: str
    category: str
    confidence: int
    endian: str
    evidence: str = ""
    label: str = ""
    version: str = ""
    compression: str = ""
    coalesce: bool = False
    coalesced: int = 1
    members: list[validators.Member] = field(default_factory=list)
    diagnostics: list[tuple[str, ...]] = field(default_factory=list)  # severity, code, message
    also: list[Finding] = field(default_factory=list)
    signature: Signature | None = None  # what the finding is documented by

    def order(self) -> tuple:
        return (self.offset, -self.confidence, self.size, self.type.encode(), self.endian != "little")


class Matcher:
    """MAT-1, MAT-2: all overlapping matches of all patterns, by their end, longer patterns first."""

    def __init__(self, signatures: list[Signature]):
        from . import embedded, packed  # noqa: F401  add validators, and need this module

        usable = [s for s in signatures if not s.validator or s.validator in validators.KNOWN]
        anchored = [(s, raw, endian) for s in usable if s.short for raw, endian in s.magics]
        #: (place, length) -> bytes -> what has them there: a lookup each instead of a comparison a signature
        self.anchored: dict[tuple[int, int], dict[bytes, list[tuple[int, Signature, str]]]] = {}
        for i, (s, raw, endian) in enumerate(anchored):
            self.anchored.setdefault((s.magic_offset, len(raw)), {}).setdefault(raw, []).append((i, s, endian))
        self.n_anchored = len(anchored)
        self.anywhere = [(s, raw, endian) for s in usable if not s.short for raw, endian in s.magics]
        by_raw: dict[str, list[int]] = {}
        for i, (_, raw, _) in enumerate(self.anywhere):
            by_raw.setdefault(raw.decode("latin-1"), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for raw, ids in by_raw.items():
            self.automaton.add_word(raw, (len(raw), ids))
        if by_raw:
            self.automaton.make_automaton()
        self.empty = not by_raw

    def hits(self, data: bytes) -> list[tuple[int, int, int, Signature, str]]:
        """(end, minus length, place in the set, signature, endian)"""
        found = []
        for (place, size), known in self.anchored.items():  # MAT-4: no scan for what stands at one place
            for i, s, endian in known.get(data[place : place + size], ()):
                found.append((place + size, -size, i, s, endian))
        if not self.empty:
            for last, (size, ids) in self.automaton.iter(data.decode("latin-1")):
                found += [(last + 1, -size, self.n_anchored + i, self.anywhere[i][0], self.anywhere[i][2]) for i in ids]
        return sorted(found, key=lambda h: h[:3])


def candidate(data: bytes, base: int, s: Signature, endian: str) -> Finding | None:
    """PRJ-2, FIL-5 to FIL-8 and the validator: the finding at base, if it is one."""
    if base < 0 or base > len(data):
        return None
    avail = len(data) - base
    fields = s.layout.read(data, base, endian) if s.layout else {}
    if fields is None:
        return None
    fields |= {"_avail": avail, "_offset": base}
    if not all(rule(fields) for rule in s.constraints):
        return None
    f = Finding(base, 0, s.name, s.category, s.tier, endian, _TIER_TEXT[s.tier] if s.tier else "", coalesce=s.coalesce, signature=s)
    if not all(rule(fields) for rule in s.soft):
        return replace(f, confidence=25, evidence=s.soft_evidence)
    if s.size:
        f.size = s.size(fields)
        if f.size > avail:
            if not s.size_clamp:
                return None
            f.size = avail
    if s.validator:
        if not validators.KNOWN[s.validator](data, f, fields):
            return None
        if f.confidence != s.tier:
            f.evidence = _TIER_TEXT.get(f.confidence, f.evidence)
    return f


def scan(data: bytes, matcher: Matcher) -> list[Finding]:
    """MAT-5, MAT-6: candidates, skipping what a sure finding with a size already covers.

    Matches inside a sure finding aren't looked at, but for those from a partition's start on. A hit that ends no later
    than one already taken never stops the scan.
    """
    if len(data) < LEAST:
        return []
    found, until, starts = [], 0, []
    for end, less, _, s, endian in matcher.hits(data):
        begin = end + less
        if begin < until and not any(x <= begin and x == begin - s.magic_offset for x in starts):
            continue
        f = candidate(data, begin - s.magic_offset, s, endian)
        if not f:
            continue
        found.append(f)
        if f.members and f.type in ("gpt", "mbr", "esp32_partition_table"):
            starts += [m.offset for m in f.members]
        if f.confidence >= OWNER and f.size > 0:
            stop = f.offset + f.size
            ahead = [x for x in starts if x > f.offset]
            until = max(until, min([stop, *ahead]) if ahead else stop)
    return found


def resolve(found: list[Finding], length: int) -> list[Finding]:
    """INT-1 to INT-6.

    A finding without a size of its own still owns its decoded header, from the magic on, against what only a magic speaks for.
    """
    starts = {m.offset for f in found for m in f.members if f.type in ("gpt", "mbr", "esp32_partition_table")}
    kept: list[Finding] = []
    owner, end = None, -1
    headed, header = None, range(0)
    for f in sorted(found, key=Finding.order):
        if kept and kept[-1].offset == f.offset:
            kept[-1].also.append(replace(f, also=[]))
        elif owner and f.offset < end and f.offset not in starts:
            owner.also.append(replace(f, also=[]))
        elif headed and f.confidence < OWNER and f.offset in header and f.offset not in starts:
            headed.also.append(replace(f, also=[]))
        else:
            kept.append(f)
            if f.confidence >= OWNER and f.size > 0:
                owner, end = f, f.offset + f.size
            elif f.confidence >= OWNER and f.signature and f.signature.layout:
                headed, header = f, range(f.offset + f.signature.magic_offset, f.offset + f.signature.layout.span)
    for f, following in zip(kept, [*kept[1:], None]):
        if not f.size:
            f.size = (following.offset if following else length) - f.offset
    out: list[Finding] = []
    open_, reach = None, 0
    for f in kept:
        if f.coalesce and open_ and f.offset <= reach + GAP:
            reach = max(reach, f.offset + f.size)
            open_.size, open_.coalesced = reach - open_.offset, open_.coalesced + 1
            open_.evidence = f"{open_.coalesced} flash regions coalesced"
            open_.diagnostics += [d for d in f.diagnostics if d not in open_.diagnostics]
            continue
        out.append(f)
        if f.coalesce:
            open_, reach = f, f.offset + f.size
    return out


def suppress(found: list[Finding]) -> list[Finding]:
    """JOI-2 within one blob: what lies, as a proper part, inside a sized container goes; two running maxima."""
    out: list[Finding] = []
    earlier = -1  # how far containers that begin before this offset reach
    for _, group in groupby(found, key=lambda f: f.offset):
        here = list(group)
        ends = [f.offset + f.size for f in here if f.category in ENCLOSING and f.size > 0]
        beside = max(ends, default=-1)
        for f in here:
            end = f.offset + max(f.size, 1)
            if earlier < end and beside <= end:
                out.append(f)
        earlier = max(earlier, beside)
    return out


def enrich(data: bytes, found: list[Finding]) -> list[Finding]:
    """INT-9, JOI-4, JOI-5: one finding for each UBI image, with its volumes as members.

    Keys and certificates inside belong to the volume whose block holds them; those in free blocks stay findings, which
    the suppression of what lies inside containers then drops. All else inside is what the volumes hold, and goes. Of several images that overlap the first counts.
    """
    from . import flash  # it registers extractors, which need this module

    images: list[flash.Image] = []
    for f in found:
        if f.type == "ubi" and not any(x.start <= f.offset < x.end for x in images):
            try:
                image = flash.parse(data, f.offset)
            except (flash.Stop, struct.error, IndexError, ValueError):
                continue
            if image.names:
                images.append(image)
    if not images:
        return found
    boxes, volumes, out = [], [], []
    for x in images:
        n = len(x.names)
        box = Finding(x.start, x.end - x.start, "ubi", "filesystem", 99, "big", f"volume table with {n} volume{'s' * (n != 1)}")
        members = {k: validators.Member(name, None, x.room(k), x.note(data, k)) for k, name in sorted(x.names.items())}
        box.members = list(members.values())
        boxes.append(box)
        volumes.append(members)
    for f in found:
        k = next((k for k, x in enumerate(images) if x.start <= f.offset < x.end), None)
        if k is None:
            out.append(f)
        elif f.category == "crypto":
            member = volumes[k].get(images[k].volume_of(f.offset))
            (member.children if member else out).append(f)
    return sorted([*out, *boxes], key=lambda f: f.offset)


_SCHEMA = pa.schema([
    ("blob_id", pa.int64()), ("offset_", pa.int64()), ("size_", pa.int64()), ("type_", pa.string()), ("category", pa.string()), ("confidence", pa.int32()), ("tier", pa.string()), ("evidence", pa.string()), ("endian", pa.string()),
    ("version", pa.string()), ("label", pa.string()), ("compression", pa.string()), ("description", pa.string()), ("vendor", pa.string()), ("references", pa.list_(pa.struct([("title", pa.string()), ("url", pa.string())]))), ("limitations", pa.list_(pa.string())),
    ("coalesced_count", pa.int32()), ("members", pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("note", pa.string()), ("children", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("type", pa.string()), ("category", pa.string()), ("confidence", pa.int32())])))]))),
    ("diagnostics", pa.list_(pa.struct([("severity", pa.string()), ("code", pa.string()), ("message", pa.string())]))), ("also_matched", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("type", pa.string()), ("confidence", pa.int32())]))),
])
SCHEMA = (
    "blob_id long, offset_ long, size_ long, type_ string, category string, confidence int, tier string, evidence string, endian string, version string, label string, compression string, "
    "description string, vendor string, references array<struct<title:string,url:string>>, limitations array<string>, coalesced_count int, "
    "members array<struct<name:string,offset:long,size:long,note:string,children:array<struct<offset:long,size:long,type:string,category:string,confidence:int>>>>, "
    "diagnostics array<struct<severity:string,code:string,message:string>>, also_matched array<struct<offset:long,size:long,type:string,confidence:int>>"
)


def _place(f: Finding) -> dict:
    return {"offset": f.offset, "size": f.size, "type": f.type, "category": f.category, "confidence": f.confidence}


def _row(blob: int, f: Finding) -> tuple:
    """A finding in the order of the schema."""
    s = f.signature
    return (
        blob, f.offset, f.size, f.type, f.category, f.confidence, _TIER_NAMES[f.confidence], f.evidence, f.endian, f.version, f.label, f.compression,
        s.description if s else "", s.vendor if s else "", [{"title": a, "url": b} for a, b in s.references] if s else [], s.limitations if s else [], f.coalesced,
        [{"name": m.name, "offset": m.offset, "size": m.size, "note": m.note, "children": [_place(c) for c in m.children]} for m in f.members],
        [{"severity": d[0], "code": d[1], "message": d[2] if len(d) > 2 else ""} for d in f.diagnostics], [_place(g) for g in f.also],
    )


def findings(data: bytes, matcher: Matcher, all_: bool = False) -> list[Finding]:
    """A blob's findings; with all_, also those inside others."""
    found = resolve(scan(data, matcher), len(data))
    return found if all_ else suppress(enrich(data, found))


def _rows(batches: Iterator[pa.RecordBatch], matcher: Matcher, all_: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(blob, f) for blob, content in zip(batch.column("blob_id").to_pylist(), batch.column("content"), strict=True) for f in findings(content.as_py() or b"", matcher, all_)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, field_.type) for c, field_ in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def identify(blobs: DataFrame, documents: list[str], all_: bool = False) -> DataFrame:
    """The findings of each blob. documents: TOML texts, of which the first is the primary set."""
    own = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content")
    return own.mapInArrow(partial(_from_text, documents=documents, all_=all_), SCHEMA)


@lru_cache(maxsize=4)
def matcher_of(documents: tuple[str, ...]) -> Matcher:
    """The matcher of some documents; a worker keeps it for all its tasks."""
    from ..sources import catalog

    return Matcher(catalog.without_redundant([s for k, text in enumerate(documents) for s in catalog.load_text(text, priority=k)[0]]))


def _from_text(batches: Iterator[pa.RecordBatch], documents: list[str], all_: bool) -> Iterator[pa.RecordBatch]:
    """Rules are closures, which don't travel; the signatures' texts do."""
    yield from _rows(batches, matcher_of(tuple(documents)), all_)
