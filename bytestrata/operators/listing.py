"""Members of archives, without unpacking them: name, size, note."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import Stop

#: LIM-1: a longer list is cut, and says so.
MOST_MEMBERS = 5000
Member = tuple[str, int, str]


def _tar(data: bytes, at: int) -> Iterator[Member]:
    """LST-1."""
    while at + 512 <= len(data) and data[at]:
        name = data[at : at + 100].split(b"\0")[0].decode("latin-1")
        prefix = data[at + 345 : at + 500].split(b"\0")[0].decode("latin-1") if data[at + 257 : at + 262] == b"ustar" else ""
        size = int(data[at + 124 : at + 136].strip(b" \0") or b"0", 8)
        yield f"{prefix}/{name}" if prefix else name, size, {53: "directory", 50: "symlink", 49: "link"}.get(data[at + 156], "")
        at += 512 + (size + 511) // 512 * 512


def _cpio(data: bytes, at: int) -> Iterator[Member]:
    """LST-2."""
    while data[at : at + 6] in (b"070701", b"070702"):
        mode, size, length = (int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in (1, 6, 11))
        name = data[at + 110 : at + 109 + length].decode("latin-1")
        if name == "TRAILER!!!":
            return
        yield name, size, {4: "directory", 10: "symlink"}.get(mode >> 12, "")
        at += (110 + length + 3) // 4 * 4 + (size + 3) // 4 * 4


def _zip(data: bytes, at: int) -> Iterator[Member]:
    """LST-3: the central directory of the last end record."""
    end = data.rfind(b"PK\5\6", max(at, len(data) - 66_000))
    if end < 0:
        return
    here = at + int.from_bytes(data[end + 16 : end + 20], "little")
    while data[here : here + 4] == b"PK\1\2":
        method, size = int.from_bytes(data[here + 10 : here + 12], "little"), int.from_bytes(data[here + 24 : here + 28], "little")
        n, extra, note = (int.from_bytes(data[here + k : here + k + 2], "little") for k in (28, 30, 32))
        yield data[here + 46 : here + 46 + n].decode("utf-8", "replace"), size, {0: "stored", 8: "deflate"}.get(method, f"method {method}")
        here += 46 + n + extra + note


def _cab(data: bytes, at: int) -> Iterator[Member]:
    """LST-4: the file table; the note is the codec of the file's folder."""
    word = lambda p, n=2: int.from_bytes(data[p : p + n], "little")
    flags, here = word(at + 30), at + 36
    reserve = (word(here), data[here + 2]) if flags & 4 else (0, 0)
    here += (4 + reserve[0]) if flags & 4 else 0
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                here = data.index(b"\0", here) + 1
    codecs = [("none", "mszip", "quantum", "lzx")[word(here + k * (8 + reserve[1]) + 6) & 3] for k in range(word(at + 26))]
    here = at + word(at + 16, 4)
    for _ in range(word(at + 28)):
        end = data.index(b"\0", here + 16)
        folder = word(here + 8)
        yield data[here + 16 : end].decode("latin-1").replace("\\", "/"), word(here, 4), codecs[folder] if folder < len(codecs) else "spanned"
        here = end + 1


def _cfbf(data: bytes, at: int) -> Iterator[Member]:
    """LST-5: storages and streams with their paths."""
    from .embedded import Compound

    for path, e in Compound(data[at:]).walk():
        yield path, int.from_bytes(e[120:124], "little") if e[66] == 2 else 0, "stream" if e[66] == 2 else "storage"


KNOWN: dict[str, Callable[[bytes, int], Iterator[Member]]] = {"tar": _tar, "cpio": _cpio, "zip": _zip, "cab": _cab, "cfbf": _cfbf}


def members(data: bytes, type_: str, offset: int) -> tuple[list[Member], bool]:
    """The members that can be read, and whether the list was cut."""
    out: list[Member] = []
    try:
        for m in KNOWN[type_](data, offset):
            if len(out) == MOST_MEMBERS:
                return out, True
            out.append(m)
    except (ValueError, IndexError, Stop, struct.error):
        pass
    return out, False


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("blob_id", pa.int64()), ("offset_", pa.int64()), ("type_", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("note", pa.string()), ("members_truncated", pa.bool_())])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            for f in row["found"]:
                names, cut = members(row["content"] or b"", f["type_"], f["offset_"])
                rows += [{"blob_id": row["blob_id"], **f, "name": n, "size": s, "note": t, "members_truncated": cut} for n, s, t in names]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def listed(blobs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per member of each finding that has a lister."""
    found = findings.where(F.col("type_").isin(*KNOWN)).groupBy("blob_id").agg(F.collect_list(F.struct("offset_", "type_")).alias("found"))
    rows = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content").join(found, "blob_id")
    return rows.mapInArrow(_listed, "blob_id long, offset_ long, type_ string, name string, size long, note string, members_truncated boolean")
