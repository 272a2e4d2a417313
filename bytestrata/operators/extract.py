"""Unpacking: a blob's findings to files, level by level.

Extraction is a stage of rows to rows: (blob_id, path, kind, content, status). Levels are a loop on the driver; each level's
blobs are a DataFrame that is written to the shared folder before the next, so no level is computed twice and a lost
executor costs its tasks only.
"""

from __future__ import annotations

import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schemes
from . import identify as ident
from .lineage import cut_lineage

#: LIM-3: bytes and files that one finding, and all findings of a blob, may give, and levels.
MOST_BYTES, MOST_FILES, MOST_DEPTH = 1 << 32, 500_000, 8
#: Bytes of one file: a cell of Spark and Arrow ends below 2 GiB. Larger files are left out, never cut.
MOST_CELL = (1 << 31) - (1 << 20)
#: Bytes of the files from which a batch goes out.
BATCH = 1 << 28
#: LIM-3: smaller results aren't looked into.
LEAST_DESCENT = 64

File = tuple[str, str, bytes]
KNOWN: dict[str, Callable[[bytes], Iterator[File]]] = {}


class Stop(Exception):
    """A finding that can't be unpacked; its text is the status."""


def _extractor(*types: str):
    def add(f: Callable[[bytes], Iterator[File]]):
        KNOWN.update(dict.fromkeys(types, f))
        return f

    return add


def safe_path(path: str) -> str:
    """FN-19: a relative path without empty, ``.`` or ``..`` parts; raises Stop for one that leaves the root."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts or "\0" in path or not parts:
        raise Stop("error:unsafe-path")
    return "/".join(parts)


#: What holds one stream: bytes to what it decodes to and how many of them it took, its end read from the stream itself.
STREAMS: dict[str, Callable[[bytes], tuple[bytes, int]]] = {}


def _stream(*types: str):
    def add(f: Callable[[bytes], tuple[bytes, int]]):
        STREAMS.update(dict.fromkeys(types, f))
        KNOWN.update({t: lambda data, f=f: iter([("data", "file", f(data)[0])]) for t in types})
        return f

    return add


@_stream("gzip")
def inflate(data: bytes, wbits: int = 47) -> tuple[bytes, int]:
    """COD-2, COD-3."""
    coder = zlib.decompressobj(wbits)
    out = coder.decompress(data, MOST_BYTES)
    if not coder.eof:
        raise Stop("error:too-large" if len(out) >= MOST_BYTES else "error:truncated")
    return out, len(data) - len(coder.unused_data)


@_stream("xz", "lzma")
def _lzma(data: bytes) -> tuple[bytes, int]:
    coder = lzma.LZMADecompressor(memlimit=1 << 30)
    out = coder.decompress(data, MOST_BYTES)
    if not coder.eof:
        raise Stop("error:too-large" if len(out) >= MOST_BYTES else "error:truncated")
    return out, len(data) - len(coder.unused_data)


@_stream("zstd")
def _zstd(data: bytes) -> tuple[bytes, int]:
    coder, out, at = zstandard.ZstdDecompressor().decompressobj(), bytearray(), 0
    while at < len(data) and not coder.eof:
        out += coder.decompress(data[at : at + (1 << 16)])
        at = min(at + (1 << 16), len(data))
        if len(out) > MOST_BYTES:
            raise Stop("error:too-large")
    if not coder.eof:
        raise Stop("error:truncated")
    return bytes(out), at - len(coder.unused_data)


def lz4_block(data: bytes, most: int = MOST_BYTES, before: bytes = b"") -> bytes:
    """COD-5: sequences of literals and matches, which may reach into what came before."""
    out, at = bytearray(before), 0
    while at < len(data):
        token, at = data[at], at + 1
        n = token >> 4
        if n == 15:
            while True:
                n, at = n + data[at], at + 1
                if data[at - 1] < 255:
                    break
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        back, at = int.from_bytes(data[at : at + 2], "little"), at + 2
        if not 0 < back <= len(out):
            raise Stop("error:corrupt")
        n = token & 15
        if n == 15:
            while True:
                n, at = n + data[at], at + 1
                if data[at - 1] < 255:
                    break
        for _ in range(n + 4):
            out.append(out[-back])
        if len(out) - len(before) > most:
            raise Stop("error:too-large")
    return bytes(out[len(before) :])


@_stream("lz4")
def _lz4(data: bytes) -> tuple[bytes, int]:
    """A frame: its descriptor, then blocks with their sizes, stored ones marked by the top bit, up to the mark of the end."""
    flags = data[4]
    at, out = 7 + 8 * (flags >> 3 & 1) + 4 * (flags & 1), bytearray()
    while True:
        if at + 4 > len(data):
            raise Stop("error:truncated")
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if not size:
            return bytes(out), min(at + 4 * (flags >> 2 & 1), len(data))
        raw = data[at : at + (size & 0x7FFFFFFF)]
        if size >> 31:
            out += raw
        else:
            out += lz4_block(raw, before=bytes(out[-65536:]) if not flags & 0x20 else b"")
        at += (size & 0x7FFFFFFF) + 4 * (flags >> 4 & 1)
        if len(out) > MOST_BYTES:
            raise Stop("error:too-large")


@_stream("lz4_legacy")
def _lz4_legacy(data: bytes) -> tuple[bytes, int]:
    out, at = [], 4
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if not size or at + 4 + size > len(data):
            break
        out.append(lz4_block(data[at + 4 : at + 4 + size]))
        at += 4 + size
        if sum(map(len, out)) > MOST_BYTES:
            raise Stop("error:too-large")
    return b"".join(out), at


@_extractor("tar")
def _tar(data: bytes) -> Iterator[File]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isfile():
                yield safe_path(m.name), "file", t.extractfile(m).read()
            elif m.issym():
                yield safe_path(m.name), "symlink", m.linkname.encode()


@_extractor("zip")
def _zip(data: bytes) -> Iterator[File]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                kind = "symlink" if m.external_attr >> 28 == 0xA else "file"
                yield safe_path(m.filename), kind, z.read(m)


@_extractor("cpio")
def _cpio(data: bytes) -> Iterator[File]:
    at = 0
    while data[at : at + 6] in (b"070701", b"070702"):
        field = lambda k, at=at: int(data[at + 6 + 8 * k : at + 14 + 8 * k], 16)
        mode, size, length = field(1), field(6), field(11)
        name = data[at + 110 : at + 109 + length].decode("latin-1")
        body = (at + 110 + length + 3) // 4 * 4
        if name == "TRAILER!!!":
            return
        if mode >> 12 in (8, 10):
            yield safe_path(name), "file" if mode >> 12 == 8 else "symlink", data[body : body + size]
        at = (body + size + 3) // 4 * 4


@_extractor("romfs")
def _romfs(data: bytes) -> Iterator[File]:
    """Headers of 16 bytes, then a padded name; the low bits of the first word are the kind."""
    word = lambda at: int.from_bytes(data[at : at + 4], "big")
    pad = lambda at: (data.index(b"\0", at) - at + 16) // 16 * 16
    todo, seen = [("", 16 + pad(16))], set()
    while todo:
        folder, at = todo.pop()
        while at and at + 16 <= len(data) and at not in seen:
            seen.add(at)
            following, info, size = word(at), word(at + 4), word(at + 8)
            name = data[at + 16 : data.index(b"\0", at + 16)].decode("latin-1")
            body = at + 16 + pad(at + 16)
            if name not in (".", ".."):
                path = f"{folder}/{name}".lstrip("/")
                if following & 7 == 1:
                    todo.append((path, info & ~15))
                elif following & 7 in (2, 3):
                    yield safe_path(path), "file" if following & 7 == 2 else "symlink", data[body : body + size]
            at = following & ~15


@_extractor("uimage")
def _uimage(data: bytes) -> Iterator[File]:
    size = int.from_bytes(data[12:16], "big")
    payload, codec = data[64 : 64 + size], data[31]
    if codec in (1, 3, 6):
        payload = {1: inflate, 3: _lzma, 6: _zstd}[codec](payload)[0]
    elif codec == 5:
        payload = (_lz4_legacy if payload[:4] == b"\x02\x21\x4c\x18" else _lz4)(payload)[0]
    elif codec:
        raise Stop(f"unsupported:{codec}")
    yield "payload", "file", payload


@_extractor("android_sparse")
def _sparse(data: bytes) -> Iterator[File]:
    word = lambda at, n=4: int.from_bytes(data[at : at + n], "little")
    out, at, block = [], 28, word(12)
    for _ in range(word(20)):
        if at + 12 > len(data):
            raise Stop("error:truncated")
        kind, blocks, total = word(at, 2), word(at + 4), max(12, word(at + 8))
        size = blocks * block
        if sum(map(len, out)) + size > MOST_BYTES:
            raise Stop("error:too-large")
        if kind == 0xCAC1:
            out.append(data[at + 12 : at + 12 + size])
        elif kind == 0xCAC2:
            out.append(data[at + 12 : at + 16] * (size // 4))
        elif kind == 0xCAC3:
            out.append(bytes(size))
        at += total
    yield "unsparsed.img", "file", b"".join(out)


@_extractor("ihex")
def _ihex(data: bytes) -> Iterator[File]:
    base, parts = 0, []
    for line in data.split(b"\n"):
        line = line.strip()
        if line[:1] != b":":
            continue
        raw = bytes.fromhex(line[1:].decode())
        place, kind, body = int.from_bytes(raw[1:3], "big"), raw[3], raw[4 : 4 + raw[0]]
        if kind == 0:
            if parts and parts[-1][0] + len(parts[-1][1]) == base + place:
                parts[-1][1].extend(body)
            else:
                parts.append((base + place, bytearray(body)))
        elif kind in (2, 4):
            base = int.from_bytes(body, "big") << (4 if kind == 2 else 16)
        elif kind == 1:
            break
    for start, body in parts:
        yield f"0x{start:08x}.bin", "file", bytes(body)


def _scheme(name: str) -> Callable[[bytes], Iterator[File]]:
    def open_(data: bytes) -> Iterator[File]:
        files = list(schemes.descrambled(data, name))
        if not files:
            raise Stop("error:no-key")
        yield from files

    return open_


KNOWN.update({name: _scheme(name) for name in schemes.SCHEMES})


def _register() -> None:
    from . import containers, disks, embedded, filesystems, flash, packed  # noqa: F401  add their extractors


def unpack(data: bytes, type_: str) -> tuple[list[File], str]:
    """The files of a finding and a status: ok, partial, unsupported or an error."""
    _register()
    if type_ not in KNOWN:
        return [], "unsupported"
    files, total, left_out = [], 0, False
    try:
        for path, kind, content in KNOWN[type_](data):
            total += len(content)
            if total > MOST_BYTES or len(files) >= MOST_FILES:
                return files, "partial" if files else "error:too-large"
            if len(content) > MOST_CELL:
                left_out = True
                continue
            files.append((path, kind, content))
    except Stop as e:
        return files, str(e) if not files else "partial"
    except (ValueError, IndexError, EOFError, OSError, KeyError, zlib.error, lzma.LZMAError, zstandard.ZstdError, tarfile.TarError, zipfile.BadZipFile, NotImplementedError, RuntimeError, struct.error) as e:
        return files, "partial" if files else f"error:{type(e).__name__}"
    return files, "ok" if not left_out else "partial" if files else "error:too-large"


def sparse_span(data: bytes) -> int:
    """How many bytes the chunks of a sparse image take."""
    at = 28
    for _ in range(int.from_bytes(data[20:24], "little")):
        if at + 12 > len(data):
            break
        at += max(12, int.from_bytes(data[at + 8 : at + 12], "little"))
    return min(at, len(data))


#: Formats that are unpacked from where they begin first; later findings of the family are parts of them.
_FAMILIES = {"jffs2": "jffs2", "ubi": "ubi", "ubifs": "ubi", "exfat": "exfat"}
#: What has no length of its own: the blob's rest is given to it.
_OPEN_ENDED = ("zip", "jffs2", "ubi", "ubifs", "exfat", "android_sparse")


def has_executable_magic(data: bytes) -> bool:
    """FN-21: MZ, ELF and Mach-O."""
    return data[:2] == b"MZ" or data[:4] in (b"\x7fELF", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe")


def unpacked(data: bytes, found: list[ident.Finding], depth: int = 1, unpack_executables: bool = False) -> Iterator[tuple[ident.Finding, list[File], str]]:
    """INT-11: findings in order with their files and status, without those that an earlier one covers.

    A sparse image covers what is inside, a stream what it took, a flash file system all later findings of its family.
    """
    _register()
    sparse_end = stream_end = 0
    families: set[str] = set()
    if depth > 1 and not unpack_executables and has_executable_magic(data):
        if any(f.type in KNOWN and f.confidence >= ident.OWNER for f in found):
            yield found[0], [], "skipped:executable"
        return
    for f in found:
        if (f.type not in KNOWN and f.type != "upx") or (depth > 1 and f.confidence < ident.OWNER):
            continue
        if (f.type != "android_sparse" and f.offset < sparse_end) or (f.type not in STREAMS and f.offset < stream_end):
            continue
        family = _FAMILIES.get(f.type)
        if family in families:
            continue
        if family:
            families.add(family)
        if depth > 1 and not unpack_executables and f.type == "cfbf":
            yield f, [], "skipped:executable"
            continue
        if f.type == "upx":
            yield f, *_program(data, f.offset)
            continue
        rest = data[f.offset :]
        if f.type in STREAMS:
            try:
                content, used = STREAMS[f.type](rest)
                files, status, stream_end = [("data", "file", content)], "ok", max(stream_end, f.offset + used)
                if len(content) > MOST_CELL:
                    files, status = [], "error:too-large"
            except Exception:  # the status says what it was
                files, status = unpack(rest, f.type)
        else:
            files, status = unpack(rest if f.type in _OPEN_ENDED else rest[: f.size], f.type)
            if f.type == "android_sparse" and files:
                sparse_end = max(sparse_end, f.offset + sparse_span(rest))
        if depth == 1 or files:
            yield f, files, status


def _program(data: bytes, trailer: int) -> tuple[list[File], str]:
    """What a packed program unpacks to; its header stands behind it."""
    from . import packed

    base = packed.upx_base(data, trailer)
    if base is None:
        return [], "error:no-stub"
    try:
        return [("unpacked.elf", "file", packed.upx_unpacked(data[base:]))], "ok"
    except Stop as e:
        return [], str(e)


#: Results of more bytes than the first that are more than the second times their finding's size aren't looked into.
BOMB_BYTES, BOMB_RATIO = 10 << 20, 1000

_ROWS = pa.schema([("root_id", pa.int64()), ("parent_id", pa.int64()), ("offset_", pa.int64()), ("type_", pa.string()), ("status", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("capped", pa.string()), ("content", pa.binary())])
SCHEMA = "root_id long, parent_id long, offset_ long, type_ string, status string, path string, kind string, capped string, content binary"


def _level(batches: Iterator[pa.RecordBatch], documents: list[str], depth: int, unpack_executables: bool) -> Iterator[pa.RecordBatch]:
    matcher = ident.matcher_of(tuple(documents))
    for batch in batches:
        for root, blob, content in zip(batch.column("root_id").to_pylist(), batch.column("blob_id").to_pylist(), batch.column("content"), strict=True):
            data, rows, size = content.as_py() or b"", [], 0
            for f, files, status in unpacked(data, ident.findings(data, matcher), depth, unpack_executables):
                total = sum(len(c) for *_, c in files)
                bomb = "ratio" if total > BOMB_BYTES and f.size > 0 and total // f.size > BOMB_RATIO else None
                for p, k, c in files or [(None, None, None)]:
                    if rows and size + len(c or b"") > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                        rows, size = [], 0
                    rows.append({"root_id": root, "parent_id": blob, "offset_": f.offset, "type_": f.type, "status": status, "path": p, "kind": k, "capped": bomb, "content": c})
                    size += len(c or b"")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


def extract(blobs: DataFrame, documents: list[str], depth: int = MOST_DEPTH, unpack_executables: bool = False, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All files that blobs hold, at any depth: depth, blob_id, root_id, parent_id, offset_, type_, status, path, kind, capped, content.

    AGG-15, LIM-3: a blob whose files so far reach a limit isn't unpacked any deeper; capped says so on a row of its own
    (max-files or max-bytes), as it does on the files of a finding that grew beyond the ratio.
    """
    level, out, totals = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), F.col("blob_id").cast("long").alias("root_id"), "content"), None, None
    nothing = F.lit(None)
    for k in range(1, depth + 1):
        files = level.select("root_id", "blob_id", "content").mapInArrow(partial(_level, documents=documents, depth=k, unpack_executables=unpack_executables), SCHEMA)
        files = cut_lineage(files.select(F.lit(k).alias("depth"), F.xxhash64("parent_id", "offset_", "path").alias("blob_id"), "*"))
        out = files if out is None else out.unionByName(files)
        level = files.where((F.col("kind") == "file") & (F.octet_length("content") >= LEAST_DESCENT) & F.col("capped").isNull())
        if k == depth or not level.limit(1).count():
            break
        made = files.where("kind = 'file'").groupBy("root_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
        totals = made if totals is None else totals.unionByName(made).groupBy("root_id").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        totals = cut_lineage(totals)
        full = totals.where((F.col("files") >= most_files) | (F.col("bytes") >= most_bytes))
        if full.limit(1).count():
            why = F.when(F.col("files") >= most_files, "max-files").otherwise("max-bytes")
            stopped = level.select("root_id").distinct().join(full, "root_id").select(
                F.lit(k + 1).alias("depth"), nothing.cast("long").alias("blob_id"), "root_id", nothing.cast("long").alias("parent_id"), nothing.cast("long").alias("offset_"), nothing.cast("string").alias("type_"),
                F.lit("capped").alias("status"), nothing.cast("string").alias("path"), nothing.cast("string").alias("kind"), why.alias("capped"), nothing.cast("binary").alias("content"),
            )
            out, level = out.unionByName(stopped), level.join(full.select("root_id"), "root_id", "left_anti")
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """SNK-5: a JSON document for each blob: what was unpacked from where, with numbers and status, in order, and why it stopped."""
    entry = rows.where("status <> 'capped'").groupBy("root_id", "depth", "parent_id", "offset_", "type_", "status").agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symlink").alias("symlinks"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).alias("bytes")
    )
    entries = entry.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("offset_").alias("offset"), F.col("type_").alias("type"), "parent_id", "status", "files", "symlinks", "bytes"))).alias("entries"))
    capped = rows.groupBy("root_id").agg(F.min("capped").alias("cap_reason"), F.count_if(F.col("status") == "skipped:executable").alias("skipped_nested_executables"))
    doc = F.struct(F.col("root_id").alias("source"), F.col("cap_reason").isNotNull().alias("capped"), "cap_reason", "skipped_nested_executables", F.transform(F.coalesce("entries", F.array().cast(entries.schema["entries"].dataType)), lambda e: e.dropFields("parent_id")).alias("entries"))
    return capped.join(entries, "root_id", "left").select(F.col("root_id").alias("blob_id"), F.to_json(doc).alias("json"))
