"""Validators: what a candidate's bytes say beyond its header fields.

Each takes (data, finding, fields), may change the finding's type, offset, size, tier, label or members, and returns whether
the candidate stays. Reads past the end reject or stop, never raise.
"""

from __future__ import annotations

import builtins
import lzma
import re
import struct
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from . import checksums, schemes

MAGIC, STRUCTURAL, CONSISTENT, VERIFIED = 25, 60, 85, 99
Validator = Callable[[bytes, "object", dict], bool]
KNOWN: dict[str, Validator] = {}


@dataclass
class Member:
    """A part of a finding that has a name: an offset if it is one range of the blob, and the findings inside it."""

    name: str
    offset: int | None
    size: int
    note: str = ""
    children: list = field(default_factory=list)


def _validator(f: Validator) -> Validator:
    def safe(data: bytes, finding, fields: dict) -> bool:
        try:
            return bool(f(data, finding, fields))
        except (IndexError, struct.error, ValueError, OverflowError):
            return False

    KNOWN[f.__name__] = safe
    return safe


def _u(data: bytes, at: int, width: int, endian: str = "little") -> int:
    if at < 0 or at + width > len(data):
        raise IndexError(at)
    return int.from_bytes(data[at : at + width], endian)


def _pow2(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def _set(f, confidence: int, size: int | None = None, **more) -> bool:
    f.confidence = confidence
    if size is not None:
        f.size = size
    for k, v in more.items():
        setattr(f, k, v)
    return True


@_validator
def xz(data, f, fields):
    """VAL-45: the CRC of the two flag bytes."""
    return checksums.crc32(data[f.offset + 6 : f.offset + 8]) == _u(data, f.offset + 8, 4) and _set(f, VERIFIED)


@_validator
def png(data, f, fields):
    """VAL-26: chunks up to IEND."""
    at, good = f.offset + 8, True
    while True:
        size = _u(data, at, 4, "big")
        crc = _u(data, at + 8 + size, 4, "big")
        good &= checksums.crc32(data[at + 4 : at + 8 + size]) == crc
        kind, at = data[at + 4 : at + 8], at + 12 + size
        if kind == b"IEND":
            return _set(f, VERIFIED if good else CONSISTENT, at - f.offset)


@_validator
def gif(data, f, fields):
    """VAL-10: blocks up to the trailer."""
    flags = _u(data, f.offset + 10, 1)
    at = f.offset + 13 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)
    if at >= len(data) or data[at] not in (0x2C, 0x21, 0x3B):
        return False
    try:
        while data[at] != 0x3B:
            if data[at] == 0x2C:
                local = data[at + 9]
                at += 10 + (3 * (2 << (local & 7)) if local & 0x80 else 0) + 1
            elif data[at] == 0x21:
                at += 2
            else:
                return True
            while data[at]:
                at += 1 + data[at]
            at += 1
    except IndexError:
        return True
    return _set(f, CONSISTENT, at + 1 - f.offset)


@_validator
def jpeg(data, f, fields):
    """VAL-13: segments up to a frame header with a plausible size, or the end of the image."""
    at, framed = f.offset + 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return framed
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return _set(f, CONSISTENT, at + 2 - f.offset)
        if kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        size = _u(data, at + 2, 2, "big")
        if size < 2:
            return framed
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            ok = size >= 8 and data[at + 4] in (8, 12, 16) and _u(data, at + 5, 2, "big") and _u(data, at + 7, 2, "big") and 1 <= data[at + 9] <= 4 and size == 8 + 3 * data[at + 9]
            if not ok:
                return False
            framed = _set(f, CONSISTENT)
        at += 2 + size
        if kind == 0xDA:
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return framed
    return framed


@_validator
def ihex(data, f, fields):
    """VAL-11: the first record's checksum."""
    line = re.match(rb":([0-9A-Fa-f]{8,})\r?\n?", data[f.offset : f.offset + 600])
    if not line:
        return False
    raw = bytes.fromhex(line[1].decode()[: len(line[1]) // 2 * 2])
    if len(raw) == raw[0] + 5 and sum(raw) & 0xFF == 0:
        return _set(f, CONSISTENT)
    return line[0][-1:] in b"\r\n" and _set(f, STRUCTURAL)


def _octal(raw: bytes) -> int:
    text = raw.strip(b" \0")
    if not text or not re.fullmatch(rb"[0-7]+", text):
        raise ValueError(raw)
    return int(text, 8)


@_validator
def tar(data, f, fields):
    """VAL-33: headers, with their checksums, up to a block of zeros."""
    at, n = f.offset, 0
    while True:
        block = data[at : at + 512]
        if len(block) < 512 or not any(block):
            at += 512 * (len(block) == 512)
            while n and data[at : at + 512] == bytes(512):
                at += 512
            break
        if block[257:262] != b"ustar" or _octal(block[148:156]) != sum(block) - sum(block[148:156]) + 8 * 32:
            break
        size = _octal(block[124:136]) if block[124] < 0x80 else int.from_bytes(block[125:136], "big")
        at, n = at + 512 + (size + 511) // 512 * 512, n + 1
    return n > 0 and _set(f, CONSISTENT, min(at, len(data)) - f.offset)


@_validator
def cpio(data, f, fields):
    """VAL-4: the hexadecimal fields of a new-style member."""
    head = data[f.offset : f.offset + 110]
    if head[:6] == b"070707":
        return _set(f, MAGIC)
    if len(head) < 110 or not re.fullmatch(rb"[0-9A-Fa-f]{104}", head[6:]):
        return False
    size, name = int(head[54:62], 16), int(head[94:102], 16)
    total = (110 + name + 3) // 4 * 4 + (size + 3) // 4 * 4
    return 0 < name <= 4096 and f.offset + total <= len(data) + 3 and _set(f, CONSISTENT, min(total, len(data) - f.offset))


@_validator
def zip(data, f, fields):
    """VAL-47: the last end record, whose directory ends where it begins."""
    at = data.rfind(b"PK\5\6", max(f.offset, len(data) - 66_000))
    if at < 0 or at + 22 > len(data):
        return True
    size, start = _u(data, at + 12, 4), _u(data, at + 16, 4)
    if f.offset + start + size != at:
        return True
    return _set(f, CONSISTENT, at + 22 + _u(data, at + 20, 2) - f.offset)


# The codes of a legacy boot image's header.
_UIMAGE_COMP = {0: "none", 1: "gzip", 2: "bzip2", 3: "lzma", 4: "lzo", 5: "lz4", 6: "zstd"}


@_validator
def uimage(data, f, fields):
    """VAL-38: the header's CRC; a wrong one makes its size worthless."""
    head = data[f.offset : f.offset + 64]
    f.label = head[32:64].split(b"\0")[0].decode("latin-1")
    f.compression = _UIMAGE_COMP.get(head[31], "")
    f.diagnostics.append(("info", "uimage-payload-endian-unknown", "the header is big-endian whatever the payload is"))
    if checksums.crc32(head[:4] + bytes(4) + head[8:]) == fields["ih_hcrc"]:
        return _set(f, VERIFIED)
    return _set(f, STRUCTURAL, 0)


@_validator
def jffs2(data, f, fields):
    """VAL-12."""
    if checksums.crc32_jffs2(data[f.offset : f.offset + 8]) == fields["hdr_crc"]:
        _set(f, VERIFIED)
    return True


@_validator
def ubi(data, f, fields):
    """VAL-34: the CRC at the end of the 64-byte header."""
    if len(data) >= f.offset + 64 and checksums.crc32_ubi(data[f.offset : f.offset + 60]) == _u(data, f.offset + 60, 4, "big"):
        _set(f, VERIFIED)
    return True


@_validator
def ubifs(data, f, fields):
    """VAL-35: the node's CRC."""
    if checksums.crc32_ubi(data[f.offset + 8 : f.offset + fields["len"]]) == _u(data, f.offset + 4, 4):
        _set(f, VERIFIED)
    return True


@_validator
def dtb(data, f, fields):
    """VAL-6: a tree with images is a bootable container."""
    tree = data[f.offset : f.offset + f.size]
    if b"\0\0\0\1images\0" in tree[fields["off_dt_struct"] :]:
        return _set(f, CONSISTENT, type="fit", category="container")
    return True


@_validator
def elf(data, f, fields):
    """VAL-7: the extent of the header tables, segments and sections."""
    e = "little" if fields["ei_data"] == 1 else "big"
    f.endian = e
    wide = fields["ei_class"] == 2
    word, at = (8 if wide else 4), f.offset
    phoff, shoff = _u(data, at + (32 if wide else 28), word, e), _u(data, at + (40 if wide else 32), word, e)
    phsize, phnum, shsize, shnum = (_u(data, at + k, 2, e) for k in ((54, 56, 58, 60) if wide else (42, 44, 46, 48)))
    avail, end = len(data) - at, (64 if wide else 52)
    if phnum and phsize == (56 if wide else 32):
        for k in range(phnum):
            p = at + phoff + k * phsize
            if p + phsize > len(data):
                break
            start, size = (_u(data, p + (8 if wide else 4), word, e), _u(data, p + (32 if wide else 16), word, e))
            if start + size <= avail:
                end = max(end, start + size)
        end = max(end, min(avail, phoff + phnum * phsize))
    real = shnum and shsize == (64 if wide else 40) and shoff + shnum * shsize <= avail and not any(data[at + shoff : at + shoff + shsize])
    if real:
        end = max(end, shoff + shnum * shsize)
        for k in range(shnum):
            s = at + shoff + k * shsize
            start, size = _u(data, s + (24 if wide else 16), word, e), _u(data, s + (32 if wide else 20), word, e)
            if _u(data, s + 4, 4, e) != 8 and start + size <= avail:
                end = max(end, start + size)
    return _set(f, CONSISTENT, min(end, avail))


#: VAL-23: what a trial decoding gives at most; larger streams aren't lzma streams.
LZMA_MOST = 512 << 20


@_validator
def lzma_(data, f, fields):
    """VAL-23: plausible properties, a decoding to the end, and a span that no byte makes up half of."""
    props, size, declared = data[f.offset], _u(data, f.offset + 1, 4), _u(data, f.offset + 5, 8)
    known = declared != 2**64 - 1
    if props > 224 or not _pow2(size) or not 4096 <= size <= 768 << 20 or (known and not 0 < declared <= LZMA_MOST):
        return False
    coder, decoded, at = lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=1 << 30), 0, f.offset
    try:
        while not coder.eof:  # in steps, as what it decodes to is only counted
            step = data[at : at + (1 << 16)] if coder.needs_input else b""
            at += len(step)
            if coder.needs_input and not step:
                return False
            decoded += len(coder.decompress(step, 1 << 22))
            if decoded > LZMA_MOST:
                return False
    except lzma.LZMAError:
        return False
    if known and decoded != declared or not decoded:
        return False
    used = at - f.offset - len(coder.unused_data)
    if max(Counter(data[f.offset : f.offset + used]).values()) > used / 2:
        return False
    unit = f"{size >> 20} MiB" if size >> 20 else f"{size} B"
    return _set(f, VERIFIED, used, label=f"{decoded} bytes, dict {unit}")


KNOWN["lzma"] = KNOWN.pop("lzma_")


@_validator
def uefi_fv(data, f, fields):
    """VAL-37: the header's words sum to zero."""
    if checksums.sum16(data[f.offset : f.offset + fields["header_length"]]) == 0:
        _set(f, VERIFIED)
    f.label = str(uuid.UUID(bytes_le=data[f.offset + 16 : f.offset + 32]))
    return True


@_validator
def squashfs(data, f, fields):
    """VAL-29: the id table lies inside."""
    names = {1: "gzip", 2: "lzma", 3: "lzo", 4: "xz", 5: "lz4", 6: "zstd"}  # Fixed values: the codec's number
    f.version, f.compression = f"{fields['s_major']}.{fields['s_minor']}", names.get(fields["compression"], "")
    good = fields["compression"] in names and 96 <= fields["id_table_start"] < fields["bytes_used"]
    return _set(f, CONSISTENT if good else STRUCTURAL)


def _luks_token(raw: bytes) -> bool:
    return bool(re.fullmatch(rb"[\w\-:]+", raw))


@_validator
def luks(data, f, fields):
    """VAL-22, FN-16: the printable fields of either version; of the second, what its JSON says."""
    version = _u(data, f.offset + 6, 2, "big")
    token = lambda a, n: data[f.offset + a : f.offset + a + n].split(b"\0")[0]
    if not re.fullmatch(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token(168, 40)):
        return False
    if version == 1:
        names, start, key = [token(a, 32) for a in (8, 40, 72)], _u(data, f.offset + 104, 4, "big"), _u(data, f.offset + 108, 4, "big")
        ok = all(map(_luks_token, names)) and 1 <= key <= 1024 and 1 <= start <= 1 << 24
        return ok and _set(f, CONSISTENT, type="luks1", version="1", endian="big", label=f"{names[0].decode()}-{names[1].decode()}, {names[2].decode()}, {8 * key}-bit")
    size, check = _u(data, f.offset + 8, 8, "big"), token(72, 32)
    if version != 2 or not 0x4000 <= size <= 4 << 20 or _u(data, f.offset + 256, 8, "big") or (check and not _luks_token(check)):
        return False
    area = data[f.offset + 4096 : f.offset + min(size, 4096 + (1 << 20))]
    cipher, bits = re.search(rb'"encryption"\s*:\s*"([^"]*)"', area), re.search(rb'"key_size"\s*:\s*(\d+)', area)
    kdf = re.search(rb'"kdf".*?"type"\s*:\s*"([^"]*)"', area, re.S)
    said = [cipher[1].decode("latin-1") if cipher and cipher[1] else "encrypted"]
    said += [kdf[1].decode()] if kdf and _luks_token(kdf[1]) else []
    said += [f"{8 * int(bits[1])}-bit"] if bits and 0 < int(bits[1]) <= 1024 else []
    return _set(f, CONSISTENT, type="luks2", version="2", endian="big", label=", ".join(said))


@_validator
def minix(data, f, fields):
    """VAL-16."""
    sb = f.offset + 1024
    if f.type == "minix_v3" or data[sb + 24 : sb + 26] == b"Z\x4d":
        inodes, maps, zmaps, first = _u(data, sb, 4), _u(data, sb + 6, 2), _u(data, sb + 8, 2), _u(data, sb + 10, 2)
        block = _u(data, sb + 28, 2)
        ok = inodes and maps and zmaps and first and _pow2(block) and 1024 <= block <= 65536 and _u(data, sb + 20, 4)
        return ok and _set(f, CONSISTENT, type="minix", version="3")
    inodes, zones, maps, zmaps, first = (_u(data, sb + 2 * k, 2) for k in range(5))
    magic, state = _u(data, sb + 16, 2), _u(data, sb + 18, 2)
    two = magic in (0x2468, 0x2478)
    zones = _u(data, sb + 20, 4) if two else zones
    ok = inodes and zones and maps and zmaps and first < zones and state in (1, 2, 3) and maps * 8192 >= inodes
    return ok and _set(f, CONSISTENT, zones * 1024 if zones * 1024 <= len(data) - f.offset else None, version="2" if two else "1")


@_validator
def reiserfs(data, f, fields):
    """VAL-17."""
    blocks, block = _u(data, f.offset, 4), _u(data, f.offset + 44, 2)
    kind = {b"ReIsErFs\0": "3.5", b"ReIsEr2Fs": "3.6", b"ReIsEr3Fs": "3.6"}.get(data[f.offset + 52 : f.offset + 61], "3.5")
    return blocks > 0 and _pow2(block) and 512 <= block <= 8192 and _set(f, CONSISTENT, min(blocks * block, len(data) - f.offset), version=kind)


@_validator
def ufs(data, f, fields):
    """VAL-18."""
    raw = data[f.offset + 1372 : f.offset + 1376]
    e = "little" if raw in (b"\x54\x19\x01\x00", b"\x19\x01\x54\x19") else "big"
    big, small = _u(data, f.offset + 48, 4, e), _u(data, f.offset + 52, 4, e)
    return _pow2(big) and _pow2(small) and 512 <= small <= big <= 1 << 20 and _set(f, CONSISTENT, endian=e, version="1" if raw in (b"\x54\x19\x01\x00", b"\x00\x01\x19\x54") else "2")


@_validator
def apfs(data, f, fields):
    """VAL-19."""
    block, count = _u(data, f.offset + 36, 4), _u(data, f.offset + 40, 8)
    return _pow2(block) and 512 <= block <= 65536 and count > 0 and _set(f, CONSISTENT, min(block * count, len(data) - f.offset))


@_validator
def logfs(data, f, fields):
    """VAL-20."""
    return _set(f, CONSISTENT, endian="big")


@_validator
def nilfs2(data, f, fields):
    """VAL-15: the superblock's seeded CRC."""
    sb = f.offset + 1024
    size, seed, want = _u(data, sb + 8, 2), _u(data, sb + 12, 4), _u(data, sb + 16, 4)
    if not 0x30 <= size <= 1024 or _u(data, sb + 20, 4) > 6:
        return False
    raw = data[sb : sb + size]
    if len(raw) < size or checksums.crc32_raw(raw[:16] + bytes(4) + raw[20:], seed) != want:
        return False
    return _set(f, VERIFIED, min(_u(data, sb + 32, 8), len(data) - f.offset))


@_validator
def mtk_lk(data, f, fields):
    """VAL-24."""
    name = data[f.offset + 8 : f.offset + 40].split(b"\0")[0]
    ok = name and re.fullmatch(rb"[\x20-\x7e]+", name) and f.offset + 512 + fields["size"] <= len(data)
    return ok and _set(f, CONSISTENT, 512 + fields["size"], label=name.decode())


@_validator
def android_boot(data, f, fields):
    """VAL-1: all parts that the header's version declares, each on pages of its own, lie inside."""
    word = lambda k: _u(data, f.offset + k, 4)
    version = word(40)
    if version > 4:
        return False
    if version >= 3:
        page, sizes = 4096, [word(8), word(12)]
    else:
        page, sizes = word(36), [word(8), word(16), word(24)]
        if not _pow2(page):
            return True
        sizes += [word(k) for least, k in ((1, 1632), (2, 1648)) if version >= least]
    total = page + sum(-(-n // page) * page for n in sizes)
    return f.offset + total <= len(data) and _set(f, CONSISTENT, max(total, f.size), version=str(version))


@_validator
def vbmeta(data, f, fields):
    """VAL-41: all parts lie inside their blocks."""
    inside = lambda a, b, block: fields[a] + fields[b] <= fields[block]
    ok = inside("hash_offset", "hash_size", "auth_block_size") and inside("signature_offset", "signature_size", "auth_block_size")
    ok = ok and all(inside(x + "_offset", x + "_size", "aux_block_size") for x in ("public_key", "public_key_metadata", "descriptors"))
    return ok and _set(f, CONSISTENT)


@_validator
def gpt(data, f, fields):
    """VAL-31: header and table checksums; partitions as members."""
    at = f.offset
    if _u(data, at + 8, 4) != 0x10000 or _u(data, at + 24, 8) != 1:
        return False
    size = _u(data, at + 12, 4)
    head = data[at : at + size]
    if not 92 <= size <= 512 or len(head) < size:
        return False
    good_head = checksums.crc32(head[:16] + bytes(4) + head[20:]) == _u(data, at + 16, 4)
    sector = next((s for s in (512, 4096) if at % s == 0 and at >= s), 512)
    disk = at - sector
    start, n, width = disk + _u(data, at + 72, 8) * sector, _u(data, at + 80, 4), _u(data, at + 84, 4)
    if not 0 < n <= 1024 or width < 128:
        return False
    table = data[start : start + n * width]
    good_table = len(table) == n * width and checksums.crc32(table) == _u(data, at + 88, 4)
    if not (good_head or good_table):
        return False
    for k in range(0, len(table) - width + 1, width):
        if any(table[k : k + 16]):
            first, last = _u(table, k + 32, 8), _u(table, k + 40, 8)
            f.members.append(Member(table[k + 56 : k + 128].decode("utf-16-le", "ignore").split("\0")[0], disk + first * sector, (last - first + 1) * sector, str(uuid.UUID(bytes_le=table[k : k + 16]))))
    return _set(f, VERIFIED if good_head and good_table else CONSISTENT if good_head else STRUCTURAL, size)


# Names of partition types.
_MBR_TYPES = {0x01: "FAT12", 0x04: "FAT16", 0x05: "Extended", 0x06: "FAT16", 0x07: "NTFS/exFAT", 0x0B: "FAT32", 0x0C: "FAT32 LBA", 0x0E: "FAT16 LBA", 0x0F: "Extended LBA", 0x82: "Linux swap", 0x83: "Linux", 0x8E: "Linux LVM", 0xEE: "GPT protective", 0xEF: "EFI system"}
_EXTENDED = (0x05, 0x0F)


def _mbr_note(kind: int, logical: bool = False) -> str:
    known = _MBR_TYPES.get(kind)
    if known:
        return f"{known} (0x{kind:02X}{', logical' if logical else ''})"
    return f"type 0x{kind:02X}{' (logical)' if logical else ''}"


def _logical(data: bytes, start: int) -> list[tuple[int, int, int]]:
    """(type, sector, sectors) of the logical partitions of the extended one at a sector: a chain of at most 128 records."""
    found, here = [], start
    for _ in range(128):
        at = here * 512
        if data[at + 510 : at + 512] != b"\x55\xaa":
            break
        kind, first, n = data[at + 450], _u(data, at + 454, 4), _u(data, at + 458, 4)
        if kind and n:
            found.append((kind, here + first, n))
        onward, following = data[at + 466], _u(data, at + 470, 4)
        if not following or onward not in _EXTENDED or start + following <= here:
            break
        here = start + following
    return found


@_validator
def mbr(data, f, fields):
    """VAL-32: entries with legal flags, one of which at least lies on the disk; logical partitions follow their extended one."""
    if f.offset % 512:
        return False
    entries = [data[f.offset + 446 + 16 * k : f.offset + 462 + 16 * k] for k in range(4)]
    if any(len(e) < 16 or e[0] not in (0, 0x80) for e in entries):
        return False
    used = [(e[4], _u(e, 8, 4), _u(e, 12, 4)) for e in entries if e[4]]
    if not used or [k for k, _, _ in used] == [0xEE]:
        return False
    if not any(k != 0xEE and 0 < a < len(data) // 512 and (n or k in _EXTENDED) for k, a, n in used):
        return False
    for kind, first, n in used:
        f.members.append(Member(f"p{len(f.members) + 1}", first * 512, n * 512, _mbr_note(kind)))
        for k, a, m in _logical(data, first) if kind in _EXTENDED else ():
            f.members.append(Member(f"p{len(f.members) + 1}", a * 512, m * 512, _mbr_note(k, True)))
    return _set(f, CONSISTENT, 512)


@_validator
def verity(data, f, fields):
    """VAL-42: the superblock and the levels of the tree."""
    if not _pow2(fields["data_block_size"]) or not _pow2(fields["hash_block_size"]):
        return False
    name = data[f.offset + 32 : f.offset + 64].split(b"\0")[0]
    digest = {b"sha1": 20, b"sha256": 32, b"sha512": 64}.get(name)
    if not digest:
        return False
    per, blocks, n = fields["hash_block_size"] // (1 << (digest - 1).bit_length()), 0, fields["data_blocks"]
    while n > 1:
        n = -(-n // per)
        blocks += n
    size = fields["hash_block_size"] * (1 + blocks)
    return _set(f, CONSISTENT, min(size, len(data) - f.offset), label=name.decode())


@_validator
def sxverity(data, f, fields):
    """VAL-30: four records a KiB apart, then a file system."""
    ok = all(data[f.offset + 1024 * k : f.offset + 1024 * k + 8] == b"sxverity" for k in range(4)) and data[f.offset + 4096 : f.offset + 4104] == b"-rom1fs-"
    return ok and _set(f, CONSISTENT, 4096)


def cab_tables(data: bytes, at: int) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int, int]], int, bytes]:
    """Folders (first block, blocks, codec), files (name, size, place, folder), reserved bytes a block, and the flags.

    Raises where a table leaves the cabinet.
    """
    flags, here = _u(data, at + 30, 2), at + 36
    per_folder = per_block = 0
    if flags & 4:
        head, per_folder, per_block = _u(data, here, 2), _u(data, here + 2, 1), _u(data, here + 3, 1)
        here += 4 + head
    for bit in (1, 2):
        for _ in range(2 if flags & bit else 0):
            here = data.index(b"\0", here) + 1
    folders = []
    for _ in range(_u(data, at + 26, 2)):
        folders.append((_u(data, here, 4), _u(data, here + 4, 2), _u(data, here + 6, 2)))
        here += 8 + per_folder
    here, files = at + _u(data, at + 16, 4), []
    for _ in range(_u(data, at + 28, 2)):
        size, place, folder = _u(data, here, 4), _u(data, here + 4, 4), _u(data, here + 8, 2)
        end = data.index(b"\0", here + 16)
        utf8 = _u(data, here + 14, 2) & 0x80
        files.append((data[here + 16 : end].decode("utf-8" if utf8 else "latin-1", "replace"), size, place, folder))
        here = end + 1
    return folders, files, per_block, flags


@_validator
def cab(data, f, fields):
    """VAL-2: the folder and file tables can be read, and the cabinet ends where it says."""
    folders, files, _, flags = cab_tables(data, f.offset)
    avail, size = len(data) - f.offset, fields["cb_cabinet"]
    if not folders or not files or size > avail + 4096 or any(k < 0xFFFD and k >= len(folders) for *_, k in files):
        return False
    f.compression = "+".join(sorted({("none", "mszip", "quantum", "lzx")[c & 3] for *_, c in folders}))
    f.version, f.label = f"{data[f.offset + 25]}.{data[f.offset + 24]}", f"{len(folders)} folders, {len(files)} files"
    if flags & 3:
        f.diagnostics.append(("warning", "cab-spanned", "one cabinet of a set; files that go on in another can't be completed from it"))
    return _set(f, VERIFIED if size == avail else CONSISTENT, min(size, avail))


@_validator
def esp32_partition_table(data, f, fields):
    """VAL-9: 32-byte entries up to a digest or erased flash; partitions as members."""
    if f.offset % 4096:
        return False
    at, known = f.offset, 0
    while len(f.members) < 95 and data[at : at + 2] == b"\xaa\x50":
        kind, start, size = data[at + 2], _u(data, at + 4, 4), _u(data, at + 8, 4)
        name = data[at + 12 : at + 28].split(b"\0")[0]
        if not size or not re.fullmatch(rb"[\x20-\x7e]*", name):
            return False
        known += kind in (0, 1)
        f.members.append(Member(name.decode(), start, size, {0: "app", 1: "data"}.get(kind, f"type 0x{kind:02x}")))
        at += 32
    rest = sorted(f.members, key=lambda m: m.offset)
    apart = all(a.offset + a.size <= b.offset for a, b in builtins.zip(rest, rest[1:]))
    ended = data[at : at + 2] in (b"\xeb\xeb", b"\xff\xff") or at >= len(data)
    ok = ended and apart and len(rest) >= 2 and known >= 2 and any(m.offset < len(data) for m in rest)
    return ok and _set(f, CONSISTENT, at - f.offset + 32 * (data[at : at + 2] == b"\xeb\xeb"))


@_validator
def esp32_nvs(data, f, fields):
    """VAL-8: pages whose header and written entries all have the right CRC."""
    pages, at = 0, f.offset
    while data[at : at + 4] in (b"\xfe\xff\xff\xff", b"\xfc\xff\xff\xff", b"\xf8\xff\xff\xff") and at + 4096 <= len(data):
        if checksums.crc32_nvs(data[at + 4 : at + 28]) != _u(data, at + 28, 4):
            break
        states, entry, good = _u(data, at + 32, 32), 0, True
        while entry < 126 and good:
            span = 1
            if states >> 2 * entry & 3 == 2:
                e = data[at + 64 + 32 * entry : at + 96 + 32 * entry]
                good = checksums.crc32_nvs(e[:4] + e[8:]) == _u(e, 4, 4)
                span = max(1, e[2])
            entry += span
        if not good:
            break
        pages, at = pages + 1, at + 4096
    while pages and data[at : at + 4096] == b"\xff" * 4096:
        at += 4096
    return pages > 0 and _set(f, VERIFIED, at - f.offset)


@_validator
def littlefs(data, f, fields):
    """VAL-21: the commit of the superblock, tag by tag, up to its CRC."""
    at, before, block, count = f.offset + 4, 0xFFFFFFFF, 0, 0
    while at < f.offset + 4096:
        tag = _u(data, at, 4, "big") ^ before
        kind, size = tag >> 20 & 0x7FF, tag & 0x3FF
        size = 0 if size == 0x3FF else size
        if kind & 0x700 == 0x500:
            good = checksums.crc32_ubi(data[f.offset : at + 4]) == _u(data, at + 4, 4)
            return good and block > 0 and _set(f, VERIFIED, min(block * count, len(data) - f.offset))
        if kind == 0x201 and size >= 12:
            version, block, count = _u(data, at + 4, 4), _u(data, at + 8, 4), _u(data, at + 12, 4)
            f.version = f"{version >> 16}.{version & 0xFFFF}"
        before, at = tag, at + 4 + size
    return False


#: Sizes that an environment block may have, and how far its entries may reach from one of them.
_ENV_SIZES, _ENV_REACH = tuple(1 << k for k in range(12, 22)), 2 << 20
_ENV_ENTRY = re.compile(rb"[A-Za-z0-9_]+=[\x20-\x7e\t\n\r]*")
_ENV_NO_TEXT = re.compile(rb"[^\x20-\x7e\t\n\r]")


def _env_start(data: bytes, anchor: int) -> int:
    """Where the first of the entries before a separator begins."""
    start, sep, least = anchor + 1, anchor, max(0, anchor - _ENV_REACH)
    while sep > least:
        first = sep
        while first > least:  # back over text, a stretch at a time
            step = max(least, first - 256)
            bad = [m.end() for m in _ENV_NO_TEXT.finditer(data, step, first)]
            if bad:
                first = step + bad[-1] - step
                break
            first = step
        if not _ENV_ENTRY.fullmatch(data, first, sep):
            break
        start = first
        if first == 0 or data[first - 1]:
            break
        sep = first - 1
    return start


@_validator
def uboot_env(data, f, fields):
    """VAL-36: from an entry inside the list to its first and its end, then the CRC over the sizes that are in use."""
    start = _env_start(data, f.offset)
    at, n, most = start, 0, min(start + _ENV_REACH, len(data))
    while at < most and data[at]:
        end = data.find(b"\0", at, most)
        if end < 0 or not _ENV_ENTRY.fullmatch(data, at, end):
            return False
        at, n = end + 1, n + 1
    if at >= most or n < 4:
        return False
    for first in range(start, min(start + 6, at + 1)):  # a byte of the header may look like a key's first
        for head in (4, 5):
            base = first - head
            if base < 0:
                continue
            want = _u(data, base, 4)
            for size in (*_ENV_SIZES, at + 1 - base):
                if head < size <= len(data) - base and checksums.crc32(data[first : base + size]) == want:
                    return _set(f, VERIFIED, size, offset=base, label="redundant" if head == 5 else "")
    f.diagnostics.append(("info", "uboot-env-crc-unverified", "no size in use gives the header's checksum, so the block's extent is approximate"))
    head = 4 if start >= 4 else 0
    return _set(f, STRUCTURAL, at + 1 - start + head, offset=start - head)


@_validator
def vbf(data, f, fields):
    """VAL-40: the text header, then blocks of address, length, bytes and CRC-16."""
    depth, at = 0, data.find(b"{", f.offset)
    if not 0 <= at - f.offset <= 4096:
        return False
    while True:
        depth += (data[at] == ord("{")) - (data[at] == ord("}"))
        at += 1
        if not depth:
            break
        if at - f.offset > 1 << 20:
            return False
    blocks, good, head = 0, True, at
    while at + 10 <= len(data):
        size = _u(data, at + 4, 4, "big")
        if not size or at + 10 + size > len(data):
            break
        good &= checksums.crc16_ccitt(data[at + 8 : at + 8 + size]) == _u(data, at + 8 + size, 2, "big")
        blocks, at = blocks + 1, at + 10 + size
    said = lambda key: (re.search(key + rb"\s*=\s*\"?([^\";]*)", data[f.offset : head]) or (b"", b""))[1].decode("latin-1")
    f.version, f.label = said(rb"vbf_version").strip(), said(rb"sw_part_number").strip()
    kind = said(rb"data_format_identifier").strip()
    packed = bool(re.fullmatch("0x[0-9A-Fa-f]{1,2}", kind)) and int(kind, 16) >> 4 != 0
    f.compression = "lzss" if packed else "none"
    return _set(f, VERIFIED if blocks and good and not packed else CONSISTENT if blocks else STRUCTURAL, (at if blocks else head) - f.offset)


@_validator
def deobf(data, f, fields):
    """VAL-5, DSC-9: a key that fits makes a scrambled image sure; a header alone doesn't."""
    found = schemes.probe(data, f.offset)
    if not found:
        return False
    f.compression = found.cipher if found.holds else ""
    if not found.holds:
        f.diagnostics.append(("warning", "scheme-no-key", "the header is there, but no known key opens it"))
    return _set(f, VERIFIED if found.holds else STRUCTURAL, min(found.span, len(data) - f.offset), type=found.scheme, label=found.holds)
