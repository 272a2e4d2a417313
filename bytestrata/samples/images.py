"""Builders: each returns the bytes of one image. Nothing random, nothing of today's date."""

from __future__ import annotations

import hashlib
import io
import lzma
import struct
import tarfile
import zipfile
import zlib

import zstandard

from ..functions import checksums

#: What most images hold.
FILES = {"etc/conf": b"a = 1\n" * 20, "readme": b"hello " * 30}


def put(size: int, parts: dict[int, bytes]) -> bytes:
    """Zeros with something at some places."""
    out = bytearray(size)
    for at, raw in parts.items():
        out[at : at + len(raw)] = raw
    return bytes(out)


# Archives and streams


def tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, body in FILES.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "etc/conf"
        t.addfile(link)
    return out.getvalue()


def zip_() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in FILES.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def cpio() -> bytes:
    out = b""
    for k, (name, mode, body) in enumerate([*((n, 0o100644, b) for n, b in FILES.items()), ("link", 0o120777, b"readme"), ("TRAILER!!!", 0, b"")]):
        head = b"070701" + b"%08x" * 13 % (k + 1, mode, 0, 0, 1, 0, len(body), 0, 0, 0, 0, len(name) + 1, 0)
        raw = head + name.encode() + b"\0"
        out += raw.ljust((len(raw) + 3) // 4 * 4, b"\0") + body.ljust((len(body) + 3) // 4 * 4, b"\0")
    return out


def gzip_(body: bytes = b"abc" * 99) -> bytes:
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\0\0\0\0\0\2\xff" + raw.compress(body) + raw.flush() + struct.pack("<II", zlib.crc32(body), len(body))


def xz() -> bytes:
    return lzma.compress(b"abc" * 99)


def lzma_alone(body: bytes = bytes(range(256)) * 40) -> bytes:
    return lzma.compress(body, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}])


def zstd() -> bytes:
    return zstandard.ZstdCompressor(write_checksum=False).compress(b"abc" * 99)


def lz4() -> bytes:
    block = bytes([0x33]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z"
    return b"\x04\x22\x4d\x18\x60\x40\x82" + struct.pack("<I", len(block)) + block + struct.pack("<I", 0x80000003) + b"raw" + bytes(4)


def lz4_legacy() -> bytes:
    block = bytes([0x1F]) + b"a" + bytes([1, 0, 255, 1])
    return b"\x02\x21\x4c\x18" + struct.pack("<I", len(block)) + block


def ihex() -> bytes:
    return b":03000000010203F7\n:0200030004052F\n:00000001FF\n"


def vbf() -> bytes:
    block = lambda a, d: struct.pack(">II", a, len(d)) + d + struct.pack(">H", checksums.crc16_ccitt(d))
    return b'vbf_version = 2.6;\nheader { sw_part_number = "1"; erase = { {1,2} }; }' + block(0, b"abc") + block(16, b"defg")


# Boot images


def uimage(payload: bytes | None = None, good: bool = True, codec: int = 1) -> bytes:
    payload = gzip_(b"kernel" * 20) if payload is None else payload
    head = struct.pack(">7I4B32s", 0x27051956, 0, 1, len(payload), 0, 0, zlib.crc32(payload), 5, 5, 2, codec, b"Linux")
    return head[:4] + struct.pack(">I", zlib.crc32(head) if good else 1) + head[8:] + payload


def android_boot() -> bytes:
    head = struct.pack("<8s8I", b"ANDROID!", 5, 0, 3, 0, 0, 0, 0, 2048) + struct.pack("<I", 0)
    return head.ljust(2048, b"\0") + b"kerne".ljust(2048, b"\0") + b"ram".ljust(2048, b"\0")


def android_sparse() -> bytes:
    chunk = lambda kind, blocks, body: struct.pack("<HHII", kind, 0, blocks, 12 + len(body)) + body
    return struct.pack("<IHHHHIIII", 0xED26FF3A, 1, 0, 28, 12, 4096, 4, 3, 0) + chunk(0xCAC1, 1, b"raw!" * 1024) + chunk(0xCAC2, 1, b"fill") + chunk(0xCAC3, 2, b"")


def fit() -> bytes:
    names = b"data\0"
    begin = lambda n: struct.pack(">I", 1) + (n + b"\0").ljust((len(n) + 4) // 4 * 4, b"\0")
    prop = lambda v: struct.pack(">III", 3, len(v), 0) + v.ljust((len(v) + 3) // 4 * 4, b"\0")
    end = struct.pack(">I", 2)
    body = begin(b"") + begin(b"images") + begin(b"kernel-1") + prop(b"payload") + end + end + end + struct.pack(">I", 9)
    return struct.pack(">10I", 0xD00DFEED, 40 + len(body) + len(names), 40, 40 + len(body), 40, 17, 16, 0, len(names), len(body)) + body + names


def dtb() -> bytes:
    body = struct.pack(">I", 1) + bytes(4) + struct.pack(">II", 2, 9)
    return struct.pack(">10I", 0xD00DFEED, 40 + len(body) + 16, 40, 40 + len(body), 40, 17, 16, 0, 0, len(body)) + body + bytes(16)


def uefi_fv() -> bytes:
    head = bytearray(struct.pack("<16s16sQ4sIHHHBB", b"", bytes(range(16)), 4096, b"_FVH", 0, 72, 0, 0, 0, 2).ljust(72, b"\0"))
    struct.pack_into("<H", head, 50, -sum(struct.unpack("<36H", head)) & 0xFFFF)
    return bytes(head).ljust(4096, b"\xff")


def vbmeta() -> bytes:
    """A hash descriptor of a partition, two properties, and a key."""
    prop = lambda k, v: _descriptor(0, struct.pack(">QQ", len(k), len(v)) + k + b"\0" + v + b"\0")
    hash_ = _descriptor(2, struct.pack(">Q32sIIII60x", 4096, b"sha256", 4, 2, 3, 0) + b"boot" + b"sa" + b"\1\2\3")
    parts = prop(b"os", b"linux") + hash_
    aux = parts.ljust((len(parts) + 63) // 64 * 64, b"\0") + b"k" * 64
    fields = [0, 0, 0, 0, len(aux) - 64, 64, 0, 0, 0, len(parts)]
    head = struct.pack(">4sIIQQI", b"AVB0", 1, 0, 64, len(aux), 1) + struct.pack(">10Q", *fields) + struct.pack(">QII", 0, 0, 0) + b"avbtool 1.2.0"
    return head.ljust(256, b"\0") + b"s" * 64 + aux


def _descriptor(tag: int, body: bytes) -> bytes:
    body = body.ljust((len(body) + 7) // 8 * 8, b"\0")
    return struct.pack(">QQ", tag, len(body)) + body


def uboot_env() -> bytes:
    body = b"arch=arm\0bootcmd=run x\0baudrate=115200\0bootdelay=3\0ipaddr=10.0.0.1\0\0".ljust(4092, b"\xff")
    return b"\xff" * 512 + struct.pack("<I", zlib.crc32(body)) + body


def mtk_lk() -> bytes:
    return (struct.pack("<II", 0x58881688, 700) + b"lk".ljust(32, b"\0")).ljust(512, b"\xff") + bytes(700)


# Partition tables


def gpt() -> bytes:
    table = put(128 * 128, {0: bytes(range(1, 33)) + struct.pack("<QQQ", 40, 47, 0) + "rootfs".encode("utf-16-le")})
    head = b"EFI PART" + struct.pack("<IIIIQQQQ16sQIII", 0x10000, 92, 0, 0, 1, 99, 34, 98, bytes(16), 2, 128, 128, zlib.crc32(table))
    return put(100 * 512, {512: head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:], 1024: table})


def mbr() -> bytes:
    entry = struct.pack("<BBBBBBBBII", 0x80, 0, 0, 0, 0x83, 0, 0, 0, 4, 8)
    logical = struct.pack("<BBBBBBBBII", 0, 0, 0, 0, 0x83, 0, 0, 0, 1, 6)
    return put(40 * 512, {446: entry + struct.pack("<BBBBBBBBII", 0, 0, 0, 0, 0x05, 0, 0, 0, 16, 20), 510: b"\x55\xaa", 16 * 512 + 446: logical, 16 * 512 + 510: b"\x55\xaa"})


def esp32_table() -> bytes:
    entry = lambda k, s, at, n, name: struct.pack("<2sBBII16sI", b"\xaa\x50", k, s, at, n, name, 0)
    rows = entry(1, 2, 0x9000, 0x6000, b"nvs") + entry(0, 0, 0x10000, 0x100000, b"factory")
    return bytes(0x8000) + rows + b"\xeb\xeb" + b"\xff" * 14 + hashlib.md5(rows).digest() + b"\xff" * 0x3000


# File systems


def romfs() -> bytes:
    def member(name: bytes, kind: int, info: int, body: bytes, at: int, last: bool) -> bytes:
        raw = (name + b"\0").ljust((len(name) + 16) // 16 * 16, b"\0")
        size = 16 + len(raw) + (len(body) + 15) // 16 * 16
        return struct.pack(">IIII", (0 if last else at + size) | kind, info, len(body), 0) + raw + body.ljust((len(body) + 15) // 16 * 16, b"\0")

    out = b"-rom1fs-" + bytes(8) + b"sample".ljust(16, b"\0")
    out += member(b"readme", 2, 0, FILES["readme"], len(out), False)
    at = len(out)
    out += member(b"etc", 1, at + 32, b"", at, True)
    out += member(b"conf", 2, 0, FILES["etc/conf"], len(out), True)
    return out[:8] + struct.pack(">II", len(out), 0) + out[16:]


def cramfs(order: str = "<", files: dict[str, bytes] | None = None) -> bytes:
    files = files or {"large": bytes(range(256)) * 50, "readme": FILES["readme"]}
    names = {k: k.encode().ljust((len(k) + 3) // 4 * 4, b"\0") for k in files}
    at = 76 + sum(12 + len(n) for n in names.values())
    entries, bodies = b"", b""

    def inode(mode: int, size: int, name: int, offset: int) -> bytes:
        return struct.pack("<HHII", mode, 0, size, name | offset << 6) if order == "<" else struct.pack(">HHII", mode, 0, size << 8, name << 26 | offset)

    for k, v in sorted(files.items()):
        blocks = [zlib.compress(v[i : i + 4096]) for i in range(0, len(v), 4096)]
        start = at + len(bodies)
        ends, here = [], start + 4 * len(blocks)
        for b in blocks:
            here += len(b)
            ends.append(here)
        body = struct.pack(f"{order}{len(ends)}I", *ends) + b"".join(blocks)
        entries += inode(0o100644, len(v), len(names[k]) // 4, start // 4) + names[k]
        bodies += body.ljust((len(body) + 3) // 4 * 4, b"\0")
    head = struct.pack(order + "IIII16sIIII16s", 0x28CD3D45, at + len(bodies), 0, 0, b"Compressed ROMFS", 0, 0, 1, len(files) + 1, b"x")
    return head + inode(0o040755, len(entries), 0, 19) + entries + bodies


def squashfs(order: str = "<", codec: int = 1, pack=zlib.compress) -> bytes:
    files = {"large": bytes(range(256)) * 50, "readme": FILES["readme"]}
    block, out, frag, inodes, listing = 4096, bytearray(96), b"", b"", b""
    for k, (name, body) in enumerate(sorted(files.items())):
        sizes, start = [], len(out)
        for i in range(0, len(body) // block * block, block):
            raw = pack(body[i : i + block])
            out += raw
            sizes.append(len(raw))
        rest, place = body[len(body) // block * block :], len(inodes)
        inodes += struct.pack(order + "HHHHII", 2, 0o644, 0, 0, 0, k + 2) + struct.pack(order + "IIII", start, 0 if rest else 0xFFFFFFFF, len(frag), len(body)) + struct.pack(f"{order}{len(sizes)}I", *sizes)
        frag += rest
        listing += struct.pack(order + "HhHH", place, k, 2, len(name) - 1) + name.encode()
    listing = struct.pack(order + "III", len(files) - 1, 0, 2) + listing
    root = len(inodes)
    inodes += struct.pack(order + "HHHHII", 1, 0o755, 0, 0, 0, 1) + struct.pack(order + "IIHHI", 0, 2, len(listing) + 3, 0, 99)
    meta = lambda raw: struct.pack(order + "H", len(pack(raw))) + pack(raw)
    places = []
    for raw in (pack(frag), meta(inodes), meta(listing)):
        places.append(len(out))
        out += raw
    frag_meta = len(out)
    out += meta(struct.pack(order + "QII", places[0], len(pack(frag)), 0))
    frag_table = len(out)
    out += struct.pack(order + "Q", frag_meta)
    id_table = len(out)
    out += bytes(8)
    out[:96] = struct.pack(order + "IIIIIHHHHHHQQQQQQQQ", 0x73717368, len(files) + 1, 0, block, 1, codec, 12, 0, 1, 4, 0, root, len(out), id_table, 2**64 - 1, places[1], places[2], frag_table, 2**64 - 1)
    return bytes(out)


def ext2() -> bytes:
    """Blocks of 1 KiB: a file of direct and indirect blocks, a directory, a short symbolic link."""
    blocks: dict[int, bytes] = {}
    free = 8

    def store(body: bytes) -> list[int]:
        nonlocal free
        places = []
        for i in range(0, len(body), 1024):
            blocks[free] = body[i : i + 1024]
            places.append(free)
            free += 1
        return places

    def inode(mode: int, body: bytes, links: int = 1) -> bytes:
        nonlocal free
        places = store(body)
        direct, rest = places[:12], places[12:]
        indirect = 0
        if rest:
            indirect = free
            blocks[free] = struct.pack(f"<{len(rest)}I", *rest)
            free += 1
        raw = struct.pack("<HHIIIIIHHIII", mode, 0, len(body), 0, 0, 0, 0, 0, links, 2 * len(places), 0, 0)
        return (raw + struct.pack("<15I", *(direct + [0] * (12 - len(direct))), indirect, 0, 0)).ljust(128, b"\0")

    def folder(entries: list[tuple[int, bytes, int]]) -> bytes:
        out = b""
        for k, (number, name, kind) in enumerate(entries):
            size = (8 + len(name) + 3) // 4 * 4 if k < len(entries) - 1 else 1024 - len(out)
            out += (struct.pack("<IHBB", number, size, len(name), kind) + name).ljust(size, b"\0")
        return out

    link = struct.pack("<HHIIIIIHHIII", 0o120777, 0, 8, 0, 0, 0, 0, 0, 1, 0, 0, 0) + b"etc/conf".ljust(60, b"\0")
    table = {12: inode(0o100644, FILES["etc/conf"]), 13: inode(0o100644, bytes(range(256)) * 60), 14: link.ljust(128, b"\0")}
    table[11] = inode(0o040755, folder([(11, b".", 2), (2, b"..", 2), (12, b"conf", 1)]), 2)
    table[2] = inode(0o040755, folder([(2, b".", 2), (2, b"..", 2), (11, b"etc", 2), (13, b"large", 1), (14, b"link", 7)]), 3)
    total = 64
    sb = struct.pack("<13I6H4I2H", 16, total, 0, 8, 2, 1, 0, 0, 8192, 8192, 16, 0, 0, 0, 20, 0xEF53, 1, 1, 0, 0, 0, 0, 1, 0, 0) + struct.pack("<IHHIII", 11, 128, 0, 0, 2, 0)
    parts = {1024: sb, 2048: struct.pack("<III3H", 3, 4, 5, total - free, 2, 2)}
    parts |= {5 * 1024 + 128 * (k - 1): raw for k, raw in table.items()} | {1024 * k: raw for k, raw in blocks.items()}
    return put(total * 1024, parts)


def fat16() -> bytes:
    clusters, bits = 5000, 16
    size = -(-(clusters + 2) * bits // 8 // 512) + 1
    boot = struct.pack("<3s8sHBHBHHBHHHII", b"\xeb\x3c\x90", b"x", 512, 1, 1, 1, 16, 0, 0xF8, size, 0, 0, 0, 1 + size + 1 + clusters)
    boot = put(512, {0: boot, 54: b"FAT16   ", 510: b"\x55\xaa"})
    raw = struct.pack("<7H", 0xFFF8, 0xFFFF, 3, 4, 0xFFFF, 0xFFFF, 0xFFFF).ljust(size * 512, b"\0")
    entry = lambda name, attr, c, n: struct.pack("<11sB8xHHHHI", name, attr, 0, 0, 0, c, n)
    long = "A long name.txt".encode("utf-16-le").ljust(52, b"\0")
    part = lambda k, last: bytes([k | 0x40 * last]) + long[26 * k - 26 : 26 * k - 16] + b"\x0f\0\0" + long[26 * k - 16 : 26 * k - 4] + b"\0\0" + long[26 * k - 4 : 26 * k]
    root = (entry(b"DATA    BIN", 0x20, 2, 1200) + entry(b"SUB        ", 0x10, 5, 0)).ljust(512, b"\0")
    sub = (entry(b".          ", 0x10, 5, 0) + part(2, 1) + part(1, 0) + entry(b"ALONGN~1TXT", 0x20, 6, 5)).ljust(512, b"\0")
    return boot + raw + root + (bytes(range(240)) * 5).ljust(1536, b"\0") + sub + b"hello".ljust(512, b"\0") + bytes(512 * (clusters - 5))


def iso9660() -> bytes:
    def record(start: int, size: int, flags: int, name: bytes, use: bytes = b"") -> bytes:
        raw = struct.pack("<BBI", 0, 0, start) + struct.pack(">I", start) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags, 0, 0]) + bytes(4) + bytes([len(name)]) + name
        raw += bytes(not len(name) & 1) + use
        raw += bytes(len(raw) & 1)
        return bytes([len(raw)]) + raw[1:]

    rock = lambda n: b"NM" + bytes([5 + len(n), 1, 0]) + n
    link = b"SL" + bytes([5 + 2 + 3, 1, 0, 0, 3]) + b"etc"
    files = record(18, 5, 0, b"README.TXT;1", rock(b"readme.txt")) + record(19, 2048, 2, b"SUB") + record(18, 0, 0, b"LINK.;1", rock(b"link") + link)
    root = record(17, 2048, 2, b"\0") + record(17, 2048, 2, b"\1") + files
    sub = record(19, 2048, 2, b"\0") + record(17, 2048, 2, b"\1") + record(18, 3, 0, b"A.BIN;1")
    top = (b"\1CD001\1" + bytes(149) + record(17, 2048, 2, b"\0")).ljust(2048, b"\0")
    return bytes(16 * 2048) + top + root.ljust(2048, b"\0") + b"hello".ljust(2048, b"\0") + sub.ljust(2048, b"\0")


def jffs2() -> bytes:
    def node(kind: int, body: bytes) -> bytes:
        head = struct.pack("<HHI", 0x1985, kind, 12 + len(body))
        raw = head + struct.pack("<I", checksums.crc32_jffs2(head)) + body
        return raw.ljust((len(raw) + 3) // 4 * 4, b"\xff")

    def entry(parent: int, version: int, inode: int, name: bytes) -> bytes:
        return node(0xE001, struct.pack("<IIIIBBHII", parent, version, inode, 0, len(name), 8, 0, 0, 0) + name)

    def part(inode: int, version: int, mode: int, size: int, offset: int, body: bytes, codec: int) -> bytes:
        raw = zlib.compress(body) if codec == 6 else body
        return node(0xE002, struct.pack("<IIIHHIIIIIIIBBHII", inode, version, mode, 0, 0, size, 0, 0, 0, offset, len(raw), len(body), codec, codec, 0, 0, 0) + raw)

    out = entry(1, 1, 2, b"etc") + part(2, 1, 0o040755, 0, 0, b"", 0) + entry(2, 1, 3, b"conf") + part(3, 1, 0o100644, 3, 0, b"old", 0) + part(3, 2, 0o100644, 500, 0, b"new" * 100, 6) + part(3, 3, 0o100644, 500, 300, b"z" * 200, 0)
    return out + entry(1, 2, 4, b"link") + part(4, 1, 0o120777, 8, 0, b"etc/conf", 0) + entry(1, 3, 5, b"gone") + part(5, 1, 0o100644, 1, 0, b"x", 0) + entry(1, 4, 0, b"gone")


PEB, VID, BODY, LAYOUT = 8192, 512, 2048, 0x7FFFEFFF


def peb(volume: int | None = None, number: int = 0, order: int = 0, body: bytes = b"") -> bytes:
    head = struct.pack(">4sB3xQII", b"UBI#", 1, 0, VID, BODY).ljust(60, b"\0")
    out = (head + struct.pack(">I", checksums.crc32_ubi(head))).ljust(VID, b"\xff")
    if volume is not None:
        vid = (struct.pack(">4sBBBBII", b"UBI!", 1, 1, 0, 0, volume, number).ljust(40, b"\0") + struct.pack(">Q", order)).ljust(60, b"\0")
        out += vid + struct.pack(">I", checksums.crc32_ubi(vid))
    return out.ljust(BODY, b"\xff") + body.ljust(PEB - BODY, b"\xff")


def ubi_table(*names: bytes) -> bytes:
    out = b""
    for name in names:
        r = struct.pack(">IIIBBH128s", 1, 1, 0, 1, 0, len(name), name).ljust(168, b"\0")
        out += r + struct.pack(">I", checksums.crc32_ubi(r))
    return out


def ubi() -> bytes:
    """Two volumes; a key in a block of the second, and one in a free block."""
    key = b"-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----\n"
    return peb(LAYOUT, 0, 1, ubi_table(b"kernel", b"rootfs")) + peb(1, 0, 2, b"old") + peb(1, 0, 3, b"new" + key) + peb(0, 1, 4, b"second") + peb(0, 0, 5, b"first") + peb(body=b"free" + key)


def _ubifs_node(kind: int, order: int, body: bytes) -> bytes:
    raw = struct.pack("<QIB3x", order, 24 + len(body), kind) + body
    return (b"\x31\x18\x10\x06" + struct.pack("<I", checksums.crc32_ubi(raw)) + raw).ljust((24 + len(body) + 7) // 8 * 8, b"\0")


def ubifs() -> bytes:
    def inode(order: int, number: int, mode: int, size: int, inline: bytes = b"") -> bytes:
        return _ubifs_node(0, order, struct.pack("<II8xQQ", number, 0, 0, size).ljust(80, b"\0") + struct.pack("<III", mode, 0, len(inline)).ljust(56, b"\0") + inline)

    def block(order: int, number: int, k: int, body: bytes, codec: int) -> bytes:
        raw = zlib.compressobj(9, zlib.DEFLATED, -15)
        return _ubifs_node(1, order, struct.pack("<II8xIHH", number, 1 << 29 | k, len(body), codec, 0) + (raw.compress(body) + raw.flush() if codec == 2 else body))

    def entry(order: int, parent: int, target: int, name: bytes) -> bytes:
        return _ubifs_node(2, order, struct.pack("<II8xQBBHI", parent, 2 << 29, target, 0, 0, len(name), 0) + name + b"\0")

    out = inode(1, 1, 0o040755, 0) + entry(2, 1, 2, b"etc") + inode(3, 2, 0o040755, 0) + entry(4, 2, 3, b"conf") + inode(5, 3, 0o100644, 5000)
    out += block(6, 3, 0, b"a" * 4096, 2) + block(7, 3, 1, b"b" * 904, 0) + block(8, 3, 1, b"c" * 904, 0) + entry(9, 1, 4, b"link") + inode(10, 4, 0o120777, 8, b"etc/conf")
    return out + entry(11, 1, 5, b"gone") + inode(12, 5, 0o100644, 1) + entry(13, 1, 0, b"gone") + block(14, 5, 0, b"x", 0)


def littlefs() -> bytes:
    out, before = bytearray(struct.pack("<I", 1)), 0xFFFFFFFF

    def tag(kind: int, id_: int, body: bytes) -> None:
        nonlocal before
        t = kind << 20 | id_ << 10 | len(body)
        out.extend(struct.pack(">I", t ^ before) + body)
        before = t

    tag(0x0FF, 0, b"littlefs")
    tag(0x201, 0, struct.pack("<6I", 0x20000, 4096, 4, 255, 2**31 - 1, 1022))
    out.extend(struct.pack(">I", (0x500 << 20 | 0x3FF << 10 | 4) ^ before))
    out.extend(struct.pack("<I", checksums.crc32_ubi(bytes(out))))
    return bytes(out).ljust(4 * 4096, b"\xff")


def esp32_nvs() -> bytes:
    """A namespace, a number and a text in it."""

    def entry(ns: int, kind: int, span: int, key: bytes, body: bytes) -> bytes:
        e = bytearray(struct.pack("<BBBBI16s8s", ns, kind, span, 255, 0, key, body))
        e[4:8] = struct.pack("<I", checksums.crc32_nvs(bytes(e[:4] + e[8:])))
        return bytes(e)

    text = b"my network\0"
    rows = [entry(0, 1, 1, b"wifi", b"\1" + b"\xff" * 7), entry(1, 4, 1, b"channel", struct.pack("<I4s", 11, b"\xff" * 4)), entry(1, 0x21, 2, b"ssid", struct.pack("<HHI", len(text), 0xFFFF, checksums.crc32_nvs(text))), text.ljust(32, b"\xff")]
    head = struct.pack("<IIB19s", 0xFFFFFFFE, 0, 0xFE, b"\xff" * 19)
    head += struct.pack("<I", checksums.crc32_nvs(head[4:28]))
    states = 0
    for k in range(126):
        states |= (2 if k < len(rows) else 3) << 2 * k
    return head + (states | 0xF << 252).to_bytes(32, "little") + b"".join(rows).ljust(126 * 32, b"\xff")


def nilfs2() -> bytes:
    sb = bytearray(struct.pack("<IHHHHIIIQQ", 2, 0, 0, 0x3434, 0x100, 0, 7, 0, 1, 65536).ljust(0x100, b"\0"))
    sb = bytearray(struct.pack("<IHHHHIIIQQ", 2, 0, 0x3434, 0x100, 0, 7, 0, 2, 4, 65536).ljust(0x100, b"\0"))
    struct.pack_into("<I", sb, 16, checksums.crc32_raw(bytes(sb[:16]) + bytes(4) + bytes(sb[20:]), 7))
    return put(65536, {1024: bytes(sb)})


def minix() -> bytes:
    return put(64 * 1024, {1024: struct.pack("<6HIHH", 32, 64, 1, 1, 5, 0, 0x10081C00, 0x137F, 1)})


def reiserfs() -> bytes:
    return put(160 * 1024, {65536: struct.pack("<I", 20), 65536 + 44: struct.pack("<H", 4096), 65536 + 52: b"ReIsEr2Fs\0"})


def ufs() -> bytes:
    return put(16384, {8192 + 48: struct.pack("<II", 8192, 1024), 8192 + 1372: b"\x54\x19\x01\x00"})


def apfs() -> bytes:
    return put(16 * 4096, {32: b"NXSB" + struct.pack("<IQ", 4096, 16)})


def luks1() -> bytes:
    return put(4096, {0: b"LUKS\xba\xbe" + struct.pack(">H", 1), 8: b"aes", 40: b"xts-plain64", 72: b"sha256", 104: struct.pack(">II", 4096, 64), 168: b"01234567-89ab-cdef-0123-456789abcdef"})


def luks2() -> bytes:
    js = b'{"keyslots":{},"segments":{"0":{"encryption":"aes-xts-plain64"}},"digests":{}}'
    return put(16384, {0: b"LUKS\xba\xbe" + struct.pack(">HQQ", 2, 16384, 1), 24: b"label", 72: b"sha256", 168: b"01234567-89ab-cdef-0123-456789abcdef", 4096: js})


def erofs() -> bytes:
    return put(8 * 4096, {1024: b"\xe2\xe1\xf5\xe0", 1036: b"\x0c", 1038: struct.pack("<H", 36), 1060: struct.pack("<I", 8)})


def f2fs() -> bytes:
    return put(8192, {1024: b"\x10\x20\xf5\xf2", 1040: struct.pack("<II", 9, 2), 1072: struct.pack("<I", 4)})


def hfsplus() -> bytes:
    return put(8 * 4096, {1024: b"H+\0\4", 1064: struct.pack(">II", 4096, 8)})


def xfs() -> bytes:
    return put(8 * 4096, {0: b"XFSB" + struct.pack(">IQ", 4096, 8), 56: struct.pack(">Q", 128), 84: struct.pack(">II", 8, 1), 100: struct.pack(">HHH", 0xB4A5, 512, 512)})


def btrfs() -> bytes:
    return put(131072, {65600: b"_BHRfS_M", 65648: struct.pack("<Q", 131072), 65680: struct.pack("<II", 4096, 16384)})


def exfat() -> bytes:
    return put(4096, {3: b"EXFAT   ", 80: struct.pack("<IIII", 24, 8, 64, 128)})


def fat32() -> bytes:
    return put(64 * 512, {0: b"\xeb\x58\x90", 11: struct.pack("<HB", 512, 1), 16: b"\2", 32: struct.pack("<I", 64), 82: b"FAT32   "})


def sxverity() -> bytes:
    return b"".join((b"sxverity" + bytes([k])).ljust(1024, b"\0") for k in range(4)) + romfs()


def verity() -> bytes:
    head = struct.pack("<8sII16s32sIIQH", b"verity\0\0", 1, 1, bytes(range(16)), b"sha256", 4096, 4096, 200, 32)
    return head.ljust(4096, b"\0") + bytes(4 * 4096)


# Programs, pictures and the rest


def elf() -> bytes:
    return b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0) + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 200, 200, 4096) + bytes(80)


def upx() -> bytes:
    head = bytearray(b"UPX!" + bytes([13, 22, 8, 9]) + struct.pack("<5I", 1, 2, 3000, 1000, 4000) + bytes([0, 0, 0, 0]))
    head[31] = sum(head[4:31]) % 251
    return b"\x90" * 64 + bytes(head) + b"\x90" * 64


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0")) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0\2\2\x4c\1\0\x3b"


def jpeg() -> bytes:
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0\x55\xff\xd9"


def bmp() -> bytes:
    return (b"BM" + struct.pack("<IIII", 58, 0, 54, 40)).ljust(58, b"\0")


def cab(codec: int = 1) -> bytes:
    """Two files in one folder, of one compressed block."""
    body = FILES["etc/conf"] + FILES["readme"]
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = b"CK" + deflate.compress(body) + deflate.flush() if codec == 1 else body
    rows = struct.pack("<IIHHHH", 120, 0, 0, 0, 0, 32) + b"etc\\conf\0" + struct.pack("<IIHHHH", 180, 120, 0, 0, 0, 32) + b"readme\0"
    total = 44 + len(rows) + 8 + len(raw)
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, total, 0, 44, 0, 3, 1, 1, 2, 0, 1, 0) + struct.pack("<IHH", 44 + len(rows), 1, codec)
    return head + rows + struct.pack("<IHH", 0, len(raw), len(body)) + raw


#: Every sample by name: what is to be identified.
SAMPLES = {
    "gpt.bin": gpt, "mbr.bin": mbr, "esp32_part.bin": esp32_table, "esp32_nvs.bin": esp32_nvs, "littlefs.bin": littlefs, "nilfs2.bin": nilfs2, "minix.bin": minix, "reiserfs.bin": reiserfs, "ufs.bin": ufs, "apfs.bin": apfs,
    "logfs.bin": lambda: b"\x7a\x3a\x8e\x5c\xb9\xd5\xbf\x67" + bytes(504), "luks1.bin": luks1, "luks2.bin": luks2, "squashfs.bin": squashfs, "squashfs_be.bin": lambda: squashfs(">", 4, lzma.compress), "ext.bin": ext2, "erofs.bin": erofs, "f2fs.bin": f2fs,
    "hfsplus.bin": hfsplus, "xfs.bin": xfs, "btrfs.bin": btrfs, "iso9660.bin": iso9660, "exfat.bin": exfat, "fat16.bin": fat16, "fat32.bin": fat32, "cramfs.bin": cramfs, "cramfs_be.bin": lambda: cramfs(">"), "romfs.bin": romfs, "image.sxv": sxverity,
    "jffs2.bin": jffs2, "ubi.bin": ubi, "ubifs.bin": ubifs, "device.dtb": dtb, "image.fit": fit, "kernel.uimage": uimage, "kernel_bad.uimage": lambda: uimage(good=False), "blob.gz": gzip_, "blob.xz": xz, "xz_bad_crc.bin": lambda: b"\xfd7zXZ\0\0\4" + bytes(24),
    "blob.lz4": lz4, "blob.lz4l": lz4_legacy, "blob.zst": zstd, "blob.lzma": lzma_alone, "initramfs.cpio": cpio, "archive.tar": tar, "archive.7z": lambda: b"7z\xbc\xaf\x27\x1c\0\4" + bytes(24), "archive.rar": lambda: b"Rar!\x1a\7\0" + bytes(25),
    "blob.bz2": lambda: b"BZh91AY&SY" + bytes(22), "prog64.elf": elf, "prog.upx": upx, "boot.img": android_boot, "super.sparse": android_sparse, "pieeprom.bin": lambda: b"\x55\xaa\xf0\x0f" + struct.pack(">I", 16) + bytes(24), "lk.mtk": mtk_lk,
    "u-boot.bin": lambda: b"U-Boot 2020.01 (Jan 01 2020)".ljust(64, b"\0"), "uboot.env": uboot_env, "vbmeta.img": vbmeta, "firmware.fv": uefi_fv, "hashtree.verity": verity, "firmware.hex": ihex, "image.png": lambda: png() + b"tail", "image.gif": gif, "image.bmp": bmp,
    "image.jpg": jpeg, "doc.pdf": lambda: b"%PDF-1.4\n" + b"1 0 obj\n" * 4, "archive.zip": zip_, "id_ed25519": lambda: b"-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----\n", "server.crt": lambda: b"-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n", "install.cab": cab,
    "fw.vbf": vbf, "config.txt": lambda: b"key = value\nother = 1\n" * 20, "short.bin": lambda: b"abc", "empty.bin": lambda: b"",
}
