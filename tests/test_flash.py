import struct
import zlib

from bytestrata.functions import checksums
from bytestrata.operators import extract, flash

PEB, VID, BODY = 8192, 512, 2048


def peb(volume=None, number=0, order=0, body=b""):
    head = struct.pack(">4sB3xQII", b"UBI#", 1, 0, VID, BODY).ljust(60, b"\0")
    out = (head + struct.pack(">I", checksums.crc32_ubi(head))).ljust(VID, b"\xff")
    if volume is not None:
        vid = (struct.pack(">4sBBBBII", b"UBI!", 1, 1, 0, 0, volume, number).ljust(40, b"\0") + struct.pack(">Q", order)).ljust(60, b"\0")
        out += vid + struct.pack(">I", checksums.crc32_ubi(vid))
    return out.ljust(BODY, b"\xff") + body.ljust(PEB - BODY, b"\xff")


def table(*names):
    out = b""
    for name in names:
        r = struct.pack(">IIIBBH128s", 1, 1, 0, 1, 0, len(name), name).ljust(168, b"\0")
        out += r + struct.pack(">I", checksums.crc32_ubi(r))
    return out


def image():
    return peb(flash.LAYOUT, 0, 1, table(b"kernel", b"rootfs")) + peb(1, 0, 2, b"old") + peb(1, 0, 3, b"new") + peb(0, 1, 4, b"second") + peb(0, 0, 5, b"first") + peb()


def test_ubi():
    got, status = extract.unpack(image(), "ubi")
    room = PEB - BODY
    assert status == "ok" and [(p, c) for p, _, c in got] == [("kernel.img", b"first".ljust(room, b"\xff") + b"second".ljust(room, b"\xff")), ("rootfs.img", b"new".ljust(room, b"\xff"))]
    parsed = flash.parse(image())
    assert parsed.volume_at(2 * PEB + 9) == "rootfs" and parsed.volume_at(5 * PEB) is None and parsed.blocks == 6


def node(kind, order, body):
    raw = struct.pack("<QIB3x", order, 24 + len(body), kind) + body
    return (b"\x31\x18\x10\x06" + struct.pack("<I", checksums.crc32_ubi(raw)) + raw).ljust((24 + len(body) + 7) // 8 * 8, b"\0")


def inode(order, number, mode, size, inline=b""):
    return node(0, order, struct.pack("<II8xQQ", number, 0, 0, size).ljust(80, b"\0") + struct.pack("<III", mode, 0, len(inline)).ljust(56, b"\0") + inline)


def block(order, number, k, body, codec):
    raw = zlib.compressobj(9, zlib.DEFLATED, -15) if codec == 2 else None
    packed = raw.compress(body) + raw.flush() if raw else body
    return node(1, order, struct.pack("<II8xIHH", number, 1 << 29 | k, len(body), codec, 0) + packed)


def entry(order, parent, target, name):
    return node(2, order, struct.pack("<II8xQBBHI", parent, 2 << 29, target, 0, 0, len(name), 0) + name + b"\0")


def test_ubifs():
    data = inode(1, 1, 0o040755, 0) + entry(2, 1, 2, b"etc") + inode(3, 2, 0o040755, 0) + entry(4, 2, 3, b"conf") + inode(5, 3, 0o100644, 5000)
    data += block(6, 3, 0, b"a" * 4096, 2) + block(7, 3, 1, b"b" * 904, 0) + block(8, 3, 1, b"c" * 904, 0) + entry(9, 1, 4, b"link") + inode(10, 4, 0o120777, 8, b"etc/conf")
    data += entry(11, 1, 5, b"gone") + inode(12, 5, 0o100644, 1) + entry(13, 1, 0, b"gone") + block(14, 5, 0, b"x", 0)
    got, status = extract.unpack(data, "ubifs")
    assert status == "ok" and {p: (k, c) for p, k, c in got} == {"etc/conf": ("file", b"a" * 4096 + b"c" * 904), "link": ("symlink", b"etc/conf"), "lost+found/inode-5": ("file", b"x")}
