"""Builders of HFS+, XFS, EROFS, Btrfs and F2FS volumes."""

from __future__ import annotations

import struct
import zlib

from ..functions import checksums
from .images import FILES, put

LARGE = bytes(range(256)) * 40


def hfsplus() -> bytes:
    """Blocks of 512 bytes: a folder with a file, a file of two runs, one of ten runs (two in the tree of extents), a link."""
    block = 512
    parts: dict[int, bytes] = {}

    def fork(size: int, runs: list[tuple[int, int]]) -> bytes:
        raw = b"".join(struct.pack(">II", *r) for r in runs[:8])
        return struct.pack(">QII", size, 0, sum(n for _, n in runs)) + raw.ljust(64, b"\0")

    def store(body: bytes, runs: list[tuple[int, int]]) -> bytes:
        at = 0
        for start, n in runs:
            parts[start * block] = body[at : at + n * block]
            at += n * block
        return fork(len(body), runs)

    def tree(leaves: list[list[bytes]]) -> bytes:
        head = struct.pack(">IIbBHH", 0, 0, 1, 0, 3, 0) + struct.pack(">HIIIIHHII", 1, 1, 9, 1, len(leaves), block, 0, len(leaves) + 1, 0)
        out = head.ljust(block, b"\0")
        for k, rows in enumerate(leaves):
            raw, places = struct.pack(">IIbBHH", k + 2 if k + 1 < len(leaves) else 0, k, -1, 1, len(rows), 0), []
            for r in rows:
                places.append(len(raw))
                raw += r
            places.append(len(raw))
            out += raw.ljust(block - 2 * len(places), b"\0") + b"".join(struct.pack(">H", p) for p in reversed(places))
        return out

    def key(parent: int, name: str) -> bytes:
        raw = struct.pack(">IH", parent, len(name)) + name.encode("utf-16-be")
        return struct.pack(">H", len(raw)) + raw

    def folder(parent: int, name: str, id_: int) -> bytes:
        return key(parent, name) + struct.pack(">HHII", 1, 0, 0, id_).ljust(88, b"\0")

    def file(parent: int, name: str, id_: int, data: bytes, kind: bytes = b"TEXT") -> bytes:
        return key(parent, name) + (struct.pack(">HHII", 2, 0, 0, id_).ljust(48, b"\0") + kind).ljust(88, b"\0") + data + bytes(80)

    many = [(60 + 2 * k, 1) for k in range(10)]
    rows = [folder(1, "volume", 2), folder(2, "etc", 16), file(16, "conf", 17, store(FILES["etc/conf"], [(30, 1)]))]
    rows2 = [file(2, "large", 18, store(LARGE, [(32, 5), (40, 15)]))]
    rows3 = [file(2, "many", 19, store(LARGE[: 10 * block], many))]
    rows4 = [file(2, "link", 20, store(b"etc/conf", [(31, 1)]), b"slnk")]
    catalog = tree([rows[:2], rows[2:], rows2, rows3, rows4])
    extents = tree([[struct.pack(">HBBII", 10, 0, 0, 19, 8) + struct.pack(">4I", *many[8], *many[9]).ljust(64, b"\0")]])
    head = put(512, {0: b"H+\0\4", 40: struct.pack(">II", block, 100), 192: store(extents, [(10, 2)]), 272: store(catalog, [(12, 6)])})
    return put(100 * block, {1024: head, **parts})


def xfs() -> bytes:
    """Blocks of 512 bytes, inodes of 256: a short root, a directory of a block, a file of two runs, one below a tree, a link."""
    block, inode = 512, 256
    parts: dict[int, bytes] = {}
    number = lambda at_block, k: at_block << 1 | k  # noqa: E731  two inodes a block

    def run(first: int, place: int, n: int) -> bytes:
        return (first << 73 | place << 21 | n).to_bytes(16, "big")

    def write(at_block: int, k: int, mode: int, format_: int, size: int, n: int, body: bytes) -> None:
        head = struct.pack(">2sHBB", b"IN", mode, 1, format_).ljust(56, b"\0") + struct.pack(">Q", size)
        parts[at_block * block + k * inode] = (head.ljust(76, b"\0") + struct.pack(">I", n)).ljust(100, b"\0") + body

    def short(entries: list[tuple[bytes, int]]) -> bytes:
        return struct.pack(">BBI", len(entries), 0, number(8, 0)) + b"".join(struct.pack(">BH", len(n), 0) + n + struct.pack(">I", i) for n, i in entries)

    root = short([(b"etc", number(8, 1)), (b"large", number(9, 0)), (b"tree", number(9, 1)), (b"link", number(10, 0))])
    write(8, 0, 0o040755, 1, len(root), 0, root)
    entry = lambda n, i: (struct.pack(">QB", i, len(n)) + n).ljust((9 + len(n) + 2 + 7) // 8 * 8, b"\0")
    page = b"XD2B".ljust(16, b"\0") + entry(b".", number(8, 1)) + entry(b"..", number(8, 0)) + b"\xff\xff" + struct.pack(">H", 16).ljust(14, b"\0") + entry(b"conf", number(10, 1))
    free = block - 8 - 3 * 8 - len(page)
    page += (b"\xff\xff" + struct.pack(">H", free)).ljust(free, b"\0") + bytes(24) + struct.pack(">II", 3, 0)
    write(8, 1, 0o040755, 2, block, 1, run(0, 20, 1))
    parts[20 * block] = page
    write(9, 0, 0o100644, 2, len(LARGE), 2, run(0, 24, 12) + run(12, 40, 8))
    parts[24 * block], parts[40 * block] = LARGE[: 12 * block], LARGE[12 * block :]
    # two pointers to leaves, behind the room for keys
    room = (inode - 100 - 4) // 16
    write(9, 1, 0o100644, 3, 4 * block, 2, struct.pack(">HH", 1, 2).ljust(4 + 8 * room, b"\0") + struct.pack(">QQ", 21, 22))
    leaf = lambda rows: (struct.pack(">4sHHQQ", b"BMAP", 0, len(rows), 2**64 - 1, 2**64 - 1) + b"".join(rows))
    parts[21 * block], parts[22 * block] = leaf([run(0, 50, 1), run(1, 52, 1)]), leaf([run(3, 54, 1)])  # block 2 is a hole
    for k, place in ((0, 50), (1, 52), (3, 54)):
        parts[place * block] = LARGE[k * block : (k + 1) * block]
    write(10, 0, 0o120777, 1, 8, 0, b"etc/conf")
    write(10, 1, 0o100644, 2, 120, 1, run(0, 60, 1))
    parts[60 * block] = FILES["etc/conf"]
    sb = put(512, {0: b"XFSB" + struct.pack(">IQ", block, 64), 56: struct.pack(">Q", number(8, 0)), 84: struct.pack(">II", 64, 1), 100: struct.pack(">HHHH", 0xB4A4, 512, inode, 2), 120: bytes([9, 9, 8, 1, 6])})
    return put(64 * block, {0: sb, **parts})


def erofs() -> bytes:
    """Blocks of 512 bytes: a plain file, files with tails behind their inodes, a directory, a link, a compressed file that can't be read."""
    block, parts = 512, {}

    def write(k: int, mode: int, layout: int, body: bytes, first: int = 0, wide: bool = False) -> None:
        whole = len(body) // block * block if layout == 2 else len(body)
        head = struct.pack("<HHHH", layout << 1 | wide, 0, mode, 1) + (struct.pack("<QII", len(body), first, k) if wide else struct.pack("<IIII", len(body), 0, first, k))
        parts[4 * block + 32 * k] = head.ljust(64 if wide else 32, b"\0") + (body[whole:] if layout == 2 else b"")
        if first:
            parts[first * block] = body[:whole]

    def folder(entries: list[tuple[bytes, int, int]]) -> bytes:
        at, out, names = 12 * len(entries), b"", b""
        for name, k, kind in entries:
            out += struct.pack("<QHBB", k, at + len(names), kind, 0)
            names += name
        return out + names

    write(0, 0o040755, 2, folder([(b".", 0, 2), (b"..", 0, 2), (b"etc", 8, 2), (b"large", 16, 1), (b"link", 28, 7), (b"packed", 30, 1)]))
    write(8, 0o040755, 2, folder([(b".", 8, 2), (b"..", 0, 2), (b"conf", 40, 1)]))
    write(16, 0o100644, 2, LARGE[:1300], 20, True)
    write(28, 0o120777, 2, b"etc/conf")
    write(30, 0o100644, 1, b"")
    write(40, 0o100644, 0, FILES["etc/conf"], 24)
    return put(32 * block, {1024: b"\xe2\xe1\xf5\xe0", 1036: b"\x09", 1038: struct.pack("<H", 0), 1060: struct.pack("<II", 32, 4), **parts})


def btrfs() -> bytes:
    """One chunk that lies elsewhere than its logical place: a packed file, an inline one in a directory, a hole, a link."""
    node, shift, base = 4096, 0x100000, 0x20000
    logical = lambda k: shift + base + k * node
    parts: dict[int, bytes] = {}

    def leaf(k: int, items: list[tuple[int, int, int, bytes]]) -> None:
        heads, bodies, at = b"", b"", node - 101
        for object_, kind, offset, body in items:
            at -= len(body)
            heads += struct.pack("<QBQII", object_, kind, offset, at, len(body))
            bodies = body + bodies
        head = bytes(48) + struct.pack("<QQ16xQQIB", logical(k), 0, 1, 5, len(items), 0)
        parts[base + k * node] = (head + heads).ljust(node - len(bodies), b"\0") + bodies

    inode = lambda mode, size: struct.pack("<QQQQQIIII", 1, 1, size, size, 0, 1, 0, 0, mode).ljust(160, b"\0")
    entry = lambda target, name: struct.pack("<QBQQHHB", target, 1, 0, 1, 0, len(name), 1) + name
    inline = lambda body: struct.pack("<QQBBHB", 1, len(body), 0, 0, 0, 0) + body
    far = lambda place, stored, skip, n, plain, codec: struct.pack("<QQBBHB", 1, plain, codec, 0, 0, 1) + struct.pack("<4Q", place, stored, skip, n)
    packed = zlib.compress(LARGE)
    chunk = struct.pack("<QQQQIIIHH", 1 << 20, 2, 65536, 1, 4096, 4096, 4096, 1, 0) + struct.pack("<QQ16x", 1, base)
    leaf(0, [(256, 228, shift + base, chunk)])
    leaf(1, [(5, 132, 0, (bytes(160) + struct.pack("<QQQ", 1, 256, logical(2))).ljust(439, b"\0"))])
    leaf(2, [
        (256, 1, 0, inode(0o040755, 0)), (256, 96, 2, entry(257, b"etc")), (256, 96, 3, entry(259, b"large")), (256, 96, 4, entry(260, b"link")), (257, 1, 0, inode(0o040755, 0)), (257, 96, 2, entry(258, b"conf")),
        (258, 1, 0, inode(0o100644, 120)), (258, 108, 0, inline(FILES["etc/conf"])), (259, 1, 0, inode(0o100644, 16384)), (259, 108, 0, far(logical(4), len(packed), 0, 10240, 10240, 1)), (259, 108, 12288, far(logical(5), 4096, 0, 4096, 4096, 0)),
        (260, 1, 0, inode(0o120777, 8)), (260, 108, 0, inline(b"etc/conf")),
    ])
    parts[base + 4 * node], parts[base + 5 * node] = packed, b"r" * 4096
    key = struct.pack("<QBQ", 256, 228, shift + base)
    sb = put(4096, {64: b"_BHRfS_M", 80: struct.pack("<QQ", logical(1), logical(0)), 112: struct.pack("<Q", 262144), 144: struct.pack("<II", 4096, node), 160: struct.pack("<I", len(key + chunk)), 811: key + chunk})
    return put(262144, {0x10000: sb, **parts})


def f2fs() -> bytes:
    """Segments of 4 blocks: an inline directory and file, a directory of a block, a file with a node below, one node moved by the journal."""
    size, parts = 4096, {}
    nat: dict[int, int] = {}

    def write(number: int, place: int, mode: int, inline: int, length: int, body: bytes, moved: bool = False, nodes: tuple[int, ...] = ()) -> None:
        raw = struct.pack("<HBBIIIQ", mode, 0, inline, 0, 0, 1, length).ljust(360, b"\0") + body
        raw = raw.ljust(360 + 4 * 923, b"\0") + struct.pack(f"<{len(nodes)}I", *nodes)
        parts[place * size] = raw.ljust(size, b"\0")
        nat[number] = 99 if moved else place

    def slots(n: int, table: int, room: int, entries: list[tuple[bytes, int]]) -> bytes:
        bits, heads, names, k = bytearray((n + 7) // 8), bytearray(11 * n), bytearray(8 * n), 0
        for name, number in entries:
            heads[11 * k : 11 * k + 11] = struct.pack("<IIHB", 0, number, len(name), 1)
            names[8 * k : 8 * k + len(name)] = name
            for _ in range(-(-len(name) // 8)):
                bits[k // 8] |= 1 << k % 8
                k += 1
        return (bytes(bits).ljust(table, b"\0") + bytes(heads) + bytes(names)).ljust(room, b"\0")

    room = 4 * (923 - 50 - 1)
    n = room * 8 // 153
    write(3, 20, 0o040755, 1 | 4, size, bytes(4) + slots(n, room - 19 * n, room, [(b".", 3), (b"..", 3), (b"etc", 4), (b"a name of many slots", 6), (b"link", 7)]))
    write(4, 21, 0o040755, 1, size, struct.pack("<I", 24))
    parts[24 * size] = slots(214, 30, size, [(b".", 4), (b"..", 3), (b"conf", 5)])
    write(5, 22, 0o100644, 1 | 2, 120, bytes(4) + FILES["etc/conf"], moved=True)
    own = 923 - 50
    direct = [30 if k == 0 else 0 for k in range(own)]  # what is between is a hole
    write(6, 23, 0o100644, 1, (own + 2) * size, struct.pack(f"<{own}I", *direct), nodes=(8,))
    parts[30 * size], parts[32 * size] = LARGE[:size], LARGE[size : 2 * size]
    parts[25 * size] = struct.pack("<II", 0, 32)
    nat[8] = 25
    write(7, 26, 0o120777, 1 | 2, 8, bytes(4) + b"etc/conf")
    table = b"".join(struct.pack("<BII", 0, k, nat.get(k, 0)) for k in range(455))
    parts[12 * size + 4 * size] = table  # the second copy, as the bitmap says
    journal = struct.pack("<HIBII", 1, 5, 0, 5, 22)
    pack = bytearray(size)
    struct.pack_into("<Q", pack, 0, 7)
    struct.pack_into("<III", pack, 132, 4, 2, 1)
    struct.pack_into("<III", pack, 156, 1, 1, 4092)
    pack[192:194] = b"\0\x80"
    struct.pack_into("<I", pack, 4092, checksums.crc32_raw(bytes(pack[:4092]), 0xF2F52010))
    parts[4 * size], parts[5 * size] = bytes(pack), journal
    sb = put(512, {0: b"\x10\x20\xf5\xf2", 16: struct.pack("<II", 12, 2), 48: struct.pack("<I", 10), 76: struct.pack("<III", 4, 8, 12), 96: struct.pack("<I", 3)})
    return put(40 * size, {1024: sb, **parts})


SAMPLES = {"tree.hfsplus": hfsplus, "tree.xfs": xfs, "tree.erofs": erofs, "tree.btrfs": btrfs, "tree.f2fs": f2fs}
