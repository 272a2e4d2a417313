"""Unpacking of read-only file systems. Importing this module registers its extractors."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

import zstandard

from ..functions import lzo
from .extract import MOST_BYTES, File, Stop, _extractor, lz4_block, safe_path


@_extractor("cramfs")
def _cramfs(data: bytes) -> Iterator[File]:
    """Inodes of 12 bytes with packed fields; files are blocks of 4 KiB whose ends are listed before them."""
    order = "<" if data[:4] == b"\x45\x3d\xcd\x28" else ">"

    def inode(at: int) -> tuple[int, int, int, int]:
        mode, _, size, packed = struct.unpack_from(order + "HHII", data, at)
        if order == "<":
            return mode, size & 0xFFFFFF, packed & 63, packed >> 6
        return mode, size >> 8, packed >> 26, packed & 0x3FFFFFF

    def content(size: int, at: int) -> bytes:
        blocks = -(-size // 4096)
        ends = struct.unpack_from(f"{order}{blocks}I", data, at)
        start, out = at + 4 * blocks, []
        for end in ends:
            out.append(zlib.decompress(data[start:end]) if end > start else bytes(4096))
            start = end
        return b"".join(out)[:size]

    todo, seen = [("", 64)], set()
    while todo:
        path, at = todo.pop()
        mode, size, _, offset = inode(at)
        kind = mode >> 12
        if kind == 4:
            here, end = 4 * offset, 4 * offset + size
            while here < end and here not in seen:
                seen.add(here)
                names = 4 * inode(here)[2]
                name = data[here + 12 : here + 12 + names].rstrip(b"\0").decode("latin-1")
                todo.append((f"{path}/{name}".lstrip("/"), here))
                here += 12 + names
        elif kind in (8, 10):
            yield safe_path(path), "file" if kind == 8 else "symlink", content(size, 4 * offset) if size else b""


class _Squash:
    """A version 4 image of either byte order."""

    CODECS = {1: "gzip", 2: "lzma", 3: "lzo", 4: "xz", 5: "lz4", 6: "zstd"}  # Fixed values: the codec's number

    def __init__(self, data: bytes):
        self.data, self.e = data, "<" if data[:4] in (b"hsqs", b"hsqt", b"shsq") else ">"
        (_, self.inodes, _, self.block, self.fragments, codec, _, self.flags, self.ids, major, _, self.root, self.used, self.id_table, self.xattr, self.inode_table, self.dir_table, self.fragment_table) = struct.unpack_from(self.e + "IIIIIHHHHHHQQQQQQQ", data)
        if major != 4:
            raise Stop("unsupported:version")
        self.codec = self.CODECS.get(codec, "?")

    def open(self, raw: bytes, most: int) -> bytes:
        if self.codec == "gzip":
            return zlib.decompress(raw)
        if self.codec in ("xz", "lzma"):
            return lzma.LZMADecompressor(memlimit=1 << 29).decompress(raw, most)
        if self.codec == "zstd":
            return zstandard.ZstdDecompressor().decompress(raw, max_output_size=most)
        if self.codec == "lz4":
            return lz4_block(raw, most)
        if self.codec == "lzo":
            return lzo.decompress(raw, most)
        raise Stop(f"unsupported:{self.codec}")

    def meta(self, at: int, skip: int, size: int) -> bytes:
        """size bytes of metadata from a place inside the block at ``at``."""
        out = bytearray()
        while len(out) < skip + size:
            (head,) = struct.unpack_from(self.e + "H", self.data, at)
            n = head & 0x7FFF
            raw = self.data[at + 2 : at + 2 + n]
            if not n or len(raw) < n:
                raise Stop("error:truncated")
            out += raw if head & 0x8000 else self.open(raw, 8192)
            at += 2 + n
        return bytes(out[skip : skip + size])

    def inode(self, ref: int, size: int) -> bytes:
        return self.meta(self.inode_table + (ref >> 16), ref & 0xFFFF, size)

    def fragment(self, index: int) -> bytes:
        (block,) = struct.unpack_from(self.e + "Q", self.data, self.fragment_table + 8 * (index // 512))
        start, size, _ = struct.unpack(self.e + "QII", self.meta(block, 16 * (index % 512), 16))
        raw = self.data[start : start + (size & 0xFFFFFF)]
        return raw if size & 1 << 24 else self.open(raw, self.block)

    def content(self, start: int, size: int, fragment: int, offset: int, sizes: tuple[int, ...]) -> bytes:
        out, at = [], start
        for k, n in enumerate(sizes):
            raw = self.data[at : at + (n & 0xFFFFFF)]
            room = min(self.block, size - k * self.block)
            out.append(bytes(room) if not n else raw if n & 1 << 24 else self.open(raw, self.block))
            at += n & 0xFFFFFF
        if fragment != 0xFFFFFFFF:
            out.append(self.fragment(fragment)[offset : offset + size % self.block])
        return b"".join(out)[:size]

    def walk(self) -> Iterator[File]:
        todo, seen = [("", self.root)], set()
        while todo:
            path, ref = todo.pop()
            (kind,) = struct.unpack(self.e + "H", self.inode(ref, 2))
            if kind in (1, 8):
                if ref in seen:
                    continue
                seen.add(ref)
                if kind == 1:
                    block, _, size, offset, _ = struct.unpack(self.e + "IIHHI", self.inode(ref, 32)[16:])
                else:
                    _, size, block, _, _, offset, _ = struct.unpack(self.e + "IIIIHHI", self.inode(ref, 40)[16:])
                todo += [(f"{path}/{name}".lstrip("/"), child) for name, child in self.listing(block, offset, size - 3)]
            elif kind in (2, 9):
                if kind == 2:
                    start, fragment, offset, size = struct.unpack(self.e + "IIII", self.inode(ref, 32)[16:])
                    head = 32
                else:
                    start, size, _, _, fragment, offset, _ = struct.unpack(self.e + "QQQIIII", self.inode(ref, 56)[16:])
                    head = 56
                if size > MOST_BYTES:
                    raise Stop("error:too-large")
                n = size // self.block if fragment != 0xFFFFFFFF else -(-size // self.block)
                sizes = struct.unpack(f"{self.e}{n}I", self.inode(ref, head + 4 * n)[head:])
                yield safe_path(path), "file", self.content(start, size, fragment, offset, sizes)
            elif kind in (3, 10):
                _, n = struct.unpack(self.e + "II", self.inode(ref, 24)[16:])
                yield safe_path(path), "symlink", self.inode(ref, 24 + n)[24:]

    def listing(self, block: int, offset: int, size: int) -> Iterator[tuple[str, int]]:
        if size <= 0:
            return
        raw, at = self.meta(self.dir_table + block, offset, size), 0
        while at + 12 <= len(raw):
            count, start, _ = struct.unpack_from(self.e + "III", raw, at)
            at += 12
            for _ in range(count + 1):
                place, _, _, n = struct.unpack_from(self.e + "HhHH", raw, at)
                yield raw[at + 8 : at + 9 + n].decode("latin-1"), start << 16 | place
                at += 9 + n


@_extractor("squashfs")
def _squashfs(data: bytes) -> Iterator[File]:
    yield from _Squash(data).walk()


class _Ext:
    """A second, third or fourth extended file system: extents or block lists, no journal replay."""

    def __init__(self, data: bytes):
        self.data = data
        sb = data[1024:2048]
        if len(sb) < 1024 or sb[56:58] != b"\x53\xef":
            raise Stop("error:no-superblock")
        u = lambda at, n=4: int.from_bytes(sb[at : at + n], "little")
        if u(24) > 6:
            raise Stop("error:block-size")
        self.block, self.per_group, self.inode_size = 1024 << u(24), u(40), u(88, 2) if u(76) else 128
        wide = u(96) & 0x80
        self.desc, self.first = (u(254, 2) if wide else 32) or 32, u(20)
        self.inodes, self.wide = u(0), bool(wide)

    def at(self, block: int) -> bytes:
        return self.data[block * self.block : (block + 1) * self.block]

    def inode(self, number: int) -> bytes:
        if not 0 < number <= self.inodes:
            raise Stop("error:inode")
        group, index = divmod(number - 1, self.per_group)
        d = (self.first + 1) * self.block + group * self.desc
        table = int.from_bytes(self.data[d + 8 : d + 12], "little")
        if self.wide and self.desc >= 64:
            table |= int.from_bytes(self.data[d + 40 : d + 44], "little") << 32
        start = table * self.block + index * self.inode_size
        raw = self.data[start : start + max(128, self.inode_size)]
        if len(raw) < 128:
            raise Stop("error:truncated")
        return raw

    def extents(self, node: bytes, depth: int = 0) -> Iterator[tuple[int, int, int, bool]]:
        """(logical block, blocks, physical block, written)"""
        magic, count, _, level = struct.unpack_from("<HHHH", node)
        if magic != 0xF30A or depth > 6:
            raise Stop("error:extent")
        for k in range(count):
            if level:
                _, low, high, _ = struct.unpack_from("<IIHH", node, 12 + 12 * k)
                yield from self.extents(self.at(high << 32 | low), depth + 1)
            else:
                logical, n, high, low = struct.unpack_from("<IHHI", node, 12 + 12 * k)
                yield logical, n if n <= 32768 else n - 32768, high << 32 | low, n <= 32768

    def listed(self, pointers: bytes, most: int) -> Iterator[int]:
        """The physical blocks of an older inode: 12 direct ones, then one, two and three levels."""
        words = struct.unpack("<15I", pointers)
        left = most

        def tree(block: int, level: int) -> Iterator[int]:
            if not level:
                yield block
                return
            inside = struct.unpack(f"<{self.block // 4}I", self.at(block).ljust(self.block, b"\0")) if block else (0,) * (self.block // 4)
            for b in inside:
                if left <= 0:
                    return
                yield from tree(b, level - 1)

        for k, block in enumerate(words):
            for b in tree(block, max(0, k - 11)):
                if left <= 0:
                    return
                left -= 1
                yield b

    def content(self, raw: bytes) -> bytes:
        size = int.from_bytes(raw[4:8], "little") | (int.from_bytes(raw[108:112], "little") << 32 if raw[1] >> 4 == 8 else 0)
        flags = int.from_bytes(raw[32:36], "little")
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        if flags & 0x10000000:
            return raw[40 : 40 + min(size, 60)]
        if flags & 0x80000:
            out = bytearray(size)
            for logical, n, physical, written in self.extents(raw[40:100]):
                start = logical * self.block
                if written and start < size:
                    part = self.data[physical * self.block : physical * self.block + min(n * self.block, size - start)]
                    out[start : start + len(part)] = part
            return bytes(out)
        blocks = -(-size // self.block)
        return b"".join(self.at(b) if b else bytes(self.block) for b in self.listed(raw[40:100], blocks))[:size]

    def walk(self) -> Iterator[File]:
        todo, seen = [("", 2)], set()
        while todo:
            path, number = todo.pop()
            raw = self.inode(number)
            kind = raw[1] >> 4
            if kind == 4:
                if number in seen:
                    continue
                seen.add(number)
                table, at = self.content(raw), 0
                while at + 8 <= len(table):
                    child, size, n = struct.unpack_from("<IHB", table, at)
                    if size < 8:
                        break
                    name = table[at + 8 : at + 8 + n].decode("latin-1")
                    if child and name not in (".", ".."):
                        todo.append((f"{path}/{name}".lstrip("/"), child))
                    at += size
            elif kind == 8:
                yield safe_path(path), "file", self.content(raw)
            elif kind == 10:
                size = int.from_bytes(raw[4:8], "little")
                yield safe_path(path), "symlink", raw[40 : 40 + size] if size < 60 else self.content(raw)


@_extractor("ext")
def _ext(data: bytes) -> Iterator[File]:
    yield from _Ext(data).walk()


class _Fat:
    """FAT12, FAT16 and FAT32 with long names."""

    def __init__(self, data: bytes):
        self.data = data
        u = lambda at, n: int.from_bytes(data[at : at + n], "little")
        sector, per, reserved, fats, roots = u(11, 2), data[13], u(14, 2), data[16], u(17, 2)
        if not sector or not per or not fats:
            raise Stop("error:boot-sector")
        total, size = u(19, 2) or u(32, 4), u(22, 2) or u(36, 4)
        self.fat, self.root = reserved * sector, (reserved + fats * size) * sector
        self.root_size = roots * 32
        self.start, self.cluster = self.root + -(-self.root_size // sector) * sector, sector * per
        self.count = (total * sector - self.start) // self.cluster
        self.bits = 12 if self.count < 4085 else 16 if self.count < 65525 else 32
        self.root_cluster = u(44, 4) if self.bits == 32 else 0

    def following(self, c: int) -> int:
        if self.bits == 12:
            word = int.from_bytes(self.data[self.fat + c * 3 // 2 : self.fat + c * 3 // 2 + 2], "little")
            return word >> 4 if c & 1 else word & 0xFFF
        n = self.bits // 8
        return int.from_bytes(self.data[self.fat + c * n : self.fat + c * n + n], "little") & (0xFFFFFFF if n == 4 else 0xFFFF)

    def chain(self, c: int) -> bytes:
        out, seen = [], set()
        while 2 <= c < self.count + 2 and c not in seen:
            seen.add(c)
            at = self.start + (c - 2) * self.cluster
            out.append(self.data[at : at + self.cluster])
            if len(out) * self.cluster > MOST_BYTES:
                raise Stop("error:too-large")
            c = self.following(c)
        return b"".join(out)

    def walk(self) -> Iterator[File]:
        first = self.chain(self.root_cluster) if self.bits == 32 else self.data[self.root : self.root + self.root_size]
        todo, seen = [("", first)], set()
        while todo:
            path, table = todo.pop()
            long: dict[int, str] = {}
            for at in range(0, len(table) - 31, 32):
                e = table[at : at + 32]
                if not e[0]:
                    break
                if e[0] == 0xE5:
                    long = {}
                elif e[11] == 0x0F:
                    long[e[0] & 0x1F] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")
                else:
                    name = "".join(long[k] for k in sorted(long))
                    if not name:
                        base, ext = e[:8].decode("latin-1").rstrip(), e[8:11].decode("latin-1").rstrip()
                        name = f"{base}.{ext}" if ext else base
                    long = {}
                    c = int.from_bytes(e[26:28], "little") | (int.from_bytes(e[20:22], "little") << 16 if self.bits == 32 else 0)
                    full = f"{path}/{name}".lstrip("/")
                    if e[11] & 8 or name in (".", ".."):
                        continue
                    if e[11] & 0x10:
                        if c not in seen:
                            seen.add(c)
                            todo.append((full, self.chain(c)))
                    else:
                        yield safe_path(full), "file", self.chain(c)[: int.from_bytes(e[28:32], "little")]


@_extractor("fat", "vfat", "fat32")
def _fat(data: bytes) -> Iterator[File]:
    yield from _Fat(data).walk()
