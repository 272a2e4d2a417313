"""Unpacking of HFS+, XFS, EROFS, Btrfs and F2FS volumes. Importing this module registers its extractors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import zstandard

from ..functions import checksums, lzo
from .extract import MOST_BYTES, File, Stop, _extractor, safe_path

#: Records and blocks that one file or tree is followed over; images of sane size have fewer.
MOST_STEPS = 1 << 22


def _u(data: bytes, at: int, n: int, order: str = "big") -> int:
    if at < 0 or at + n > len(data):
        raise Stop("error:truncated")
    return int.from_bytes(data[at : at + n], order)


class HfsPlus:
    """EXT-39: forks are runs of blocks, the catalog is a tree whose leaves are a chain; all numbers are big-endian."""

    def __init__(self, data: bytes):
        self.data, self.block = data, _u(data, 1024 + 40, 4)
        if not 512 <= self.block <= 65536:
            raise Stop("error:block-size")
        self.more: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # (file, fork) -> later runs by first block
        for key, value in self._leaves(self.fork(1024 + 192, 3)):
            kind, file, first = key[0], _u(key, 2, 4), _u(key, 6, 4)
            self.more.setdefault((file, kind), []).extend((first + k, *struct.unpack_from(">II", value, 8 * k)) for k in range(8))

    def fork(self, at: int, file: int, raw: bytes | None = None) -> bytes:
        """A fork's bytes; its first eight runs stand in it, later ones in the tree of extents."""
        raw = self.data if raw is None else raw
        size = _u(raw, at, 8)
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        runs = [struct.unpack_from(">II", raw, at + 16 + 8 * k) for k in range(8)]
        if size > sum(n for _, n in runs) * self.block:
            runs += [(start, n) for _, start, n in sorted(getattr(self, "more", {}).get((file, 0), []))]
        return b"".join(self.data[start * self.block : (start + n) * self.block] for start, n in runs)[:size]

    @staticmethod
    def _leaves(tree: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(key, value) of each record."""
        if len(tree) < 512:
            return
        node, size, steps = _u(tree, 24, 4), _u(tree, 32, 2), 0
        while node and steps < MOST_STEPS and (node + 1) * size <= len(tree):
            steps += 1
            raw = tree[node * size : (node + 1) * size]
            if raw[8] != 0xFF:
                return
            for k in range(_u(raw, 10, 2)):
                at = _u(raw, size - 2 * k - 2, 2)
                n = _u(raw, at, 2)
                yield raw[at + 2 : at + 2 + n], raw[at + 2 + n + (n & 1) :]
            node = _u(raw, 0, 4)

    def files(self) -> Iterator[File]:
        folders: dict[int, tuple[int, str]] = {}
        found = []
        for key, value in self._leaves(self.fork(1024 + 272, 4)):
            parent, n = _u(key, 0, 4), _u(key, 4, 2)
            name = key[6 : 6 + 2 * n].decode("utf-16-be", "replace").replace("/", ":")
            kind = _u(value, 0, 2)
            if kind == 1:
                folders[_u(value, 8, 4)] = (parent, name)
            elif kind == 2:
                found.append((parent, name, value))

        def path(id_: int) -> str | None:
            parts, seen = [], set()
            while id_ != 2:  # the root folder, which the volume's name leads to
                if id_ not in folders or id_ in seen:
                    return None
                seen.add(id_)
                parts.append(folders[id_][1])
                id_ = folders[id_][0]
            return "/".join(reversed(parts))

        for parent, name, value in found:
            where = path(parent)
            if where is not None and not where.startswith("\0"):  # private folders begin with zeros
                kind = "symlink" if value[48:52] == b"slnk" else "file"
                yield safe_path(f"{where}/{name}".lstrip("/")), kind, self.fork(88, _u(value, 8, 4), value)


@_extractor("hfsplus")
def _hfsplus(data: bytes) -> Iterator[File]:
    yield from HfsPlus(data).files()


class Xfs:
    """EXT-40: inodes are numbered by where they stand; a file's runs are in its inode or in a tree below it."""

    def __init__(self, data: bytes):
        self.data = data
        self.block, self.root, self.group = _u(data, 4, 4), _u(data, 56, 8), _u(data, 84, 4)
        self.five = _u(data, 100, 2) & 15 == 5
        self.inode_size = _u(data, 104, 2)
        self.per_block_bits, self.group_bits, folder_bits = data[123], data[124], data[192]
        if not 512 <= self.block <= 65536 or not 256 <= self.inode_size <= 4096:
            raise Stop("error:superblock")
        self.folder = self.block << folder_bits
        self.typed = (self.five and _u(data, 216, 4) & 1) or bool(_u(data, 100, 2) & 0x8000 and _u(data, 200, 4) & 0x200)

    def inode(self, number: int) -> bytes:
        bits = self.per_block_bits
        group, rest = number >> self.group_bits + bits, number & (1 << self.group_bits + bits) - 1
        at = (group * self.group + (rest >> bits)) * self.block + (rest & (1 << bits) - 1) * self.inode_size
        raw = self.data[at : at + self.inode_size]
        if raw[:2] != b"IN":
            raise Stop("error:inode")
        return raw

    def _at(self, block: int) -> int:
        return ((block >> self.group_bits) * self.group + (block & (1 << self.group_bits) - 1)) * self.block

    def _runs(self, raw: bytes, format_: int) -> Iterator[tuple[int, int, int]]:
        """(first block of the file, place, blocks)"""
        start = 176 if raw[4] == 3 else 100

        def records(table: bytes, n: int) -> Iterator[tuple[int, int, int]]:
            for k in range(n):
                word = int.from_bytes(table[16 * k : 16 * k + 16], "big")
                if not word >> 127:  # what is allocated but never written reads as zeros
                    yield word >> 73 & (1 << 54) - 1, self._at(word >> 21 & (1 << 52) - 1), word & (1 << 21) - 1

        if format_ == 2:
            yield from records(raw[start:], min(_u(raw, 76, 4), (len(raw) - start) // 16))
            return
        room = (raw[82] * 8 or len(raw) - start) - 4
        n = _u(raw, start + 2, 2)
        first = start + 4 + 8 * (room // 16)
        todo, seen = [_u(raw, first + 8 * k, 8) for k in range(n)], 0
        head = 72 if self.five else 24
        while todo and seen < MOST_STEPS:
            seen += 1
            at = self._at(todo.pop())
            node = self.data[at : at + self.block]
            level, n = _u(node, 4, 2), _u(node, 6, 2)
            if level:
                first = head + 8 * ((self.block - head) // 16)
                todo += [_u(node, first + 8 * k, 8) for k in range(n)]
            else:
                yield from records(node[head:], n)

    def content(self, raw: bytes) -> bytes:
        size, format_ = _u(raw, 56, 8), raw[5]
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        start = 176 if raw[4] == 3 else 100
        if format_ == 1:
            return raw[start : start + size]
        out = bytearray(size)
        for first, at, n in self._runs(raw, format_):
            begin = first * self.block
            if begin < size:
                part = self.data[at : at + min(n * self.block, size - begin)]
                out[begin : begin + len(part)] = part
        return bytes(out)

    def entries(self, raw: bytes) -> Iterator[tuple[str, int]]:
        start = 176 if raw[4] == 3 else 100
        if raw[5] == 1:
            wide = 8 if raw[start + 1] else 4
            at = start + 2 + wide
            for _ in range(raw[start]):
                n = raw[at]
                name = raw[at + 3 : at + 3 + n]
                at += 3 + n + self.typed
                yield name.decode("utf-8", "surrogateescape"), _u(raw, at, wide)
                at += wide
            return
        blocks: dict[int, bytes] = {}
        for first, at, n in self._runs(raw, raw[5]):
            for k in range(n):
                if (first + k) * self.block < 32 << 30:  # behind that stand indexes, not entries
                    blocks[first + k] = self.data[at + k * self.block : at + (k + 1) * self.block]
        step = self.folder // self.block
        for k in sorted(b for b in blocks if b % step == 0):
            page = b"".join(blocks.get(k + j, b"") for j in range(step))
            magic = page[:4]
            if magic not in (b"XD2B", b"XDB3", b"XD2D", b"XDD3"):
                continue
            end = len(page) - 8 - 8 * _u(page, len(page) - 8, 4) if magic in (b"XD2B", b"XDB3") else len(page)
            at = 64 if magic in (b"XDB3", b"XDD3") else 16
            while at + 8 <= end:
                if page[at : at + 2] == b"\xff\xff":
                    at += max(8, _u(page, at + 2, 2))
                    continue
                n = page[at + 8]
                yield page[at + 9 : at + 9 + n].decode("utf-8", "surrogateescape"), _u(page, at, 8)
                at += (9 + n + self.typed + 2 + 7) // 8 * 8

    def files(self) -> Iterator[File]:
        todo, seen = [("", self.root)], set()
        while todo:
            path, number = todo.pop()
            raw = self.inode(number)
            kind = _u(raw, 2, 2) >> 12
            if kind == 4 and number not in seen:
                seen.add(number)
                todo += [(f"{path}/{name}".lstrip("/"), n) for name, n in reversed(list(self.entries(raw))) if name not in (".", "..") and "/" not in name]
            elif kind in (8, 10) and path:
                body = self.content(raw)
                if kind == 10 and self.five and raw[5] != 1:
                    body = body[56:]  # blocks of long links begin with a header
                yield safe_path(path), "file" if kind == 8 else "symlink", body


@_extractor("xfs")
def _xfs(data: bytes) -> Iterator[File]:
    yield from Xfs(data).files()


@_extractor("erofs")
def _erofs(data: bytes) -> Iterator[File]:
    """EXT-12: plain files, and those whose tail stands behind their inode; compressed ones are left out."""
    le = lambda at, n: _u(data, at, n, "little")
    block, base = 1 << data[1036], le(1064, 4) << data[1036]

    def inode(number: int) -> tuple[int, int, int, int, int]:
        """Mode, size, layout, first block, and where its own bytes end."""
        at = base + 32 * number
        format_ = le(at, 2)
        wide, xattrs = format_ & 1, le(at + 2, 2)
        size = le(at + 8, 8 if wide else 4)
        end = at + (64 if wide else 32) + (12 + 4 * (xattrs - 1) if xattrs else 0)
        return le(at + 4, 2), size, format_ >> 1 & 7, le(at + 16, 4), end

    def content(number: int) -> tuple[int, bytes | None]:
        mode, size, layout, first, end = inode(number)
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        if layout == 0:
            return mode, data[first * block : first * block + size]
        if layout == 2:
            whole = size // block * block
            return mode, data[first * block : first * block + whole] * bool(whole) + data[end : end + size - whole]
        return mode, None

    todo, seen, left_out = [("", le(1038, 2))], set(), False
    while todo:
        path, number = todo.pop()
        mode, body = content(number)
        if body is None:
            left_out = True
        elif mode >> 12 == 4:
            if number in seen:
                continue
            seen.add(number)
            below = []
            for at in range(0, len(body), block):
                page = body[at : at + block]
                n = int.from_bytes(page[8:10], "little") // 12
                starts = [int.from_bytes(page[12 * k + 8 : 12 * k + 10], "little") for k in range(n)]
                for k, a in enumerate(starts):
                    name = page[a : starts[k + 1] if k + 1 < n else len(page)].split(b"\0")[0].decode("utf-8", "surrogateescape")
                    if name not in ("", ".", "..") and "/" not in name:
                        below.append((f"{path}/{name}".lstrip("/"), int.from_bytes(page[12 * k : 12 * k + 8], "little")))
            todo += reversed(below)
        elif mode >> 12 in (8, 10) and path:
            yield safe_path(path), "file" if mode >> 12 == 8 else "symlink", body
    if left_out:
        raise Stop("unsupported:compressed")


class Btrfs:
    """EXT-41: trees of (object, type, offset); places are logical, and chunks say where they are."""

    # Types of items, and the object of the tree of files.
    INODE, ENTRY, EXTENT, ROOT, CHUNK, FILES = 1, 96, 108, 132, 228, 5

    def __init__(self, data: bytes):
        self.data, sb = data, 0x10000
        self.node = self._le(sb + 148, 4)
        if not 512 <= self.node <= 65536:
            raise Stop("error:superblock")
        self.chunks: list[tuple[int, int, int]] = []  # logical, size, place
        at, end = sb + 811, sb + 811 + min(self._le(sb + 160, 4), 2048)
        while at + 17 + 80 <= end:
            at += 17 + self._chunk(self._le(at + 9, 8), data[at + 17 : end])
        for (_, kind, offset), value in self.items(self._le(sb + 88, 8)):
            if kind == self.CHUNK:
                self._chunk(offset, value)
        self.root = self._le(sb + 80, 8)

    def _le(self, at: int, n: int) -> int:
        return _u(self.data, at, n, "little")

    def _chunk(self, logical: int, raw: bytes) -> int:
        """Note a chunk by its first stripe; how many bytes its item has."""
        size, stripes = _u(raw, 0, 8, "little"), _u(raw, 44, 2, "little")
        found = (logical, size, _u(raw, 56, 8, "little"))
        if found not in self.chunks:
            self.chunks.append(found)
        return 48 + 32 * max(1, stripes)

    def place(self, logical: int) -> int:
        for start, size, at in self.chunks:
            if start <= logical < start + size:
                return at + logical - start
        raise Stop("error:no-chunk")

    def items(self, logical: int) -> Iterator[tuple[tuple[int, int, int], bytes]]:
        """(key, value) of all items below a node, in order."""
        todo, seen = [logical], 0
        while todo and seen < MOST_STEPS:
            seen += 1
            at = self.place(todo.pop())
            raw = self.data[at : at + self.node]
            n, level = _u(raw, 96, 4, "little"), _u(raw, 100, 1)
            if level:
                todo += [_u(raw, 101 + 33 * k + 17, 8, "little") for k in range(n - 1, -1, -1)]
                continue
            for k in range(n):
                object_, kind, offset, start, size = struct.unpack_from("<QBQII", raw, 101 + 25 * k)
                yield (object_, kind, offset), raw[101 + start : 101 + start + size]

    def extent(self, raw: bytes) -> bytes:
        """The bytes of an extent: inside the item, or where it points."""
        plain, codec, kind = _u(raw, 8, 8, "little"), raw[16], raw[20]
        if plain > MOST_BYTES:
            raise Stop("error:too-large")
        if kind == 0:
            return self._open(codec, raw[21:], plain)
        logical, stored, skip, n = struct.unpack_from("<4Q", raw, 21)
        if kind == 2 or not logical:
            return bytes(n)
        at = self.place(logical)
        if not codec:
            return self.data[at + skip : at + skip + n]
        return self._open(codec, self.data[at : at + stored], plain)[skip : skip + n]

    @staticmethod
    def _open(codec: int, raw: bytes, size: int) -> bytes:
        if codec == 0:
            return raw[:size]
        if codec == 1:
            return zlib.decompressobj().decompress(raw, size)
        if codec == 2:  # a total, then parts of a page each, whose lengths don't cross pages
            out, at, end = b"", 4, _u(raw, 0, 4, "little")
            while at + 4 <= end and len(out) < size:
                if at % 4096 > 4092:
                    at = (at + 4095) // 4096 * 4096
                n = _u(raw, at, 4, "little")
                out += lzo.decompress(raw[at + 4 : at + 4 + n], 4096)
                at += 4 + n
            return out
        if codec == 3:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)[:size]
        raise Stop(f"unsupported:{codec}")

    def files(self) -> Iterator[File]:
        roots = [value for (object_, kind, _), value in self.items(self.root) if object_ == self.FILES and kind == self.ROOT]
        if not roots:
            raise Stop("error:no-files")
        inodes: dict[int, tuple[int, int]] = {}
        entries: dict[int, list[tuple[str, int]]] = {}
        extents: dict[int, list[tuple[int, bytes]]] = {}
        for (object_, kind, offset), value in self.items(_u(roots[-1], 176, 8, "little")):
            if kind == self.INODE:
                inodes[object_] = (_u(value, 52, 4, "little"), _u(value, 16, 8, "little"))
            elif kind == self.ENTRY:
                n = _u(value, 27, 2, "little")
                if value[8] == self.INODE:  # other trees, snapshots, aren't entered
                    entries.setdefault(object_, []).append((value[30 : 30 + n].decode("utf-8", "surrogateescape"), _u(value, 0, 8, "little")))
            elif kind == self.EXTENT:
                extents.setdefault(object_, []).append((offset, value))
        todo, seen = [("", 256)], set()
        while todo:
            path, object_ = todo.pop()
            mode, size = inodes.get(object_, (0, 0))
            kind = mode >> 12
            if kind == 4 and object_ not in seen:
                seen.add(object_)
                todo += [(f"{path}/{name}".lstrip("/"), k) for name, k in reversed(entries.get(object_, [])) if "/" not in name]
            elif kind in (8, 10) and path:
                if size > MOST_BYTES:
                    raise Stop("error:too-large")
                out = bytearray(size)
                for at, raw in extents.get(object_, []):
                    part = self.extent(raw)[: max(0, size - at)]
                    out[at : at + len(part)] = part
                yield safe_path(path), "file" if kind == 8 else "symlink", bytes(out)


@_extractor("btrfs")
def _btrfs(data: bytes) -> Iterator[File]:
    yield from Btrfs(data).files()


class F2fs:
    """EXT-13: blocks of 4 KiB; a table says where each node is, and a bitmap and a journal which of its copies counts."""

    SIZE, SEED = 4096, 0xF2F52010
    #: Places in an inode where its blocks begin, how many it has, and how many a node below has.
    FIRST, OWN, BELOW = 360, 923, 1018

    def __init__(self, data: bytes):
        self.data, sb = data, 1024
        if self._le(data, sb + 16, 4) != 12:
            raise Stop("error:block-size")
        self.segment = 1 << self._le(data, sb + 20, 4)
        first, self.nat, self.root = self._le(data, sb + 76, 4), self._le(data, sb + 84, 4), self._le(data, sb + 96, 4)
        packs = []
        for at in (first, first + self.segment):
            raw = self._block(at)
            if len(raw) == self.SIZE:
                end = self._le(raw, 164, 4)
                if 192 <= end <= self.SIZE - 4 and checksums.crc32_raw(raw[:end], self.SEED) == self._le(raw, end, 4):
                    packs.append((self._le(raw, 0, 8), at, raw))
        if not packs:
            raise Stop("error:no-checkpoint")
        _, at, raw = max(packs)
        skip, n = self._le(raw, 156, 4), self._le(raw, 160, 4)
        self.second = raw[192 + skip : 192 + skip + n]
        log = self._block(at + self._le(raw, 140, 4))
        begin = 0 if self._le(raw, 132, 4) & 4 else self.SIZE - 5 - 507  # compact summaries begin with the journal
        n = self._le(log, begin, 2)
        self.moved = {self._le(log, begin + 2 + 13 * k, 4): self._le(log, begin + 2 + 13 * k + 9, 4) for k in range(n)} if n <= 38 else {}

    @staticmethod
    def _le(raw: bytes, at: int, n: int) -> int:
        return _u(raw, at, n, "little")

    def _block(self, k: int) -> bytes:
        return self.data[k * self.SIZE : (k + 1) * self.SIZE]

    def node(self, number: int) -> bytes:
        place = self.moved.get(number)
        if place is None:
            k, slot = divmod(number, self.SIZE // 9)
            group, within = divmod(k, self.segment)
            copy = k // 8 < len(self.second) and self.second[k // 8] >> (7 - k % 8) & 1
            place = self._le(self._block(self.nat + (2 * group + copy) * self.segment + within), 9 * slot + 5, 4)
        raw = self._block(place)
        if not place or len(raw) < self.SIZE:
            raise Stop("error:node")
        return raw

    def _extra(self, raw: bytes) -> int:
        return self._le(raw, self.FIRST, 2) if raw[3] & 0x20 else 0

    def blocks(self, raw: bytes) -> Iterator[int]:
        """The places of a file's blocks in order: in the inode, then in nodes up to three levels below; 0 for a hole."""
        extra = self._extra(raw)
        n = self.OWN - extra // 4 - (50 if raw[3] & 1 else 0)  # attributes may take the end
        yield from struct.unpack_from(f"<{n}I", raw, self.FIRST + extra)

        def below(number: int, level: int) -> Iterator[int]:
            for x in struct.unpack_from(f"<{self.BELOW}I", self.node(number)) if number else [0] * self.BELOW:
                if level:
                    yield from below(x, level - 1)
                else:
                    yield x

        for k, level in enumerate((0, 0, 1, 1, 2)):
            yield from below(self._le(raw, self.FIRST + 4 * self.OWN + 4 * k, 4), level)

    def content(self, raw: bytes) -> bytes:
        size = self._le(raw, 16, 8)
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        if raw[3] & 2:  # inside the inode, behind a word that is kept free
            at = self.FIRST + self._extra(raw) + 4
            return raw[at : at + size]
        return b"".join(self._block(p) if 0 < p < 0xFFFFFFFF else bytes(self.SIZE) for _, p in zip(range(-(-size // self.SIZE)), self.blocks(raw)))[:size]

    def entries(self, raw: bytes) -> Iterator[tuple[str, int]]:
        """Slots of eight bytes of names, a bit for each that is used, and a record for each that a name begins in."""
        if raw[3] & 4:
            extra = self._extra(raw)
            room = 4 * (self.OWN - 50 - 1) - extra
            n = room * 8 // (19 * 8 + 1)
            yield from self._slots(raw[self.FIRST + extra + 4 :][:room], n, room - 19 * n)
            return
        for p in self.blocks(raw):
            if p in (0, 0xFFFFFFFF):
                return
            yield from self._slots(self._block(p), 214, 30)

    def _slots(self, page: bytes, n: int, table: int) -> Iterator[tuple[str, int]]:
        k = 0
        while k < n:
            if not page[k // 8] >> k % 8 & 1:
                k += 1
                continue
            number, size = self._le(page, table + 11 * k + 4, 4), self._le(page, table + 11 * k + 8, 2)
            at = table + 11 * n + 8 * k
            yield page[at : at + size].decode("utf-8", "surrogateescape"), number
            k += max(1, -(-size // 8))

    def files(self) -> Iterator[File]:
        todo, seen = [("", self.root)], set()
        while todo:
            path, number = todo.pop()
            raw = self.node(number)
            kind = self._le(raw, 0, 2) >> 12
            if kind == 4 and number not in seen:
                seen.add(number)
                todo += [(f"{path}/{name}".lstrip("/"), k) for name, k in reversed(list(self.entries(raw))) if name not in ("", ".", "..") and "/" not in name]
            elif kind in (8, 10) and path:
                yield safe_path(path), "file" if kind == 8 else "symlink", self.content(raw)


@_extractor("f2fs")
def _f2fs(data: bytes) -> Iterator[File]:
    yield from F2fs(data).files()
