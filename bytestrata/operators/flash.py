"""UBI images and UBIFS: newest copies win. Importing this module registers its extractors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard

from ..functions import checksums, lzo
from .extract import MOST_BYTES, File, Stop, _extractor, safe_path

#: The volume that holds the table of volumes, and a record's size in it.
LAYOUT, RECORD = 0x7FFFEFFF, 172


@dataclass
class Image:
    """INT-9's parse of an image: where its erase blocks are and what each holds."""

    start: int
    peb: int
    blocks: int = 0
    data_offset: int = 0
    names: dict[int, str] = field(default_factory=dict)
    #: volume -> (blocks reserved for it, whether it is static)
    kinds: dict[int, tuple[int, bool]] = field(default_factory=dict)
    #: erase block -> (volume, logical block)
    held: dict[int, tuple[int, int]] = field(default_factory=dict)

    @property
    def end(self) -> int:
        return self.start + self.blocks * self.peb

    def volume_of(self, offset: int) -> int | None:
        """JOI-5: the number of the volume that the byte belongs to."""
        held = self.held.get((offset - self.start) // self.peb) if self.start <= offset < self.end else None
        return held[0] if held else None

    def volume_at(self, offset: int) -> str | None:
        """The name of the volume that the byte belongs to."""
        return self.names.get(self.volume_of(offset))

    def room(self, volume: int) -> int:
        """The bytes reserved for a volume."""
        return self.kinds.get(volume, (0, False))[0] * (self.peb - self.data_offset)

    def note(self, data: bytes, volume: int) -> str:
        """What a volume's first block begins like, or else its kind."""
        at = next((self.start + k * self.peb + self.data_offset for k, key in self.held.items() if key == (volume, 0)), None)
        head = data[at : at + 4] if at is not None else b""
        known = {b"hsqs": "squashfs", b"sqsh": "squashfs", b"\x31\x18\x10\x06": "ubifs", b"\x27\x05\x19\x56": "uimage", b"\xd0\x0d\xfe\xed": "dtb"}  # Fixed values: first bytes of what volumes hold
        return known.get(head) or ("static" if self.kinds.get(volume, (0, False))[1] else "dynamic")


def parse(data: bytes, start: int = 0) -> Image:
    """The image that begins at start; of two copies of a logical block the one with the higher sequence number counts."""
    following = data.find(b"UBI#", start + 64)
    while following >= 0 and not (following - start) % 2048 == 0:
        following = data.find(b"UBI#", following + 4)
    peb = (following if following >= 0 else len(data)) - start
    if peb < 4096:
        raise Stop("error:erase-block")
    image, newest, table, layout = Image(start, peb), {}, b"", (-1, -1)
    for k in range((len(data) - start) // peb):
        at = start + k * peb
        if data[at : at + 4] != b"UBI#":
            if data[at : at + 64] == b"\xff" * 64:
                image.blocks = k + 1
                continue
            break
        image.blocks = k + 1
        vid, body = struct.unpack_from(">II", data, at + 16)
        image.data_offset = image.data_offset or body
        head = data[at + vid : at + vid + 64]
        if head[:4] != b"UBI!" or checksums.crc32_ubi(head[:60]) != int.from_bytes(head[60:], "big"):
            continue
        volume, number = struct.unpack_from(">II", head, 8)
        (order,) = struct.unpack_from(">Q", head, 40)
        if order >= newest.get((volume, number), (-1, 0))[0]:
            newest[volume, number] = (order, k)
        if volume == LAYOUT and order >= layout[0]:
            layout, table = (order, k), data[at + body : at + peb]
    image.held = {k: key for key, (_, k) in newest.items()}
    for k in range(min(128, len(table) // RECORD)):
        record = table[k * RECORD : (k + 1) * RECORD]
        if checksums.crc32_ubi(record[:168]) == int.from_bytes(record[168:], "big") and any(record[:4]):
            n = int.from_bytes(record[14:16], "big")
            image.names[k] = "".join(chr(c) if 0x20 <= c < 0x7F else "." for c in record[16 : 16 + n])
            image.kinds[k] = (int.from_bytes(record[:4], "big"), record[12] == 2)
    return image


@_extractor("ubi")
def _ubi(data: bytes) -> Iterator[File]:
    """Each volume's logical blocks in order; missing ones are erased flash."""
    image = parse(data)
    room = image.peb - image.data_offset
    volumes: dict[int, dict[int, int]] = {}
    for k, (volume, number) in image.held.items():
        if volume != LAYOUT:
            volumes.setdefault(volume, {})[number] = k
    for volume, blocks in sorted(volumes.items()):
        if (max(blocks) + 1) * room > MOST_BYTES:
            raise Stop("error:too-large")
        parts = []
        for number in range(max(blocks) + 1):
            at = image.start + blocks[number] * image.peb if number in blocks else None
            parts.append(data[at + image.data_offset : at + image.peb] if at is not None else b"\xff" * room)
        yield safe_path(f"{image.names.get(volume) or f'volume-{volume}'}.img"), "file", b"".join(parts)


def _open(codec: int, raw: bytes, size: int) -> bytes:
    if codec == 0:
        return raw
    if codec == 1:
        return lzo.decompress(raw, size)
    if codec == 2:
        return zlib.decompress(raw, -15)
    if codec == 3:
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    raise Stop(f"unsupported:{codec}")


@_extractor("ubifs")
def _ubifs(data: bytes) -> Iterator[File]:
    """All leaf nodes with a right CRC, the newest of each key; inodes that no name reaches go to lost+found."""
    inodes: dict[int, tuple[int, int, int, bytes]] = {}
    blocks: dict[tuple[int, int], tuple[int, int, int, bytes]] = {}
    names: dict[tuple[int, bytes], tuple[int, int]] = {}
    at = 0
    while (at := data.find(b"\x31\x18\x10\x06", at)) >= 0:
        if at + 24 > len(data):
            break
        crc, order, size, kind = struct.unpack_from("<IQIB", data, at + 4)
        node = data[at : at + size]
        if size < 24 or len(node) < size or checksums.crc32_ubi(node[8:]) != crc:
            at += 4
            continue
        at += (size + 7) // 8 * 8
        if kind > 2 or size < 48:
            continue
        number, low = struct.unpack_from("<II", node, 24)
        if kind == 0 and order >= inodes.get(number, (-1,))[0]:
            inodes[number] = (order, int.from_bytes(node[104:108], "little"), int.from_bytes(node[48:56], "little"), node[160 : 160 + int.from_bytes(node[112:116], "little")])
        elif kind == 1 and order >= blocks.get((number, low & 0x1FFFFFFF), (-1,))[0]:
            plain, codec = struct.unpack_from("<IH", node, 40)
            blocks[number, low & 0x1FFFFFFF] = (order, plain, codec, node[48:])
        elif kind == 2:
            (target,) = struct.unpack_from("<Q", node, 40)
            n = int.from_bytes(node[50:52], "little")
            name = node[56 : 56 + n]
            if order >= names.get((number, name), (-1, 0))[0]:
                names[number, name] = (order, target)
    below: dict[int, list[tuple[str, int]]] = {}
    for (parent, name), (_, target) in sorted(names.items()):
        if target:
            below.setdefault(parent, []).append((name.decode("latin-1"), target))

    def content(number: int, size: int) -> bytes:
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        out = bytearray(size)
        for k in range(-(-size // 4096)):
            if (number, k) in blocks:
                _, plain, codec, raw = blocks[number, k]
                part = _open(codec, raw, plain)[: size - 4096 * k]
                out[4096 * k : 4096 * k + len(part)] = part
        return bytes(out)

    reached, todo = {1}, [("", 1)]
    found: list[tuple[str, int]] = []
    while todo:
        path, folder = todo.pop()
        for name, target in below.get(folder, ()):
            full = f"{path}/{name}".lstrip("/")
            if target in inodes and inodes[target][1] >> 12 == 4:
                if target not in reached:
                    todo.append((full, target))
            else:
                found.append((full, target))
            reached.add(target)
    found += [(f"lost+found/inode-{n}", n) for n, v in sorted(inodes.items()) if n not in reached and v[1] >> 12 in (8, 10)]
    for path, number in found:
        if number in inodes:
            _, mode, size, inline = inodes[number]
            if mode >> 12 == 8:
                yield safe_path(path), "file", content(number, size)
            elif mode >> 12 == 10:
                yield safe_path(path), "symlink", inline
