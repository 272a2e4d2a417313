"""Unpacking of boot images, trees, environments and flash formats. Importing this module registers its extractors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from ..functions import checksums, lzo
from .extract import MOST_BYTES, File, Stop, _extractor, safe_path


@_extractor("iso9660", "iso")
def _iso9660(data: bytes) -> Iterator[File]:
    """Directory records from the primary descriptor; Rock Ridge names and links where there are any."""
    base = data.find(b"\1CD001\1", 32768 if len(data) > 32768 else 0)
    if base < 0:
        raise Stop("error:no-descriptor")
    root = data[base + 156 : base + 190]
    todo, seen = [("", root)], set()

    def system_use(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
        jumps = 0
        while len(raw) >= 4 and raw[2] >= 4:
            kind, body = raw[:2], raw[4 : raw[2]]
            raw = raw[raw[2] :]
            if kind == b"CE" and jumps < 8:
                block, at, size = (int.from_bytes(body[k : k + 4], "little") for k in (0, 8, 16))
                raw, jumps = data[block * 2048 + at : block * 2048 + at + size], jumps + 1
            else:
                yield kind, body

    while todo:
        path, record = todo.pop()
        start, size, flags = int.from_bytes(record[2:6], "little"), int.from_bytes(record[10:14], "little"), record[25]
        if not flags & 2:
            yield safe_path(path), "file", data[start * 2048 : start * 2048 + size]
            continue
        if start in seen:
            continue
        seen.add(start)
        at, end = start * 2048, min(start * 2048 + size, len(data))
        while at < end:
            n = data[at]
            if not n:
                at = (at // 2048 + 1) * 2048
                continue
            rec = data[at : at + n]
            at += n
            name = rec[33 : 33 + rec[32]]
            if name in (b"\0", b"\1"):
                continue
            plain, link = name.split(b";")[0].decode("latin-1"), None
            rock = b""
            for kind, body in system_use(rec[33 + rec[32] + (not rec[32] & 1) :]):
                if kind == b"NM":
                    rock += body[1:]
                elif kind == b"SL":
                    link, rest = [], body[1:]
                    while len(rest) >= 2:
                        link.append({8: b"", 4: b"..", 2: b"."}.get(rest[0], rest[2 : 2 + rest[1]]))
                        rest = rest[2 + rest[1] :]
            full = f"{path}/{rock.decode('latin-1') if rock else plain.rstrip('.') or plain}".lstrip("/")
            if link is not None:
                yield safe_path(full), "symlink", b"/".join(link)
            else:
                todo.append((full, rec))


def rtime(data: bytes, size: int) -> bytes:
    """COD-17: each byte, then how many bytes follow as they did after its last occurrence."""
    out, last = bytearray(), [0] * 256
    for k in range(0, len(data) - 1, 2):
        value, again = data[k], data[k + 1]
        out.append(value)
        start, last[value] = last[value], len(out)
        for j in range(again):
            out.append(out[start + j])
        if len(out) >= size:
            break
    return bytes(out[:size])


@_extractor("jffs2")
def _jffs2(data: bytes) -> Iterator[File]:
    """The newest nodes of each inode; names from the newest directory entries."""
    e = "<" if data[:2] == b"\x85\x19" else ">"
    magic = data[:2]
    nodes: dict[int, list] = {}
    names: dict[tuple[int, bytes], tuple[int, int]] = {}
    at = 0
    while (at := data.find(magic, at)) >= 0 and at + 12 <= len(data):
        kind, total, crc = struct.unpack_from(e + "HII", data, at + 2)
        if total < 12 or checksums.crc32_jffs2(data[at : at + 8]) != crc:
            at += 4 - at % 4
            continue
        if kind == 0xE001 and at + 40 <= len(data):
            parent, version, inode, _, n = struct.unpack_from(e + "IIIIB", data, at + 12)
            name = data[at + 40 : at + 40 + n]
            if version >= names.get((parent, name), (0, 0))[0]:
                names[parent, name] = (version, inode)
        elif kind == 0xE002 and at + 68 <= len(data):
            inode, version, mode, _, _, size, _, _, _, offset, packed, plain, codec = struct.unpack_from(e + "IIIHHIIIIIIIB", data, at + 12)
            nodes.setdefault(inode, []).append((version, mode, size, offset, data[at + 68 : at + 68 + packed], plain, codec))
        at += (total + 3) // 4 * 4
    todo, seen = [("", 1)], {1}
    while todo:
        path, folder = todo.pop()
        for (parent, name), (_, inode) in sorted(names.items()):
            if parent != folder or not inode:
                continue
            full = f"{path}/{name.decode('latin-1')}".lstrip("/")
            own = sorted(nodes.get(inode, []), key=lambda n: n[0])
            mode = own[-1][1] if own else 0o040000
            if mode >> 12 == 4:
                if inode not in seen:
                    seen.add(inode)
                    todo.append((full, inode))
                continue
            size = own[-1][2]
            if size > MOST_BYTES:
                raise Stop("error:too-large")
            out = bytearray(size)
            for _, _, _, offset, raw, plain, codec in own:
                part = {0: lambda raw=raw: raw, 1: lambda plain=plain: bytes(plain), 2: lambda raw=raw, plain=plain: rtime(raw, plain), 6: lambda raw=raw: zlib.decompress(raw), 7: lambda raw=raw, plain=plain: lzo.decompress(raw, plain)}.get(codec)
                if not part:
                    raise Stop(f"unsupported:{codec}")
                part = part()[: max(0, size - offset)]
                out[offset : offset + len(part)] = part
            if mode >> 12 in (8, 10):
                yield safe_path(full), "file" if mode >> 12 == 8 else "symlink", bytes(out)


@_extractor("android_boot")
def _android_boot(data: bytes) -> Iterator[File]:
    """The parts of each header version, each on a page of its own."""
    word = lambda at: int.from_bytes(data[at : at + 4], "little")
    version = word(40)
    if version >= 3:
        parts, page = [("kernel", word(8)), ("ramdisk", word(12))] + ([("signature", word(1580))] if version >= 4 else []), 4096
    else:
        page = word(36)
        parts = [("kernel", word(8)), ("ramdisk", word(16)), ("second", word(24))]
        if version >= 1:
            parts.append(("recovery_dtbo", word(1632)))
        if version >= 2:
            parts.append(("dtb", word(1648)))
    if not page:
        raise Stop("error:page-size")
    at = page
    for name, size in parts:
        if size:
            yield name, "file", data[at : at + size]
        at += -(-size // page) * page


def tree(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(node path, property, value) of a flattened device tree."""
    structs, strings = struct.unpack_from(">II", data, 8)
    at, path = structs, []
    while at + 4 <= len(data):
        (token,) = struct.unpack_from(">I", data, at)
        at += 4
        if token == 1:
            end = data.index(b"\0", at)
            path.append(data[at:end].decode("latin-1"))
            at = (end + 4) // 4 * 4
        elif token == 2:
            path.pop()
        elif token == 3:
            size, name = struct.unpack_from(">II", data, at)
            label = data[strings + name : data.index(b"\0", strings + name)].decode("latin-1")
            yield "/".join(path).lstrip("/"), label, data[at + 8 : at + 8 + size]
            at = (at + 8 + size + 3) // 4 * 4
        elif token != 4:
            return


@_extractor("fit")
def _fit(data: bytes) -> Iterator[File]:
    """The payload of each image."""
    for path, name, value in tree(data):
        if name == "data" and path.startswith("images/") and path.count("/") == 1:
            yield safe_path(path.split("/")[1]), "file", value


@_extractor("uboot_env")
def _uboot_env(data: bytes) -> Iterator[File]:
    """The entries as lines of text, from the first that looks like one."""
    for head in (4, 5):
        entries = data[head : data.find(b"\0\0", head) if data.find(b"\0\0", head) > 0 else len(data)].split(b"\0")
        if entries and all(b"=" in e and e[:1].isalnum() for e in entries):
            yield "environment.txt", "file", b"".join(e + b"\n" for e in entries)
            return
    raise Stop("error:no-entries")
