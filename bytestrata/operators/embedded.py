"""Unpacking of flash stores, cabinets, compound files and verified-boot metadata. Importing this module registers its extractors and validators."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions import checksums, codecs, lzari, validators
from .extract import MOST_BYTES, File, Stop, _extractor, safe_path


def _word(data: bytes, at: int, n: int = 4, order: str = "little") -> int:
    if at < 0 or at + n > len(data):
        raise Stop("error:truncated")
    return int.from_bytes(data[at : at + n], order)


@_extractor("vbmeta")
def _vbmeta(data: bytes) -> Iterator[File]:
    """EXT-32: the public key and the descriptors, as they stand in the block behind the signatures."""
    big = lambda at: _word(data, at, 8, "big")
    base = 256 + big(12)
    for name, place, size in (("vbmeta-pubkey.bin", big(64), big(72)), ("vbmeta-descriptors.bin", big(96), big(104))):
        part = data[base + place : base + place + size]
        if size and len(part) == size:
            yield name, "file", part


# Types of entries of the key-value store.
_NVS_NUMBERS = {0x01: ("uint8_t", "<B"), 0x11: ("int8_t", "<b"), 0x02: ("uint16_t", "<H"), 0x12: ("int16_t", "<h"), 0x04: ("uint32_t", "<I"), 0x14: ("int32_t", "<i"), 0x08: ("uint64_t", "<Q"), 0x18: ("int64_t", "<q")}
_NVS_TEXT, _NVS_BLOB, _NVS_PART, _NVS_INDEX = 0x21, 0x41, 0x42, 0x48
#: FN-20: what names of keys that hold secrets have in them.
SENSITIVE = ("password", "passwd", "pswd", "pwd", "ssid", "psk", "pmk", "token", "secret", "key", "cred", "privat", "priv_", "seckey")


def is_sensitive(key: str) -> bool:
    """FN-20."""
    return any(x in key.lower() for x in SENSITIVE)


@dataclass
class Value:
    space: str
    key: str
    kind: str
    text: str
    raw: bytes = b""


def nvs(data: bytes, at: int = 0) -> list[Value]:
    """The values of a store's pages in order; blobs of several parts are put together."""
    entries, spaces = [], {}
    while at + 4096 <= len(data):
        page = data[at : at + 4096]
        at += 4096
        if page[:4] not in (b"\xfe\xff\xff\xff", b"\xfc\xff\xff\xff", b"\xf8\xff\xff\xff") or checksums.crc32_nvs(page[4:28]) != _word(page, 28):
            if page == b"\xff" * 4096:
                continue
            break
        states, k = int.from_bytes(page[32:64], "little"), 0
        while k < 126:
            e = page[64 + 32 * k : 96 + 32 * k]
            span = 1
            if states >> 2 * k & 3 == 2 and checksums.crc32_nvs(e[:4] + e[8:]) == _word(e, 4):
                span = max(1, e[2])
                key = e[8:24].split(b"\0")[0].decode("latin-1")
                if e[0] == 0 and e[1] == 1:
                    spaces[e[24]] = key
                else:
                    entries.append((e[0], e[1], e[3], key, e[24:32], page[96 + 32 * k : 64 + 32 * (k + span)]))
            k += span
    out, parts = [], {}
    for space, kind, chunk, key, body, more in entries:
        name = spaces.get(space, f"#{space}")
        if kind in _NVS_NUMBERS:
            label, how = _NVS_NUMBERS[kind]
            out.append(Value(name, key, label, str(struct.unpack_from(how, body)[0])))
        elif kind in (_NVS_TEXT, _NVS_BLOB, _NVS_PART):
            raw = more[: _word(body, 0, 2)]
            if len(raw) < _word(body, 0, 2) or checksums.crc32_nvs(raw) != _word(body, 4):
                continue
            if kind == _NVS_PART:
                parts[name, key, chunk] = raw
            elif kind == _NVS_TEXT:
                out.append(Value(name, key, "string", '"' + raw.split(b"\0")[0].decode("utf-8", "replace") + '"'))
            else:
                out.append(Value(name, key, "blob", f"{len(raw)} bytes", raw))
    for space, kind, _, key, body, _ in entries:
        if kind == _NVS_INDEX:
            name = spaces.get(space, f"#{space}")
            chunks = [parts.get((name, key, body[5] + k)) for k in range(body[4])]
            if None not in chunks:
                raw = b"".join(chunks)[: _word(body, 0)]
                out.append(Value(name, key, "blob", f"{len(raw)} bytes", raw))
    return out


@_extractor("esp32_nvs")
def _esp32_nvs(data: bytes) -> Iterator[File]:
    """EXT-26: all values as lines of text, those that may be secrets named first, and each blob."""
    values = nvs(data)
    if not values:
        raise Stop("error:no-keys")
    secret = [f"{v.space}:{v.key}" for v in values if is_sensitive(v.key)]
    lines = [f"# sensitive keys: {' '.join(secret)}"] if secret else []
    lines += [f"{v.space}:{v.key} = {v.text} ; {v.kind}" for v in values]
    yield "nvs-values.txt", "file", "".join(x + "\n" for x in lines).encode()
    for v in values:
        if v.raw:
            token = "".join(c if c.isascii() and c.isalnum() else "_" for c in f"{v.space}.{v.key}".replace(".", "\0")).replace("\0", ".")
            yield f"blobs/{token}.bin", "file", v.raw


@dataclass
class _Entry:
    """What the tags of one id say."""

    kind: int = -1
    name: str = ""
    inline: bytes | None = None
    places: tuple[int, int] | None = None  # of a directory's pair, or a file's last block and size


class Littlefs:
    """EXT-23: metadata pairs, whose commits are replayed, and files as lists that skip backwards."""

    def __init__(self, data: bytes):
        self.data, self.block = data, min(len(data), 8192)
        first = self._fetch(0)
        top = first[1].get(0) if first else None
        if top is None or top.name != "littlefs" or not top.inline or len(top.inline) < 24:
            raise Stop("error:bad-superblock")
        _, self.block, self.blocks = struct.unpack_from("<3I", top.inline)
        if not 128 <= self.block <= 1 << 20 or self.block & (self.block - 1):
            raise Stop("error:bad-superblock")

    def _fetch(self, block: int) -> tuple[int, dict[int, _Entry], tuple[int, int] | None] | None:
        """Revision, entries and the rest of a directory after a block's last good commit."""
        raw = self.data[block * self.block : (block + 1) * self.block]
        if len(raw) < 16:
            return None
        at, before, since = 4, 0xFFFFFFFF, 0
        now: dict[int, _Entry] = {}
        tail = done = None
        while at + 4 <= len(raw):
            tag = int.from_bytes(raw[at : at + 4], "big") ^ before
            if tag >> 31:
                break
            kind, id_, size = tag >> 20 & 0x7FF, tag >> 10 & 0x3FF, tag & 0x3FF
            body = raw[at + 4 : at + 4 + (0 if size == 0x3FF else size)]
            if kind >> 8 == 5 and kind != 0x5FF:
                if checksums.crc32_raw(raw[since : at + 4], 0xFFFFFFFF) != _word(raw, at + 4):
                    break
                done = (_word(raw, 0), {k: _Entry(**vars(e)) for k, e in now.items()}, tail)
                at += 4 + size
                since, before = at, tag ^ (kind & 1) << 31
                continue
            self._apply(now, kind, id_, body)
            if kind == 0x601 and len(body) >= 8:
                tail = struct.unpack_from("<II", body)
            before, at = tag, at + 4 + len(body)
        return done

    @staticmethod
    def _apply(now: dict[int, _Entry], kind: int, id_: int, body: bytes) -> None:
        if kind in (0x401, 0x4FF):  # ids from here on move by one
            later = {k: now.pop(k) for k in sorted(now) if k >= id_}
            step = 1 if kind == 0x401 else -1
            now.update({k + step: e for k, e in later.items() if kind == 0x401 or k > id_})
            if kind == 0x401:
                now[id_] = _Entry()
        elif kind >> 8 == 0:
            e = now.setdefault(id_, _Entry())
            e.kind, e.name = kind & 0xFF, body.decode("utf-8", "replace")
        elif kind == 0x201:
            now.setdefault(id_, _Entry()).inline = body
        elif kind in (0x200, 0x202) and len(body) >= 8:
            e = now.setdefault(id_, _Entry())
            e.places, e.inline = struct.unpack_from("<II", body), None

    def pair(self, a: int, b: int):
        """The newer of two blocks that can be read; revisions wrap."""
        found = [x for x in (self._fetch(a), self._fetch(b)) if x]
        if len(found) == 2:
            return found[1] if 0 < (found[1][0] - found[0][0]) & 0xFFFFFFFF < 1 << 31 else found[0]
        return found[0] if found else None

    def content(self, last: int, size: int) -> bytes:
        """Block k begins with as many pointers as k has trailing zero bits, and one; the first leads to the block before."""
        room, k, left = self.block, 0, size
        heads = []  # pointers' bytes of each block
        while left > 0:
            heads.append(4 * ((k & -k).bit_length() if k else 0))
            left -= room - heads[-1]
            k += 1
        parts = []
        for k in range(len(heads) - 1, -1, -1):
            if last >= self.blocks:
                raise Stop("error:bad-pointer")
            parts.append(self.data[last * room + heads[k] : (last + 1) * room])
            last = _word(self.data, last * room) if k else 0
        return b"".join(reversed(parts))[:size]

    def files(self) -> Iterator[File]:
        todo, seen = [("", (0, 1))], set()
        while todo:
            path, places = todo.pop()
            if places in seen:
                continue
            seen.add(places)
            got = self.pair(*places)
            if not got:
                continue
            for _, e in sorted(got[1].items()):
                if e.kind not in (1, 2) or e.name in ("", ".", "..") or "/" in e.name:
                    continue
                name = f"{path}/{e.name}".lstrip("/")
                if e.kind == 2 and e.places:
                    todo.append((name, e.places))
                elif e.kind == 1:
                    yield safe_path(name), "file", e.inline if e.inline is not None else self.content(*e.places) if e.places else b""
            if got[2]:
                todo.append((path, got[2]))


@_extractor("littlefs")
def _littlefs(data: bytes) -> Iterator[File]:
    yield from Littlefs(data).files()


@dataclass
class _Object:
    name: str = ""
    size: int = -1
    pages: dict[int, bytes] = field(default_factory=dict)

    def content(self) -> bytes | None:
        parts, k = [], 0
        while sum(map(len, parts)) < self.size:
            if k not in self.pages:
                return None
            parts.append(self.pages[k])
            k += 1
        return b"".join(parts)[: self.size]


def _spiffs_at(data: bytes, page: int, block: int) -> dict[int, _Object]:
    """Objects by id: pages of data, and index headers with name and size; deleted and unfinished pages don't count."""
    found: dict[int, _Object] = {}
    skip = -(-block // page * 2 // page)
    for at in range(0, len(data), page):
        if at % block < skip * page:
            continue
        id_, span, flags = _word(data, at, 2), _word(data, at + 2, 2), data[at + 4]
        if id_ == 0xFFFF or flags & 1 or not flags & 0x80:
            continue
        if not id_ & 0x8000:
            found.setdefault(id_, _Object()).pages[span] = data[at + 5 : at + page]
        elif span == 0 and not flags & 2:
            o, raw = found.setdefault(id_ & 0x7FFF, _Object()), data[at + 13 : at + 45].split(b"\0")[0]
            if raw and all(0x20 <= c < 0x7F for c in raw) and _word(data, at + 8) <= len(data):
                o.name, o.size = raw.decode(), _word(data, at + 8)
    return {k: o for k, o in found.items() if o.name}


def spiffs(data: bytes) -> tuple[int, int, dict[int, _Object]] | None:
    """Page and block size, which stand nowhere, and the objects: those that complete most files, then most bytes."""
    best, score = None, (0, 0)
    for page in (256, 512, 128, 1024, 2048):
        for block in dict.fromkeys((16 * page, 4096, 8192, 65536, 8 * page, 32 * page)):  # of equal ones the first
            if block < 2 * page or block % page or not data or len(data) % block:
                continue
            objects = _spiffs_at(data, page, block)
            bodies = [b for o in objects.values() if (b := o.content()) is not None]
            now = (len(bodies), sum(map(len, bodies)))
            if now > score:
                best, score = (page, block, objects), now
    return best


def _spiffs_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-28: at least one whole file; the store is the whole blob."""
    if len(data) > 64 << 20:
        return False
    try:
        found = spiffs(data)
    except Stop:
        return False
    return bool(found) and validators._set(f, validators.CONSISTENT, len(data), offset=0, label=f"page {found[0]}/block {found[1]}")


validators.KNOWN["spiffs"] = _spiffs_valid


@_extractor("spiffs")
def _spiffs(data: bytes) -> Iterator[File]:
    """EXT-24."""
    found = spiffs(data)
    if not found:
        raise Stop("error:no-geometry")
    missing = False
    for _, o in sorted(found[2].items()):
        body = o.content()
        if body is None:
            missing = True
        else:
            yield safe_path(o.name), "file", body
    if missing:
        raise Stop("error:missing-pages")


@_extractor("exfat")
def _exfat(data: bytes) -> Iterator[File]:
    """EXT-19: sets of directory entries: a file's, its stream's, its name's."""
    sector, cluster = 1 << data[108], 1 << data[108] + data[109]
    fat, heap = _word(data, 80) * sector, _word(data, 88) * sector

    def content(first: int, size: int, whole: bool) -> bytes:
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        if whole:
            at = heap + (first - 2) * cluster
            return data[at : at + size]
        out, seen = bytearray(), set()
        while 2 <= first < 0xFFFFFFF7 and first not in seen and (size < 0 or len(out) < size):
            seen.add(first)
            at = heap + (first - 2) * cluster
            out += data[at : at + cluster]
            first = _word(data, fat + 4 * first)
        return bytes(out if size < 0 else out[:size])

    todo, seen = [("", _word(data, 96), -1, False)], set()
    while todo:
        path, first, size, whole = todo.pop()
        if first in seen:
            continue
        seen.add(first)
        raw = content(first, size, whole)
        for at in range(0, len(raw) - 31, 32):
            if not raw[at]:
                break
            if raw[at] != 0x85 or raw[at + 32 : at + 33] != b"\xc0":
                continue
            stream, n = raw[at + 32 : at + 64], raw[at + 1]
            name = b"".join(raw[at + 32 * k + 2 : at + 32 * k + 32] for k in range(2, n + 1)).decode("utf-16-le", "replace")[: stream[3]]
            full, place = f"{path}/{name}".lstrip("/"), (_word(stream, 20), _word(stream, 24, 8), bool(stream[1] & 2))
            if raw[at + 4] & 0x10:
                todo.append((full, *place))
            else:
                body = content(*place) if place[1] else b""
                yield safe_path(full), "file", body[: _word(stream, 8, 8)].ljust(place[1], b"\0")


@_extractor("cab")
def _cab(data: bytes) -> Iterator[File]:
    """EXT-2, COD-9: each folder's blocks give one run of bytes, of which the files are parts; MSZIP blocks see the 32 KiB before, LZX is one stream."""
    folders, files, reserve, _ = validators.cab_tables(data, 0)
    opened: dict[int, bytes] = {}
    failed = ""
    for name, size, place, number in files:
        if number >= len(folders):  # goes on in another cabinet
            failed = "error:spanned"
            continue
        if number not in opened:
            try:
                opened[number] = _folder(data, *folders[number], reserve)
            except Stop as e:
                failed, opened[number] = str(e), b""
        body = opened[number][place : place + size]
        if len(body) == size:
            yield safe_path(name), "file", body
    if failed:
        raise Stop(failed)


def _folder(data: bytes, first: int, blocks: int, codec: int, reserve: int) -> bytes:
    """The bytes of a folder: its blocks as they are, inflated one by one, or as one stream."""
    out, at, stored, total = bytearray(), first, [], 0
    for _ in range(blocks):
        check, packed, plain = struct.unpack_from("<IHH", data, at)
        raw = data[at + 8 + reserve : at + 8 + reserve + packed]
        at += 8 + reserve + packed
        total += plain
        if len(raw) < packed or (check and check != cab_checksum(raw, struct.pack("<HH", packed, plain))):
            raise Stop("error:checksum")
        if total > MOST_BYTES:
            raise Stop("error:too-large")
        if codec & 15 == 0:
            out += raw
        elif codec & 15 == 1:
            if raw[:2] != b"CK":
                raise Stop("error:corrupt")
            part = zlib.decompressobj(-15, zdict=bytes(out[-32768:])) if out else zlib.decompressobj(-15)
            out += part.decompress(raw[2:], plain)
        elif codec & 15 == 3:
            stored.append(raw)
        else:
            raise Stop("unsupported:quantum")
    if stored:
        try:
            return codecs.lzx(b"".join(stored), codec >> 8 & 31, total)
        except codecs.Corrupt as e:
            raise Stop("error:corrupt") from e
    return bytes(out)


def cab_checksum(body: bytes, head: bytes) -> int:
    """All words of a block combined by exclusive or, the last bytes from the top down, and its two sizes."""
    out = 0
    whole = len(body) // 4 * 4
    for (x,) in struct.iter_unpack("<I", body[:whole]):
        out ^= x
    out ^= int.from_bytes(body[whole:], "big")
    return out ^ int.from_bytes(head, "little")


def _msi_name(name: str) -> str:
    """Names of installer tables: one character stands for two of an alphabet of 64."""
    letters, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._", ""
    for c in map(ord, name):
        if 0x3800 <= c < 0x4800:
            out += letters[c - 0x3800 & 63] + letters[(c - 0x3800) >> 6 & 63]
        elif 0x4800 <= c < 0x4840:
            out += letters[c - 0x4800]
        elif c != 0x4840:
            out += chr(c)
    return out


class Compound:
    """A compound file: sectors in chains, a tree of storages and streams, small streams in a stream of their own."""

    def __init__(self, data: bytes):
        self.data, self.sector = data, 1 << _word(data, 30, 2)
        if not 512 <= self.sector <= 4096:
            raise Stop("error:sector-size")
        places = [_word(data, 76 + 4 * k) for k in range(109)]
        link, seen = _word(data, 68), set()
        while link < 0xFFFFFFFA and link not in seen:
            seen.add(link)
            row = struct.unpack(f"<{self.sector // 4}I", self._at(link).ljust(self.sector, b"\xff"))
            places += row[:-1]
            link = row[-1]
        self.next: list[int] = []
        for p in places[: max(0, _word(data, 44))]:
            if p < 0xFFFFFFFA:
                self.next += struct.unpack(f"<{self.sector // 4}I", self._at(p).ljust(self.sector, b"\xff"))
        raw = self._chain(_word(data, 48))
        self.entries = [raw[k : k + 128] for k in range(0, len(raw) - 127, 128)]
        if not self.entries or self.entries[0][66] != 5:
            raise Stop("error:no-root")
        small = self._chain(_word(data, 60))
        self.small_next = struct.unpack(f"<{len(small) // 4}I", small)
        self.small = self._chain(_word(self.entries[0], 116))
        used = [k for k, n in enumerate(self.next) if n != 0xFFFFFFFF]
        self.span = (max(used, default=-1) + 2) * self.sector

    def _at(self, number: int) -> bytes:
        return self.data[(number + 1) * self.sector : (number + 2) * self.sector]

    def _chain(self, first: int) -> bytes:
        out, seen = [], set()
        while first < len(self.next) and first not in seen:
            seen.add(first)
            out.append(self._at(first))
            first = self.next[first]
        return b"".join(out)

    def stream(self, e: bytes) -> bytes:
        first, size = _word(e, 116), _word(e, 120, 8) if self.sector > 512 else _word(e, 120)
        if size >= 4096:
            return self._chain(first)[:size]
        out, seen = [], set()
        while first < len(self.small_next) and first not in seen:
            seen.add(first)
            out.append(self.small[64 * first : 64 * first + 64])
            first = self.small_next[first]
        return b"".join(out)[:size]

    def walk(self) -> Iterator[tuple[str, bytes]]:
        """(path, entry) of all storages and streams, siblings in the order of their tree."""
        todo, seen = [("", _word(self.entries[0], 76))], set()
        while todo:
            path, k = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            name = _msi_name(e[: max(0, _word(e, 64, 2) - 2)].decode("utf-16-le", "replace"))
            full = f"{path}/{name}".lstrip("/")
            todo += [(path, _word(e, 72)), (path, _word(e, 68))]
            if e[66] == 1:
                todo.append((full, _word(e, 76)))
            if e[66] in (1, 2):
                yield full, e


def _cfbf_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-3."""
    try:
        c = Compound(data[f.offset :])
        kinds = [e[66] for _, e in c.walk()]
    except (Stop, struct.error, IndexError):
        return False
    streams, avail = kinds.count(2), len(data) - f.offset
    label = f"{kinds.count(1)} storages, {streams} streams"
    return streams > 0 and validators._set(f, validators.VERIFIED if c.span <= avail else validators.CONSISTENT, min(c.span, avail), version=f"{fields['version_major']}.{fields['version_minor']}", label=label)


validators.KNOWN["cfbf"] = _cfbf_valid


@_extractor("cfbf")
def _cfbf(data: bytes) -> Iterator[File]:
    """EXT-3."""
    c = Compound(data)
    for path, e in c.walk():
        if e[66] == 2:
            clean = "".join(ch if ch.isprintable() and ch != "\\" else "_" for ch in path)
            yield safe_path(clean), "file", c.stream(e)


def _sections(data: bytes, at: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, flags, size, where the stored bytes begin, how many) of a firmware package's sections."""
    at += 41
    for _ in range(256):
        n = int.from_bytes(data[at : at + 4], "little")
        name = data[at + 4 : at + 4 + n]
        if at + 16 + n > len(data) or not 1 <= n <= 64 or not all(0x20 <= c < 0x7F for c in name):
            return
        flags, size, stored = struct.unpack_from("<III", data, at + 4 + n)
        at += 16 + n
        if flags > 1 or stored > len(data) - at:
            return
        yield name.decode(), flags, size, at, stored
        at += stored


def _rae_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-27: sections one behind the other, up to the end of the file."""
    rows = list(_sections(data, f.offset))
    if data[f.offset + 22 : f.offset + 25] != b"RAE" or not rows:
        return False
    end = rows[-1][3] + rows[-1][4]
    return validators._set(f, validators.VERIFIED if end == len(data) else validators.CONSISTENT, end - f.offset, version="1", label=rows[0][0], compression="lzari" if any(r[1] for r in rows) else "none")


validators.KNOWN["rae_rfp"] = _rae_valid


@_extractor("rae_rfp")
def _rae_rfp(data: bytes) -> Iterator[File]:
    """EXT-27: a section that can't be decoded is given as it is stored."""
    seen: dict[str, int] = {}
    failed = False
    for name, flags, size, at, stored in _sections(data, 0):
        name = "".join(c if c.isalnum() or c in "._-" else "_" for c in name)
        n = seen[name] = seen.get(name, 0) + 1
        body = data[at : at + stored]
        if flags:
            try:
                plain = lzari.decompress(body, 256 << 20)
            except lzari.Corrupt:
                plain = b""
            failed |= len(plain) != size
            body = plain if len(plain) == size else body
        yield safe_path(name if n == 1 else f"{name}_{n - 1}"), "file", body
    if not seen:
        raise Stop("error:no-sections")
    if failed:
        raise Stop("error:lzari")


@dataclass
class Yaffs:
    """How a dump is laid out: bytes of a page and of its spare area, where the tags stand in it, and their byte order."""

    page: int
    spare: int
    tags: int
    order: str


#: Layouts that are tried, the common ones first.
_YAFFS = [Yaffs(page, spare, tags, order) for page, spare in ((2048, 64), (4096, 128), (4096, 256), (8192, 256), (512, 16), (1024, 32)) for order in ("little", "big") for tags in (0, 2) if tags + 16 <= spare]


def _yaffs_tags(data: bytes, at: int, how: Yaffs) -> tuple[int, int, int, int]:
    """Sequence, object, chunk and bytes of the page at a place; the top bits of packed headers carry the parent and the type."""
    raw = data[at + how.page + how.tags :][:16]
    seq, id_, chunk, n = (int.from_bytes(raw[4 * k : 4 * k + 4], how.order) for k in range(4))
    if chunk & 0x80000000:
        id_, chunk = id_ & 0x0FFFFFFF, 0
    return seq, id_, chunk, n


def _yaffs_head(data: bytes, at: int, order: str) -> tuple[int, int, str] | None:
    """Type, parent and name of the object header at a place."""
    if at + 512 > len(data) or data[at + 8 : at + 10] != b"\xff\xff":
        return None
    kind, parent = _word(data, at, 4, order), _word(data, at + 4, 4, order)
    name = data[at + 10 : at + 265].split(b"\0")[0]
    if not 1 <= kind <= 5 or not 0 < parent < 1 << 18 or any(c < 0x20 or c == 0x7F or c == 0x2F for c in name) or (not name and kind != 3):
        return None
    return kind, parent, name.decode("utf-8", "replace")


def yaffs_layout(data: bytes, at: int) -> Yaffs | None:
    """The layout under which most of the pages that follow an object header are in sequence, or none."""
    best, most = None, 0
    for how in _YAFFS:
        if not _yaffs_head(data, at, how.order):
            continue
        n, step = 0, how.page + how.spare
        for k in range(at, min(at + 256 * step, len(data) - step + 1), step):
            seq, id_, chunk, size = _yaffs_tags(data, k, how)
            if data[k : k + 16] == b"\xff" * 16 and seq == 0xFFFFFFFF:
                continue
            if not (0x1000 <= seq < 0xEFFFFF00 and 0 < id_ < 1 << 18 and chunk < 1 << 20 and (size <= how.page or chunk == 0)):
                break
            if chunk == 0 and not _yaffs_head(data, k, how.order):
                break
            n += 1
        if n > most:
            best, most = how, n
    return best


def _yaffs_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-46: an object header, and pages with tags behind it; a dump without spare areas is told by headers alone."""
    order = next((o for o in ("little", "big") if _yaffs_head(data, f.offset, o)), None)
    if not order:
        return False
    how = yaffs_layout(data, f.offset)
    if not how:
        page = next((p for p in (2048, 4096, 512, 1024, 8192) if _yaffs_head(data, f.offset + p, order)), 0)
        if not page:
            return False
        f.diagnostics.append(("warning", "yaffs2-no-oob", "no spare areas in this dump, so its files can't be put together"))
        return validators._set(f, validators.STRUCTURAL, 0, endian=order)
    step, end = how.page + how.spare, f.offset
    while end + step <= len(data):
        seq, id_, _, _ = _yaffs_tags(data, end, how)
        if not (seq == 0xFFFFFFFF or (0x1000 <= seq < 0xEFFFFF00 and 0 < id_ < 1 << 18)):
            break
        end += step
    return validators._set(f, validators.STRUCTURAL, end - f.offset, endian=how.order, label=f"page {how.page}, spare {how.spare}")


validators.KNOWN["yaffs2"] = _yaffs_valid


@_extractor("yaffs2")
def _yaffs2(data: bytes) -> Iterator[File]:
    """EXT-37: of each chunk of an object the last one written counts; a shrunk or deleted object says so in its last header."""
    how = yaffs_layout(data, 0)
    if not how:
        raise Stop("error:no-oob")
    order, step = how.order, how.page + how.spare
    heads: dict[int, tuple[int, int, str, int, bytes]] = {}
    chunks: dict[tuple[int, int], bytes] = {}
    pages = [(_yaffs_tags(data, at, how), at) for at in range(0, len(data) - step + 1, step)]
    for (_, id_, chunk, n), at in sorted(((t, at) for t, at in pages if 0x1000 <= t[0] < 0xEFFFFF00), key=lambda x: (x[0][0], x[1])):
        if chunk:
            chunks[id_, chunk] = data[at : at + min(n, how.page)]
        elif head := _yaffs_head(data, at, order):
            size = _word(data, at + 292, 4, order)
            heads[id_] = (*head, 0 if size == 0xFFFFFFFF else size, data[at + 300 : at + 460].split(b"\0")[0])

    def path(id_: int) -> str | None:
        parts, seen = [], set()
        while id_ != 1:
            if id_ not in heads or id_ in seen or heads[id_][1] in (3, 4):  # 3 and 4: what is unlinked or deleted
                return None
            seen.add(id_)
            parts.append(heads[id_][2])
            id_ = heads[id_][1]
        return "/".join(reversed(parts))

    for id_, (kind, _, _, size, link) in sorted(heads.items()):
        where = path(id_) if id_ > 1 else None
        if not where or kind not in (1, 2):
            continue
        if kind == 2:
            yield safe_path(where), "symlink", link
            continue
        if size > MOST_BYTES:
            raise Stop("error:too-large")
        out = b"".join(chunks.get((id_, k), b"").ljust(how.page, b"\0") for k in range(1, -(-size // how.page) + 1))
        yield safe_path(where), "file", out[:size]


# Types of registry values, and the bounds of a record.
_REGISTRY = {1: "REG_SZ", 2: "REG_EXPAND_SZ", 3: "REG_BINARY", 4: "REG_DWORD", 5: "REG_DWORD_BE", 7: "REG_MULTI_SZ", 11: "REG_QWORD"}
_HIVE_START, _HIVE_NAME, _HIVE_DATA = 64, 64, 0x4000
_HIVE_CHARS = re.compile(r"[A-Za-z0-9_\-. :\\/#@()\[\]{}$%+*?!,']+")


def registry_values(data: bytes, most: int) -> Iterator[tuple[int, str, str, str]]:
    """(place, name, type, text) of what looks like a record at any even place: type, length of data, of name, name, data.

    Cells aren't walked, so values have no path; a place that only looks like a record hides none behind it.
    """
    for at in range(_HIVE_START, len(data) - 5, 2):
        kind, size, n = struct.unpack_from("<HHH", data, at)
        if kind not in _REGISTRY or not 0 < n <= _HIVE_NAME or not 0 < size <= _HIVE_DATA or {4: 4, 5: 4, 11: 8}.get(kind, size) != size:
            continue
        raw, body = data[at + 6 : at + 6 + 2 * n], data[at + 6 + 2 * n : at + 6 + 2 * n + size]
        if len(body) < size:
            continue
        name = raw.decode("utf-16-le", "replace")
        if not _HIVE_CHARS.fullmatch(name):
            continue
        if kind in (1, 2, 7):
            text = body[: size // 2 * 2].decode("utf-16-le", "replace").replace("\0", "|").rstrip("|")
        elif kind in (4, 11):
            text = str(int.from_bytes(body, "little"))
        else:
            text = body.hex()
        yield at, name, _REGISTRY[kind], text
        most -= 1
        if not most:
            return


def _hive_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-43: at least eight values; the hive is the rest of the blob."""
    n = sum(1 for _ in registry_values(data[f.offset :], 4096))
    return n >= 8 and validators._set(f, validators.CONSISTENT, len(data) - f.offset, label=f"{n}{'+' * (n == 4096)} values")


validators.KNOWN["wince_hive"] = _hive_valid


@_extractor("wince_hive")
def _wince_hive(data: bytes) -> Iterator[File]:
    """EXT-30: a line a value: place, name, type and text."""
    lines = [f"0x{at:08x}  {name}  {kind}  {text.translate(_ONE_LINE)}\n" for at, name, kind, text in registry_values(data, 1 << 20)]
    if not lines:
        raise Stop("error:no-values")
    yield "registry-values.txt", "file", "".join(lines).encode("utf-8", "replace")


_ONE_LINE = {**dict.fromkeys([*range(0x20), 0x7F], "."), 9: "\\t", 10: "\\n", 13: "\\r"}
