"""Unpacking of packed programs and of firmware that is packed by formats of its own. Importing this module registers extractors and validators."""

from __future__ import annotations

import hashlib
import lzma
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions import checksums, codecs, lzo, validators
from .extract import MOST_BYTES, File, Stop, _extractor, safe_path

#: What a stream of jzlzma may give.
JZLZMA_MOST = 256 << 20


def _jzlzma_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-14: the stream gives exactly the bytes that the header declares, which chance bits don't."""
    size, dictionary = fields["uncomp_size"], fields["dict_size"]
    if size > JZLZMA_MOST:
        return False
    try:
        codecs.jzlzma(data[f.offset + 16 : f.offset + 16 + fields["payload_size"]], size)
    except codecs.Corrupt:
        return False
    unit = f"{dictionary >> 20} MiB" if dictionary >> 20 else f"{dictionary >> 10} KiB"
    return validators._set(f, validators.VERIFIED, 16 + fields["payload_size"], label=f"{size} bytes, dict {unit}")


validators.KNOWN["jzlzma"] = _jzlzma_valid


@_extractor("jzlzma")
def _jzlzma(data: bytes) -> Iterator[File]:
    """EXT-36."""
    stored, _, _, size = struct.unpack_from("<4I", data)
    if size > JZLZMA_MOST:
        raise Stop("error:too-large")
    try:
        yield "data", "file", codecs.jzlzma(data[16 : 16 + stored], size)
    except codecs.Corrupt as e:
        raise Stop("error:corrupt") from e


def vbf_blocks(data: bytes) -> tuple[bytes, bool, list[tuple[int, bytes, int]]]:
    """The header's text, whether blocks are packed, and (address, stored bytes, checksum) of each."""
    depth, at = 0, data.find(b"{")
    if at < 0:
        raise Stop("error:bad-header")
    while at < len(data):
        depth += (data[at] == ord("{")) - (data[at] == ord("}"))
        at += 1
        if not depth:
            break
    head, blocks = data[:at], []
    kind = re.search(rb"data_format_identifier\s*=\s*0x([0-9A-Fa-f]{1,2})", head)
    while at + 10 <= len(data):
        place, size = struct.unpack_from(">II", data, at)
        if not size or at + 10 + size > len(data):
            break
        blocks.append((place, data[at + 8 : at + 8 + size], int.from_bytes(data[at + 8 + size : at + 10 + size], "big")))
        at += 10 + size
    return head, bool(kind) and int(kind[1], 16) >> 4 != 0, blocks


@_extractor("vbf")
def _vbf(data: bytes) -> Iterator[File]:
    """EXT-31: the header's text and each block by its address; a block whose checksum is wrong is given as it is stored."""
    head, packed, blocks = vbf_blocks(data)
    yield "header.txt", "file", head
    wrong = False
    for place, stored, check in blocks:
        body = codecs.lzss(stored, MOST_BYTES) if packed else stored
        good = checksums.crc16_ccitt(body) == check
        wrong |= not good
        yield f"0x{place:08x}.bin", "file", body if good else stored
    if wrong:
        raise Stop("error:crc")


@dataclass
class Otra:
    """A package: partitions on flash, and segments of them packed one behind the other."""

    body: int
    version: str
    partitions: list[tuple[str, int, int, int]]  # name, place on flash, room, flags
    segments: list[tuple[int, int, int, int]]  # place in the file, place on flash, stored bytes, bytes
    whole: bool  # the segments end with the file

    def of(self, partition: tuple[str, int, int, int]) -> list[tuple[int, int, int, int]]:
        _, start, room, _ = partition
        return [s for s in self.segments if start <= s[1] < start + room]


def otra(data: bytes) -> Otra:
    """The tables of a package; one without them is a plain image of flash."""
    first, second, n, m = struct.unpack_from("<IIHH", data, 24)
    version = data[128:144].split(b"\0")[0]
    out = Otra(0x220, version.decode() if all(0x20 <= c < 0x7F for c in version) else "", [], [], False)
    at = 0x220 + first + second
    end = at + 0x34 * n + 0x20 * m
    if not 0 < n <= 64 or not 0 < m <= 512 or end > len(data):
        return out
    partitions = [struct.unpack_from("<32sQQI", data, at + 0x34 * k) for k in range(n)]
    segments = [struct.unpack_from("<4Q", data, at + 0x34 * n + 0x20 * k) for k in range(m)]
    for place, _, stored, _ in segments:
        if place != end or stored > len(data) - place:
            return out
        end = place + stored
    out.partitions = [(name.split(b"\0")[0].decode("latin-1"), *rest) for name, *rest in partitions]
    out.segments, out.whole = segments, end == len(data)
    return out


def _otra_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-25: the body runs to the end of the blob; its digest makes it sure, a gapless chain of segments likely."""
    raw = data[f.offset :]
    if fields["body_size"] != len(raw) - 0x220:
        return False
    made = otra(raw)
    for p in made.partitions:
        if own := made.of(p):
            f.members.append(validators.Member(p[0] or "part", f.offset + own[0][0], sum(s[2] for s in own), f"{len(own)} seg{'s' * (len(own) > 1)}, 0x{sum(s[3] for s in own):x} bytes{' [active]' if p[3] & 1 else ''}"))
    sure = hashlib.sha256(raw[0x220:]).digest() == raw[0x100:0x120]
    tier = validators.VERIFIED if sure else validators.CONSISTENT if made.whole else validators.STRUCTURAL
    return validators._set(f, tier, len(raw), version=made.version, compression="lzo1x" if made.segments else "none")


validators.KNOWN["otra"] = _otra_valid


@_extractor("otra")
def _otra(data: bytes) -> Iterator[File]:
    """EXT-28: an image for each partition with segments, or the plain image."""
    made = otra(data)
    if not made.segments:
        yield "flash.bin", "file", data[made.body :]
        return
    failed = False
    for k, p in enumerate(made.partitions):
        own, out = made.of(p), bytearray()
        try:
            for place, _, stored, size in own:
                if size > MOST_BYTES:
                    raise lzo.Corrupt("size")
                part = lzo.decompress(data[place : place + stored], size)
                if len(part) != size:
                    raise lzo.Corrupt("size")
                out += part
        except lzo.Corrupt:
            failed = True
            continue
        if own:
            yield safe_path(f"{k:02d}_{re.sub('[^A-Za-z0-9._-]', '_', p[0]) or 'part'}.bin"), "file", bytes(out)
    if failed:
        raise Stop("error:lzo")


# Numbers of formats and methods in the header of packed programs.
UPX_FORMATS = {9: ("PE", "i386"), 36: ("PE", "amd64"), 43: ("PE", "arm64"), 44: ("PE", "arm64"), 21: ("PE", "arm (WinCE)"), 10: ("ELF", "i386"), 12: ("ELF", "i386"), 19: ("ELF", "i386"), 20: ("ELF", "i386"), 22: ("ELF", "amd64"), 23: ("ELF", "arm"), 42: ("ELF", "arm64"), 30: ("ELF", "mipsel"), 137: ("ELF", "mips"), 132: ("ELF", "ppc32"), 133: ("ELF", "armeb"), 39: ("ELF", "ppc64le"), 140: ("ELF", "ppc64"), 45: ("ELF", "riscv64"), 29: ("Mach-O", "i386"), 34: ("Mach-O", "amd64"), 37: ("Mach-O", "arm64"), 1: ("DOS", "com"), 2: ("DOS", "sys"), 3: ("DOS", "exe")}
UPX_METHODS = {**dict.fromkeys((2, 3, 4), "NRV2B"), **dict.fromkeys((5, 6, 7), "NRV2D"), **dict.fromkeys((8, 9, 10), "NRV2E"), 14: "LZMA", 15: "deflate"}
UPX_NO_FORMATS = (6, 11, 13, 17, 38, 41, 130)


def upx_head(data: bytes, at: int) -> tuple[int, int, int, int, int, bool] | None:
    """FN-22: header bytes, version, format, method, level, and whether a checksum holds; none if it is no header."""
    if at + 32 > len(data):
        return None
    version, kind, method, level = data[at + 4 : at + 8]
    if not (1 <= kind <= 46 or 129 <= kind <= 142) or kind in UPX_NO_FORMATS:
        return None
    column = 0 if kind in (1, 2) else 1 if kind in (3, 7) else 2
    size = 24 if version <= 3 else (20, 25, 28)[column] if version <= 9 else (22, 27, 32)[column]
    if version >= 10 and sum(data[at + 4 : at + size - 1]) % 251 != data[at + size - 1]:
        return None
    width, order, first = (2, "little", 16) if kind in (1, 2) else (4, "big", 8) if kind >= 128 else (4, "little", 16)
    plain, packed = (int.from_bytes(data[at + first + k * width : at + first + (k + 1) * width], order) for k in (0, 1))
    return (size, version, kind, method, level & 15, version >= 10) if plain >= 2 and packed >= 2 else None


def _upx_valid(data: bytes, f, fields: dict) -> bool:
    """VAL-39: the pack header; from version 10 on its checksum."""
    head = upx_head(data, f.offset)
    if not head:
        return False
    size, version, kind, method, _, sure = head
    family, arch = UPX_FORMATS.get(kind, ("executable", f"format {kind}"))
    banner = re.search(rb"\$Id: UPX ([0-9][0-9A-Za-z.\-]{0,15})", data[max(0, f.offset - 16384) : f.offset])
    return validators._set(f, validators.VERIFIED if sure else validators.CONSISTENT, size, endian="big" if kind >= 128 else "little", label=f"UPX-packed {family} {arch}", compression=UPX_METHODS.get(method, ""), version=banner[1].decode() if banner else str(version))


validators.KNOWN["upx"] = _upx_valid


class _Program:
    """The blocks of a packed program: sizes, method and filter, then the packed bytes."""

    def __init__(self, data: bytes, order: str, at: int, width: int, most: int):
        self.data, self.order, self.at, self.width, self.most, self.method = data, order, at, width, most, 0

    def head(self, at: int) -> tuple[int, int, int, int, int] | None:
        """Plain and packed size, method, filter and its mark."""
        if at + self.width > len(self.data):
            return None
        plain, packed = (int.from_bytes(self.data[at + 4 * k : at + 4 * k + 4], self.order) for k in (0, 1))
        if not 0 < packed <= plain <= self.most or at + self.width + packed > len(self.data):
            return None
        return (plain, packed, *(self.data[at + 8 : at + 11] if self.width == 12 else (self.method, 0, 0)))

    def block(self) -> bytes:
        found = self.head(self.at)
        if not found:
            raise Stop("error:decompress")
        plain, packed, method, kind, mark = found
        raw = self.data[self.at + self.width : self.at + self.width + packed]
        self.at += self.width + packed
        if packed == plain:
            return raw
        try:
            if method == 14:
                lc, lp, pb = raw[1] & 15, raw[1] >> 4, raw[0] & 7
                size = max(4096, 1 << (plain - 1).bit_length())
                out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": size}]).decompress(raw[2:], plain)
            elif 2 <= method <= 10:
                out = codecs.nrv(method, raw, plain)
            else:
                raise Stop("unsupported:method")
            out = codecs.unfilter(out, kind, mark)
        except (codecs.Corrupt, lzma.LZMAError) as e:
            raise Stop("unsupported:filter" if kind and kind not in codecs.FILTERS else "error:decompress") from e
        if len(out) != plain:
            raise Stop("error:decompress")
        return out

    def run(self, size: int) -> bytes:
        out = b""
        while len(out) < size:
            out += self.block()
        if len(out) != size:
            raise Stop("error:decompress")
        return out


def upx_unpacked(data: bytes) -> bytes:
    """EXT-33: the program that an ELF stub carries: its loaded segments, then what lies between and behind them."""
    wide, order = data[4] == 2, "big" if data[5] == 2 else "little"
    mark = data.find(b"UPX!", 64 if wide else 52, 1 << 16)
    if mark < 0:
        raise Stop("error:no-linfo")
    word = lambda at, n=4, raw=data: int.from_bytes(raw[at : at + n], order)
    size, most = word(mark + 12), word(mark + 16)
    if not 0 < most <= size <= MOST_BYTES:
        raise Stop("error:no-linfo")
    for width in (12, 8):
        p = _Program(data, order, mark + 20, width, most)
        try:
            head = p.block()
        except Stop:
            continue
        if head[:5] == data[:5]:
            break
    else:
        raise Stop("error:decode")
    p.at, p.method = mark + 20, data[mark + 28]
    field = lambda at, n: word(at, n, head)
    first, step = (64, 56) if wide else (52, 32)
    loads = []
    for k in range(field(56 if wide else 44, 2)):
        at = first + k * step
        kind, place, n = field(at, 4), field(at + (8 if wide else 4), 8 if wide else 4), field(at + (32 if wide else 16), 8 if wide else 4)
        if kind == 1 and n:
            if place + n > size:
                raise Stop("error:decode")
            loads.append((place, n))
    out = bytearray(size)
    for place, n in loads:
        out[place : place + n] = p.run(n)
    ends = [(a + n, min([b for b, _ in loads if b >= a + n] + [size])) for a, n in loads]
    gaps = [(a, b - a) for a, b in ends if b > a]
    if gaps:
        p.at = _gap_blocks(p, [n for _, n in gaps])
        for place, n in gaps:
            out[place : place + n] = p.run(n)
    return bytes(out)


def _gap_blocks(p: _Program, sizes: list[int]) -> int:
    """Behind the loader: where the blocks begin whose plain sizes add up to those of the gaps."""
    want = sizes[0].to_bytes(4, p.order)
    at = p.at
    while (at := p.data.find(want, at)) >= 0:
        here, fits = at, True
        for size in sizes:
            while size > 0 and (found := p.head(here)):
                size, here = size - found[0], here + p.width + found[1]
            fits &= size == 0
        if fits:
            return at
        at += 1
    raise Stop("error:no-gap-blocks")


def upx_base(data: bytes, trailer: int) -> int | None:
    """The stub before a pack header: the first ELF header with the packer's mark and sane sizes behind."""
    at = -1
    while 0 <= (at := data.find(b"\x7fELF", at + 1)) < trailer:
        if data[at + 4 : at + 5] in (b"\1", b"\2") and data[at + 5 : at + 6] in (b"\1", b"\2"):
            mark = data.find(b"UPX!", at + (64 if data[at + 4] == 2 else 52), at + (1 << 16))
            if at < mark < trailer:
                return at
    return None
