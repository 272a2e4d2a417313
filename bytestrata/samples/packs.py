"""Builders of packed programs and packages, with the small encoders that they need."""

from __future__ import annotations

import hashlib
import struct

from ..functions import checksums
from .images import FILES, put


class _Out:
    """Bits into units, and bytes behind the units begun so far."""

    def __init__(self, unit: int = 1, from_foot: bool = False):
        self.data, self.unit, self.left, self.at, self.from_foot = bytearray(), unit, 0, 0, from_foot

    def bits(self, value: int, n: int = 1) -> None:
        for k in range(n - 1, -1, -1):
            if not self.left:
                self.at, self.left = len(self.data), 8 * self.unit
                self.data += bytes(self.unit)
            self.left -= 1
            place = 8 * self.unit - 1 - self.left if self.from_foot else self.left
            if value >> k & 1:
                word = int.from_bytes(self.data[self.at : self.at + self.unit], "little") | 1 << place
                self.data[self.at : self.at + self.unit] = word.to_bytes(self.unit, "little")

    def byte(self, value: int) -> None:
        self.data.append(value)


def _steps(body: bytes, longest: int = 200) -> list[tuple[int, int]]:
    """Literals (0, byte) and matches (distance up to 100, length of 3 and more), the first that is found."""
    out, at = [], 0
    while at < len(body):
        best = (0, 0)
        for back in range(1, min(at, 100) + 1):
            n = 0
            while n < longest and at + n < len(body) and body[at + n] == body[at + n - back]:
                n += 1
            if n > best[1]:
                best = (back, n)
        if best[1] >= 3:
            out.append(best)
            at += best[1]
        else:
            out.append((0, body[at]))
            at += 1
    return out


def nrv_pack(method: int, body: bytes) -> bytes:
    code, out = (method - 2) // 3, _Out((4, 1, 2)[(method - 2) % 3])

    def grow(value: int) -> None:
        rest = value.bit_length() - 1
        for k in range(rest - 1, -1, -1):
            out.bits(value >> k & 1)
            out.bits(k == 0)

    for back, n in _steps(body):
        if not back:
            out.bits(1)
            out.byte(n)
            continue
        out.bits(0)
        v = n - 1
        low = (v >> 1 if v < 4 else 0) if code < 2 else int(v < 3)
        x = back - 1 if not code else 2 * (back - 1) | 1 - low
        out.bits(0b11, 2)  # three, in either code of distances
        out.byte(x)
        if code < 2:
            if not code:
                out.bits(low)
            out.bits(v & 1 if v < 4 else 0)
            if v > 3:
                grow(v - 2)
        elif low:
            out.bits(v - 1)
        elif v < 5:
            out.bits(1)
            out.bits(v - 3)
        else:
            out.bits(0)
            grow(v - 3)
    return bytes(out.data)


def jzlzma_pack(body: bytes) -> bytes:
    out = _Out(from_foot=True)

    def length(n: int) -> None:
        if n < 10:
            out.bits(n - 2, 4)
        elif n < 18:
            out.bits(0b10, 2)
            out.bits(n - 10, 3)
        else:
            out.bits(0b11, 2)
            out.bits(n - 18, 8)

    last = 0
    for back, n in _steps(body):
        if not back:
            out.bits(0)
            out.bits(n, 8)
        elif back == last:
            out.bits(0b1101, 4)
            length(n)
        else:
            out.bits(0b10, 2)
            length(n)
            place = back - 1
            if place < 4:
                out.bits(place, 6)
            else:
                top = place.bit_length() - 1
                slot, n_low = 2 * top + (place >> top - 1 & 1), top - 1
                out.bits(slot, 6)
                out.bits(int(f"{place & (1 << n_low) - 1:0{n_low}b}"[::-1], 2), n_low)
            last = back
    return bytes(out.data)


def lzss_pack(body: bytes) -> bytes:
    out, at = _Out(), 0
    for back, n in _steps(body, 17):
        if not back:
            out.bits(1)
            out.bits(n, 8)
            at += 1
        else:
            out.bits(0)
            out.bits((at - back) % 1024 + 1, 10)
            out.bits(n - 2, 4)
            at += n
    out.bits(0, 11)
    return bytes(out.data)


def lzx_pack(body: bytes) -> bytes:
    """One verbatim block, then one of raw bytes: all bytes but the last and a run of seven like the byte before have codes of eight bits."""
    out, raw = _Out(2), b"stored as it is"
    out.bits(0)
    out.bits(1, 3)
    out.bits(len(body), 24)
    small = [1 if k in (0, 9) else 0 for k in range(20)]  # change by nothing, or from 0 to 8
    lengths = [8] * 255 + [0] + [8 if k == 5 else 0 for k in range(240)]
    for part in (lengths[:256], lengths[256:], [0] * 249):
        for n in small:
            out.bits(n, 4)
        for n in part:
            out.bits(n == 8)
    at = 0
    while at < len(body):
        if at and body[at : at + 7] == bytes([body[at - 1]]) * 7:
            out.bits(255, 8)
            at += 7
        else:
            out.bits(body[at], 8)
            at += 1
    out.bits(3, 3)
    out.bits(len(raw), 24)
    if not out.left:
        out.bits(0)
    out.left = 0
    return bytes(out.data) + struct.pack("<III", 1, 1, 1) + raw


def cab_lzx() -> bytes:
    body = FILES["etc/conf"] + b"=" * 100
    raw = lzx_pack(body)
    rows = struct.pack("<IIHHHH", 120, 0, 0, 0, 0, 32) + b"etc\\conf\0" + struct.pack("<IIHHHH", 115, 120, 0, 0, 0, 32) + b"rest\0"
    total = 44 + len(rows) + 8 + len(raw)
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, total, 0, 44, 0, 3, 1, 1, 2, 0, 1, 0) + struct.pack("<IHH", 44 + len(rows), 1, 15 << 8 | 3)
    return head + rows + struct.pack("<IHH", 0, len(raw), len(body) + 15) + raw


def jzlzma() -> bytes:
    body = FILES["etc/conf"] + FILES["readme"]
    packed = jzlzma_pack(body)
    return struct.pack("<4I", len(packed), 0x27051956, 1 << 16, len(body)) + packed


def vbf_packed() -> bytes:
    body = FILES["readme"]
    packed = lzss_pack(body)
    return b'vbf_version = 2.5;\nheader { sw_part_number = "P-7"; data_format_identifier = 0x10; }' + struct.pack(">II", 0x100, len(packed)) + packed + struct.pack(">H", checksums.crc16_ccitt(body))


def _literals(body: bytes) -> bytes:
    """An LZO stream without a match."""
    return bytes([17 + len(body)]) + body + b"\x11\0\0"


def otra() -> bytes:
    parts = [b"boot code", b"root " * 20, b"more root"]
    segments = [_literals(p) for p in parts]
    names = [(b"boot", 0, 0x1000, 1), (b"root fs", 0x1000, 0x1000, 0), (b"spare", 0x2000, 0x1000, 0)]
    at = 0x220 + 0x34 * len(names) + 0x20 * len(parts)
    table, places = b"".join(struct.pack("<32sQQI", *n) for n in names), [0, 0x1000, 0x1100]
    for place, plain, packed in zip(places, parts, segments, strict=True):
        table += struct.pack("<4Q", at, place, len(packed), len(plain))
        at += len(packed)
    body = table + b"".join(segments)
    head = put(0x220, {0: b"OTRA" + struct.pack("<BBBBHBBHHIIIIHH", 1, 1, 0, 0, 0, 32, 0, 0, 256, len(body), 0, 0, 0, len(names), len(parts)), 128: b"1.02.03", 0x100: hashlib.sha256(body).digest()})
    return head + body


def program() -> bytes:
    """An ELF program: headers, code with a call, and text behind what is loaded."""
    head = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0) + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 300, 300, 4096)
    code = b"\x90" * 40 + b"\xe8" + struct.pack("<i", -20) + b"\x90" * 30 + bytes(range(100))
    return (head + code).ljust(300, b"\xcc") + b"behind the loaded part"


def upx() -> bytes:
    """The program as blocks: headers and code, then the loader, then what lies behind, then the pack header."""
    plain = program()
    filtered = bytearray(plain[120:300])
    at = filtered.index(0xE8)  # as the packer does it: the place called, from the top down, under a mark
    place = struct.unpack_from("<i", filtered, at + 1)[0] + at + 1 + (0x77 << 24)
    filtered[at + 1 : at + 5] = (place & 0xFFFFFFFF).to_bytes(4, "big")

    def block(body: bytes, size: int, kind: int = 0, mark: int = 0) -> bytes:
        packed = nrv_pack(8, body)
        return struct.pack("<IIBBBB", size, len(packed), 8, kind, mark, 0) + packed

    assert filtered[at + 1] == 0x76 or filtered[at + 1] == 0x77
    mark = filtered[at + 1]
    if mark != 0x77:  # a negative distance borrows from the mark
        place = struct.unpack_from("<i", plain, 120 + at + 1)[0] + at + 1
        filtered[at + 1 : at + 5] = ((place + (mark << 24)) & 0xFFFFFFFF).to_bytes(4, "big")
    stub = plain[:64] + struct.pack("<I4sHBB", 0, b"UPX!", 0, 14, 22) + struct.pack("<III", 0, len(plain), 300)
    tail = plain[300:]
    body = stub + block(plain[:120], 120) + block(bytes(filtered), 180, 0x49, filtered[at + 1]) + b"loader code" * 3 + struct.pack("<IIBBBB", len(tail), len(tail), 8, 0, 0, 0) + tail
    head = bytearray(b"UPX!" + bytes([14, 22, 8, 9]) + struct.pack("<5I", 1, 2, len(plain), len(body), len(plain)) + bytes(4))
    head[31] = sum(head[4:31]) % 251
    return body + b"$Id: UPX 3.96 Copyright" + bytes(head)


SAMPLES = {"install_lzx.cab": cab_lzx, "blob.jzlzma": jzlzma, "fw_packed.vbf": vbf_packed, "fw.otra": otra, "prog_packed.upx": upx}
