import hashlib
import struct
import zlib

import pytest

from bytestrata.functions import checksums
from bytestrata.operators import identify as ident
from bytestrata.sources import catalog


@pytest.fixture(scope="module")
def matcher():
    return ident.Matcher(catalog.default())


def esp32_table():
    entry = lambda k, s, at, n, name: struct.pack("<2sBBII16sI", b"\xaa\x50", k, s, at, n, name, 0)
    rows = entry(1, 2, 0x9000, 0x6000, b"nvs") + entry(0, 0, 0x10000, 0x100000, b"factory")
    return bytes(0x8000) + rows + b"\xeb\xeb" + b"\xff" * 14 + hashlib.md5(rows).digest() + b"\xff" * 0x3000


def nvs():
    e = bytearray(struct.pack("<BBBBI16s8s", 0, 1, 1, 255, 0, b"wifi", b"\1" + b"\xff" * 7))
    e[4:8] = struct.pack("<I", checksums.crc32_nvs(bytes(e[:4] + e[8:])))
    head = struct.pack("<IIB19s", 0xFFFFFFFE, 0, 0xFE, b"\xff" * 19)
    head += struct.pack("<I", checksums.crc32_nvs(head[4:28]))
    return head + bytes([0xFE]) + b"\xff" * 31 + bytes(e) + b"\xff" * (125 * 32)


def littlefs():
    out, before = bytearray(struct.pack("<I", 1)), 0xFFFFFFFF

    def tag(kind, id_, body):
        nonlocal before
        t = kind << 20 | id_ << 10 | len(body)
        out.extend(struct.pack(">I", t ^ before) + body)
        before = t

    tag(0x0FF, 0, b"littlefs")
    tag(0x201, 0, struct.pack("<6I", 0x20000, 4096, 4, 255, 2**31 - 1, 1022))
    t = 0x500 << 20 | 0x3FF << 10 | 4
    out.extend(struct.pack(">I", t ^ before))
    out.extend(struct.pack("<I", checksums.crc32_ubi(bytes(out))))
    return bytes(out).ljust(4 * 4096, b"\xff")


def env():
    body = b"arch=arm\0bootcmd=run x\0baudrate=115200\0bootdelay=3\0ipaddr=10.0.0.1\0\0".ljust(4092, b"\xff")
    return b"\xff" * 512 + struct.pack("<I", zlib.crc32(body)) + body


def vbf():
    block = lambda a, d: struct.pack(">II", a, len(d)) + d + struct.pack(">H", checksums.crc16_ccitt(d))
    return b'vbf_version = 2.6;\nheader { sw_part_number = "1"; erase = { {1,2} }; }' + block(0, b"abc") + block(16, b"defg")


def upx():
    head = bytearray(b"UPX!" + bytes([13, 22, 8, 9]) + struct.pack("<5I", 1, 2, 3000, 1000, 4000) + bytes([0, 0, 0, 0]))
    head[31] = sum(head[4:31]) % 251
    return b"\x90" * 64 + bytes(head) + b"\x90" * 64


@pytest.mark.parametrize(
    ("type_", "data", "tier", "offset", "size"),
    [("esp32_partition_table", esp32_table(), 85, 0x8000, 96), ("esp32_nvs", nvs(), 99, 0, 4096), ("littlefs", littlefs(), 99, 0, 16384), ("uboot_env", env(), 99, 512, 4096), ("vbf", vbf(), 99, 0, len(vbf())), ("upx", upx(), 99, 64, 32)],
)
def test_verified(matcher, type_, data, tier, offset, size):
    got = [f for f in ident.resolve(ident.scan(data, matcher), len(data)) if f.type == type_]
    assert [(f.confidence, f.offset, f.size) for f in got] == [(tier, offset, size)]


def test_flipped_bits_are_not_verified(matcher):
    for type_, data, at in (("esp32_nvs", nvs(), 70), ("littlefs", littlefs(), 30), ("uboot_env", env(), 600), ("vbf", vbf(), len(vbf()) - 4), ("upx", upx(), 64 + 12)):
        bad = bytearray(data)
        bad[at] ^= 1
        got = [f for f in ident.resolve(ident.scan(bytes(bad), matcher), len(data)) if f.type == type_]
        assert not [f for f in got if f.confidence == 99], type_
