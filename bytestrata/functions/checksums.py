"""Checksums of binary formats."""

from __future__ import annotations

import binascii
import zlib


def crc32(data: bytes) -> int:
    """FN-1: CRC-32 as in zip and gzip."""
    return zlib.crc32(data)


def crc32_raw(data: bytes, init: int) -> int:
    """FN-2: the reflected CRC-32 from any start, without a final inversion."""
    return zlib.crc32(data, init ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32_jffs2(data: bytes) -> int:
    return crc32_raw(data, 0)


def crc32_ubi(data: bytes) -> int:
    return crc32_raw(data, 0xFFFFFFFF)


def crc32_nvs(data: bytes) -> int:
    """FN-4."""
    return zlib.crc32(data, 0xFFFFFFFF)


def crc16_ccitt(data: bytes) -> int:
    """FN-3: CRC-16 with the polynomial 0x1021 from 0xFFFF."""
    return binascii.crc_hqx(data, 0xFFFF)


def sum16(data: bytes) -> int:
    """The 16-bit sum of little-endian words."""
    return sum(int.from_bytes(data[k : k + 2], "little") for k in range(0, len(data), 2)) & 0xFFFF
