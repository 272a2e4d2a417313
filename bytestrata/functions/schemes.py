"""Scrambled firmware: eight schemes, what their headers look like, and how each is undone with published keys.

A scheme is a function of (data, offset, whole): None where the header isn't its own; else what a trial of the first bytes,
or with whole all of them, gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from . import ciphers

# Published keys, passwords and magics of the schemes.
SHRS_KEY = bytes.fromhex("c05fbf1936c99429ce2a0781f08d6ad8")
IMG_KEY = bytes.fromhex("6865392d342b4d212964363d6d7e7765312c7132613364316e26322a5a5e2538")
IMG_IV = bytes.fromhex("4a253169516c38243d6c6d2d3b384145")
DEVICE_KEYS = (
    "044b4e59846ecee953662ff2238fcc23", "927fc5786df1a9557524a0289e1e3f3b", "4d5ee2c8b5d0fdd9a9a2d351ba897752", "238a29b9432f688e30b701548c753146",
    "a4f7c17c3e0aa4532c2024ce6ac5f17c", "6b5a65dbc1ebc492ac6d8efbbb59ae09", "70070e579f97548a96a7794d4d779376", "7b4df82f7f042b9d0b40971be0ff53c4",
    "6276ccf4c1d8d6f54b481095e78ff97f", "1ae6c79be7d069ca74df7670bdfc4952", "b4517d9b98e04d9f075f5e78c743e097", "05c79b73cf88619d7b9725505cfd718f",
    "6b29f1d663a21b35fb45b69a42649f5e", "1bfb1004e29f9eb76dbe26eb0dd87cd1", "c5f8a1e22f808abc84f2e4a6fa5f10bb", "6420da70a975455e4ddd6b8fa5b652e7",
)
SALTED_PASSWORDS = ("2c3b6fa78bd60b41bb0796fef4b058b0", "CAD1C42B11F1982FFA94B6A24C260A43", "A11E331C15CE73ABA8E06171A11D2FB6", "BE81AE1B6F523AC7164C4FD67B6BD8FD", "91A9A3AF2218F4EA60AC37D5835EB318")
ENGENIUS_MARK, ENGENIUS_KEY = b"\x12\x34\x56\x78all", bytes.fromhex("ac783c9ecf67b359")
AMEBA = b"81958711"
SALTED, TLV = b"Salted__", bytes.fromhex("64801940")
#: First bytes of firmware, by place, that tell a right key from a wrong one.
PLAIN = ((0, b"hsqs", "squashfs"), (0, b"sqsh", "squashfs"), (0, b"\x27\x05\x19\x56", "uimage"), (0, b"UBI#", "ubi"), (0, b"UBI!", "ubi"), (0, b"\xd0\x0d\xfe\xed", "fdt"), (257, b"ustar", "tar"), (0, b"\x1f\x8b", "gzip"), (0, b"\xfd7zXZ\0", "xz"), (0, b"070701", "cpio"), (0, b"070702", "cpio"), (0, b"\x85\x19", "jffs2"))

TRIAL = 512


@dataclass
class Found:
    scheme: str
    span: int  # bytes from the header on
    plain: bytes = b""
    holds: str = ""  # what the first bytes are; empty where no key fits
    cipher: str = ""


def firmware(plain: bytes) -> str:
    """What the bytes begin like, or an empty text."""
    return next((name for at, raw, name in PLAIN if plain.startswith(raw, at)), "")


def _u(data: bytes, at: int, order: str) -> int:
    if at < 0 or at + 4 > len(data):
        raise IndexError(at)
    return int.from_bytes(data[at : at + 4], order)


def _blocks(n: int) -> int:
    return n - n % 16


def _open(data: bytes, key: bytes, iv: bytes, whole: bool) -> bytes:
    """A trial of the first blocks, or all without the padding; empty where the padding is wrong."""
    try:
        return ciphers.decrypt(data if whole else data[:TRIAL], key, iv, padded=whole)
    except ValueError:
        return b""


def shrs(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-1: AES-128 with the initial vector in the header; holds a boot image."""
    if not data.startswith(b"SHRS", at):
        return None
    size, body = _u(data, at + 8, "big"), data[at + 0x6DC :]
    if not 0 < size <= 64 << 20 or size % 16 or len(body) < 16:
        return None
    out = Found("dlink_shrs", 0x6DC + size, cipher="AES-128-CBC")
    plain = ciphers.decrypt(body[: size if whole else 16], SHRS_KEY, data[at + 12 : at + 28]) if not whole or len(body) >= size else b""
    if firmware(plain) == "uimage":
        out.plain, out.holds = plain, "uimage"
    return out


def encrpted_img(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-2: AES-256, chained anew each 128 KiB; holds a UBI image."""
    if not data.startswith(b"encrpted_img", at) or len(data) - at <= 32:
        return None
    size = _blocks(len(data) - at - 16)
    out = Found("dlink_encrpted_img", 16 + size, cipher="AES-256-CBC")
    body = data[at + 16 : at + 16 + (size if whole else 16)]
    plain = b"".join(ciphers.decrypt(body[k : k + (128 << 10)], IMG_KEY, IMG_IV) for k in range(0, len(body), 128 << 10))
    if plain.startswith(b"UBI"):
        out.plain, out.holds = plain, "ubi"
    return out


def openssl_salted(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-3: what the openssl tool writes, under one of the known passwords."""
    if not data.startswith(SALTED, at) or len(data) - at <= 32:
        return None
    size = _blocks(len(data) - at - 16)
    out = Found("openssl_salted", 16 + size, cipher="AES-256-CBC")
    for password in SALTED_PASSWORDS:
        for digest in ("sha256", "md5"):
            plain = _open(data[at + 16 : at + 16 + size], *ciphers.bytes_to_key(password.encode(), data[at + 8 : at + 16], digest, 32, 16), whole)
            if firmware(plain):
                out.plain, out.holds = plain, firmware(plain)
                return out
    return out


def mh01(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-4: a salted payload whose initial vector stands, in hexadecimal, in the header."""
    if not data.startswith(b"MH01", at) or not data.startswith(SALTED, at + 0x41):
        return None
    size, vector = _u(data, at + 24, "little"), data[at + 32 : at + 64]
    if size < 24:
        return None
    out, body = Found("dlink_mh01", 0x41 + size, cipher="AES-128-CBC"), data[at + 0x51 : at + 0x41 + size]
    if (size - 16) % 16 or len(body) != size - 16 or not re.fullmatch(rb"[0-9a-fA-F]{32}", vector):
        return out
    for password in DEVICE_KEYS:
        key, _ = ciphers.bytes_to_key(password.encode(), data[at + 0x49 : at + 0x51], "sha256", 16, 0)
        plain = _open(body, key, bytes.fromhex(vector.decode()), whole)
        if plain.startswith(b"MH01"):
            out.plain, out.holds = plain, "mh01"
            return out
    return out


def dlk(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-5: two headers, then chunks with an initial vector each; a device's key is the key."""
    if not data.startswith(b"DLK", at):
        return None
    second = at + 0x50 + _u(data, at + 44, "little")
    if second - at >= 256 << 20 or not data.startswith(b"DLK", second):
        return None
    step, total = _u(data, second + 16, "little") + 32, _u(data, second + 44, "little")
    if not total:
        return None
    out, body = Found("dlink_dlk", second + 0x50 + total - at, cipher="AES-256-CBC"), data[second + 0x50 : second + 0x50 + total]
    if len(body) < total:
        return out
    for key in DEVICE_KEYS:
        parts = []
        try:
            for k in range(0, total if whole else 1, step):
                parts.append(ciphers.decrypt(body[k + 16 : k + step], key.encode(), body[k : k + 16], padded=True))
        except ValueError:
            continue
        if firmware(plain := b"".join(parts)):
            out.plain, out.holds = plain, firmware(plain)
            return out
    return out


def tlv(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-6: the password is a keyed digest of the model under the board's name."""
    if not data.startswith(TLV, at) or not data.startswith(SALTED, at + 0x74):
        return None
    model, board = (data[at + k : at + k + 32].split(b"\0")[0] for k in (4, 36))
    size = _blocks(len(data) - at - 0x84)
    if not model or not board or size < 16:
        return None
    out = Found("dlink_tlv", 0x84 + size, cipher="AES-256-CBC")
    password = ciphers.hmac_sha1(board, model).hex().encode()
    plain = _open(data[at + 0x84 : at + 0x84 + size], *ciphers.bytes_to_key(password, data[at + 0x7C : at + 0x84], "md5", 32, 16), whole)
    if firmware(plain):
        out.plain, out.holds = plain, firmware(plain)
    return out


def engenius(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-7: eight repeating bytes, which show where the plain text is zero and so give the phase."""
    if at < 0 or not data.startswith(ENGENIUS_MARK, at + 92):
        return None
    total, model = _u(data, at + 32, "big"), _u(data, at + 132, "big")
    if total <= 136 or model > 256:
        return None
    out, first = Found("engenius", total, cipher="xor-8"), at + 136 + model
    body, phase = data[first : min(at + total, len(data))], data.find(ENGENIUS_KEY)
    if not body or phase < 0:
        return out
    body = body if whole else body[:TRIAL]
    turn = (first - phase) % 8
    pad = (ENGENIUS_KEY[turn:] + ENGENIUS_KEY[:turn]) * (len(body) // 8 + 1)
    plain = (int.from_bytes(body, "big") ^ int.from_bytes(pad[: len(body)], "big")).to_bytes(len(body), "big")
    if firmware(plain):
        out.plain, out.holds = plain, firmware(plain)
    return out


def dlink_ota(data: bytes, at: int, whole: bool) -> Found | None:
    """DSC-8: entries that tile the file; the first payload is under one byte, which its known beginning gives away."""
    if not data.startswith(b"OTA1", at + 8):
        return None
    count = _u(data, at + 4, "little")
    if not 1 <= count <= 9:
        return None
    end, first = 8 + 24 * count, (0, 0)
    for k in range(count):
        entry = at + 8 + 24 * k
        size, place = _u(data, entry + 12, "little"), _u(data, entry + 16, "little")
        if not data.startswith(b"OTA", entry) or _u(data, entry + 4, "little") != 24 or not size or place != end:
            return None
        first, end = first if k else (place, size), place + size
    if at + end > len(data):
        return None
    out, body = Found("dlink_ota", end, cipher="xor-1"), data[at + first[0] : at + sum(first)]
    table = bytes(x ^ body[0] ^ AMEBA[0] for x in range(256))
    if body[:8].translate(table) == AMEBA:
        out.plain, out.holds = (body if whole else body[:TRIAL]).translate(table), "realtek_ameba"
    return out


SCHEMES: dict[str, Callable[[bytes, int, bool], Found | None]] = {"dlink_shrs": shrs, "dlink_encrpted_img": encrpted_img, "openssl_salted": openssl_salted, "dlink_mh01": mh01, "dlink_dlk": dlk, "dlink_tlv": tlv, "engenius": engenius, "dlink_ota": dlink_ota}


def probe(data: bytes, at: int) -> Found | None:
    """The scheme whose header stands there: one whose key fits before one whose structure alone does (DSC-9)."""
    structure = None
    for scheme in SCHEMES.values():
        try:
            found = scheme(data, at, False)
        except (IndexError, ValueError):
            continue
        if found and found.holds:
            return found
        structure = structure or found
    return structure


def descrambled(data: bytes, scheme: str) -> Iterator[tuple[str, str, bytes]]:
    """EXT-42: the plain bytes of a scrambled image, as an extractor's file; none where no key fits."""
    found = SCHEMES[scheme](data, 0, True)
    if found and found.holds:
        yield "descrambled.bin", "file", found.plain
