"""Builders of flash stores, compound files, packages and scrambled images."""

from __future__ import annotations

import struct

from ..functions import checksums, ciphers, lzari, schemes
from .images import FILES, put, tar, ubi, uimage


def littlefs_tree() -> bytes:
    """A root with an inline file, a directory with another, and a file of three blocks."""
    size, large = 512, bytes(range(256)) * 5
    blocks: dict[int, bytes] = {}

    def commit(revision: int, tags: list[tuple[int, int, bytes]]) -> bytes:
        out, before = bytearray(struct.pack("<I", revision)), 0xFFFFFFFF
        for kind, id_, body in tags:
            t = kind << 20 | id_ << 10 | len(body)
            out += struct.pack(">I", t ^ before) + body
            before = t
        out += struct.pack(">I", (0x500 << 20 | 0x3FF << 10 | 4) ^ before)
        out += struct.pack("<I", checksums.crc32_ubi(bytes(out)))
        return bytes(out).ljust(size, b"\xff")

    # block k of a file begins with pointers back: one, and one more for each trailing zero bit of k
    first, second = large[:512], large[512 : 512 + 508]
    third = large[1020 : 1020 + 504]
    blocks[8], blocks[9], blocks[10] = first, struct.pack("<I", 8) + second, struct.pack("<II", 9, 8) + third
    root = [(0x0FF, 0, b"littlefs"), (0x201, 0, struct.pack("<6I", 0x20001, size, 16, 255, 2**31 - 1, 1022))]
    root += [(0x401, 1, b""), (0x002, 1, b"etc"), (0x200, 1, struct.pack("<II", 4, 5)), (0x401, 2, b""), (0x001, 2, b"large"), (0x202, 2, struct.pack("<II", 10, len(large))), (0x401, 3, b""), (0x001, 3, b"note"), (0x201, 3, b"inline")]
    blocks[0], blocks[4] = commit(2, root), commit(1, [(0x401, 0, b""), (0x001, 0, b"conf"), (0x201, 0, FILES["etc/conf"])])
    blocks[1] = commit(1, root[:2])
    blocks[5] = b"\xff" * size
    return put(16 * size, {k * size: raw.ljust(size, b"\xff") for k, raw in blocks.items()})


def spiffs() -> bytes:
    """Pages of 256 bytes in blocks of 4 KiB: one file of two pages, one deleted."""
    page, block = 256, 4096
    head = lambda id_, span, flags: struct.pack("<HHB", id_, span, flags)
    index = lambda id_, size, name, flags=0xF8: (head(id_ | 0x8000, 0, flags) + bytes(3) + struct.pack("<IB", size, 1) + name.ljust(32, b"\0")).ljust(page, b"\xff")
    body = bytes(range(256)) + b"tail" * 20
    pages = [index(1, len(body), b"/config.txt"), (head(1, 0, 0xFC) + body[:251]).ljust(page, b"\xff"), (head(1, 1, 0xFC) + body[251:]).ljust(page, b"\xff"), index(2, 3, b"/gone", 0x78), (head(2, 0, 0x7C) + b"old").ljust(page, b"\xff")]
    raw = b"".join(pages)
    table = struct.pack("<HHHHH", 0x8001, 1, 1, 0, 0).ljust(page, b"\xff")
    return (table + raw).ljust(block, b"\xff") + b"\xff" * block


def yaffs2(order: str = "little") -> bytes:
    """Pages of 2 KiB with 64 bytes of tags: a directory, a file written twice, a link, a deleted file."""
    how = "<" if order == "little" else ">"
    seq = 0x1000

    def page(id_: int, chunk: int, n: int, body: bytes) -> bytes:
        nonlocal seq
        return body.ljust(2048, b"\xff") + struct.pack(how + "4I", seq, id_, chunk, n).ljust(64, b"\xff")

    def header(id_: int, kind: int, parent: int, name: bytes, size: int = 0xFFFFFFFF, link: bytes = b"") -> bytes:
        raw = struct.pack(how + "IIH", kind, parent, 0xFFFF) + name.ljust(256, b"\0")
        raw = raw.ljust(268, b"\xff") + struct.pack(how + "I", 0o100644) + bytes(20) + struct.pack(how + "II", size, 0xFFFFFFFF) + link.ljust(160, b"\0")
        return page(id_, 0, 0xFFFF, raw.ljust(512, b"\xff"))

    out = header(257, 3, 1, b"etc") + header(258, 1, 257, b"conf", 5000) + page(258, 1, 2048, b"a" * 2048) + page(258, 2, 2048, b"b" * 2048) + page(258, 3, 904, b"c" * 904)
    seq += 1
    out += page(258, 2, 2048, b"B" * 2048) + header(259, 2, 1, b"link", link=b"etc/conf") + header(260, 1, 4, b"gone", 1) + page(260, 1, 1, b"x")
    return out


def exfat() -> bytes:
    """Clusters of one sector: a file in one run, a directory with a file that is chained."""
    parts = {3: b"EXFAT   ", 80: struct.pack("<IIIII", 2, 2, 8, 64, 4), 108: b"\x09\x00", 510: b"\x55\xaa"}
    links = {2: 0xFFFFFFFF, 4: 0xFFFFFFFF, 8: 0xFFFFFFFF, 9: 12, 12: 0xFFFFFFFF}
    parts |= {1024 + 4 * k: struct.pack("<I", v) for k, v in links.items()}

    def entry(name: str, folder: bool, first: int, size: int, run: bool) -> bytes:
        raw = name.encode("utf-16-le")
        rows = [b"\xc1\0" + raw[k : k + 30].ljust(30, b"\0") for k in range(0, len(raw), 30)]
        head = struct.pack("<BBHH26x", 0x85, 1 + len(rows), 0, 0x10 if folder else 0x20)
        return head + struct.pack("<BBBBHHQIIQ", 0xC0, 1 | 2 * run, 0, len(name), 0, 0, size, 0, first, size) + b"".join(rows)

    at = lambda cluster: (8 + cluster - 2) * 512
    body = bytes(range(250)) * 4
    parts |= {at(4): entry("a rather long name.bin", False, 5, len(body), True) + entry("sub", True, 8, 512, False), at(5): body, at(8): entry("conf", False, 9, 600, False), at(9): b"x" * 512, at(12): b"y" * 88}
    return put(72 * 512, parts)


def cfbf() -> bytes:
    """Sectors of 512 bytes: a storage with a small stream, a large stream, and a name as installers write them."""
    large = bytes(range(256)) * 17
    fat_at, dir_at, mini_fat, mini_at, large_at = 0, 1, 3, 4, 5
    n = -(-len(large) // 512)
    table = [0xFFFFFFFD, 2, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFE] + [k + 1 for k in range(large_at, large_at + n - 1)] + [0xFFFFFFFE]

    def entry(name: str, kind: int, child: int, left: int, right: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    none = 0xFFFFFFFF
    coded = "䡀" + chr(0x3800 + 10 + (11 << 6)) + chr(0x4800 + 12)
    rows = entry("Root Entry", 5, 1, none, none, mini_at, 128) + entry("box", 1, 3, none, 2, 0, 0) + entry("large", 2, none, none, 4, large_at, len(large)) + entry("note", 2, none, none, none, 0, 5) + entry(coded, 2, none, none, none, 1, 3)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, dir_at, 0, 4096, mini_fat, 1, 0xFFFFFFFE, 0) + struct.pack("<I", fat_at)
    sectors = [struct.pack(f"<{len(table)}I", *table).ljust(512, b"\xff"), rows[:512], rows[512:].ljust(512, b"\0"), struct.pack("<II", 0xFFFFFFFE, 0xFFFFFFFE).ljust(512, b"\xff"), (b"hello".ljust(64, b"\0") + b"msi").ljust(512, b"\0"), large.ljust(n * 512, b"\0")]
    return head.ljust(512, b"\xff") + b"".join(sectors)


def lzari_pack(body: bytes) -> bytes:
    """Literals, and runs of the byte before as matches, under the adaptive code."""
    bits: list[int] = []
    low, high, waiting = 0, lzari.Q4, 0
    model = lzari._Model()

    def put_bit(bit: int) -> None:
        nonlocal waiting
        bits.extend([bit] + [1 - bit] * waiting)
        waiting = 0

    def code(lower: int, upper: int, total: int) -> None:
        nonlocal low, high, waiting
        span = high - low
        high = low + span * upper // total
        low += span * lower // total
        while True:
            if high <= lzari.Q2:
                put_bit(0)
            elif low >= lzari.Q2:
                put_bit(1)
                low, high = low - lzari.Q2, high - lzari.Q2
            elif low >= lzari.Q1 and high <= lzari.Q3:
                waiting += 1
                low, high = low - lzari.Q1, high - lzari.Q1
            else:
                return
            low, high = 2 * low, 2 * high

    def symbol(s: int) -> None:
        place = model.place[s]
        code(model.above[place], model.above[place - 1], model.above[0])
        model.used(place)

    at = 0
    while at < len(body):
        n = 0
        while at and n < lzari.LONGEST and at + n < len(body) and body[at + n] == body[at - 1]:
            n += 1
        if n >= lzari.SHORTEST:
            symbol(n + 253)
            code(lzari._FAR[1], lzari._FAR[0], lzari._FAR[0])
            at += n
        else:
            symbol(body[at])
            at += 1
    waiting += 1
    put_bit(0 if low < lzari.Q1 else 1)
    bits += [0] * (-len(bits) % 8 + 16)
    return struct.pack("<I", len(body)) + bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def rae_rfp() -> bytes:
    """A stored section and a packed one."""
    plain = b"[info]\nversion = 1\n" + b"=" * 100
    packed = lzari_pack(plain)
    section = lambda name, flags, size, body: struct.pack("<I", len(name)) + name + struct.pack("<III", flags, size, len(body)) + body
    return b"RAE Systems Inc." + struct.pack("<HI", 1, 77) + b"RAE" + bytes(range(16)) + section(b"IniFile", 1, len(plain), packed) + section(b"BinFile", 0, 9, b"raw bytes")


def wince_hive() -> bytes:
    """Texts and numbers in turn, and raw bytes, as records at even places."""

    def record(kind: int, name: str, body: bytes) -> bytes:
        raw = struct.pack("<HHH", kind, len(body), len(name)) + name.encode("utf-16-le") + body
        return raw.ljust((len(raw) + 1) // 2 * 2, b"\0") + b"\xff\xff" * (2 if kind == 1 else 3)

    out = b""
    for k in range(8):
        out += record(4, f"Name{k}", struct.pack("<I", 1000 + k)) if k % 2 else record(1, f"Name{k}", f"value {k}\0".encode("utf-16-le"))
    out += record(3, "Raw", b"\0\xff\x10")
    return put(1024, {0: struct.pack("<II", 4096, 0) + b"EKIM", 0x48: out})


# Scrambled images


def shrs() -> bytes:
    body = uimage()
    body = body.ljust(-(-len(body) // 16) * 16, b"\0")
    iv = bytes(range(16))
    return put(0x6DC, {0: b"SHRS", 8: struct.pack(">I", len(body)), 12: iv}) + ciphers.encrypt(body, schemes.SHRS_KEY, iv)


def encrpted_img() -> bytes:
    return b"encrpted_img".ljust(16, b"\0") + ciphers.encrypt(ubi()[:16384], schemes.IMG_KEY, schemes.IMG_IV)


def openssl_salted(password: str = schemes.SALTED_PASSWORDS[0], digest: str = "sha256") -> bytes:
    salt = b"saltsalt"
    return schemes.SALTED + salt + ciphers.encrypt(tar()[:2048], *ciphers.bytes_to_key(password.encode(), salt, digest, 32, 16), padded=True)


def mh01() -> bytes:
    iv, salt = bytes(range(16)), b"12345678"
    key, _ = ciphers.bytes_to_key(schemes.DEVICE_KEYS[3].encode(), salt, "sha256", 16, 0)
    body = schemes.SALTED + salt + ciphers.encrypt(b"MH01" + b"inner" * 9, key, iv, padded=True)
    return put(0x41, {0: b"MH01", 24: struct.pack("<I", len(body)), 32: iv.hex().encode()}) + body


def dlk() -> bytes:
    key, iv, plain = schemes.DEVICE_KEYS[5].encode(), bytes(range(16)), b"hsqs" + bytes(range(252)) * 2
    parts = [plain[:256], plain[256:]]
    body = b"".join(iv + ciphers.encrypt(x, key, iv, padded=True) for x in parts)
    head = lambda block, size: put(0x50, {0: b"DLK", 16: struct.pack("<I", block), 44: struct.pack("<I", size)})
    return head(0, 32) + b"s" * 32 + head(256, len(body)) + body


def tlv() -> bytes:
    model, board, salt = b"model-1", b"board-2", b"abcdefgh"
    password = ciphers.hmac_sha1(board, model).hex().encode()
    body = ciphers.encrypt(b"\x1f\x8b" + b"stream" * 30, *ciphers.bytes_to_key(password, salt, "md5", 32, 16), padded=True)
    return put(0x74, {0: schemes.TLV, 4: model, 36: board}) + schemes.SALTED + salt + body


def engenius() -> bytes:
    plain = b"hsqs" + bytes(60) + b"rest"
    first = 136 + 8
    pad = lambda k: schemes.ENGENIUS_KEY[(first + k) % 8]
    body = bytes(c ^ pad(k) for k, c in enumerate(plain))
    return put(first, {32: struct.pack(">I", first + len(plain)), 92: schemes.ENGENIUS_MARK, 132: struct.pack(">I", 8), 136: b"model-ab"}) + body


def dlink_ota() -> bytes:
    body = bytes(c ^ 0x5A for c in schemes.AMEBA + b"firmware" * 8)
    return struct.pack("<II", 1, 1) + struct.pack("<4sIIIII", b"OTA1", 24, 0, len(body), 32, 0) + body


SAMPLES = {
    "littlefs_tree.bin": littlefs_tree, "spiffs.bin": spiffs, "rootfs.yaffs2": yaffs2, "rootfs_be.yaffs2": lambda: yaffs2("big"), "exfat_tree.bin": exfat, "installer.msi": cfbf, "fw.rfp": rae_rfp, "default.hv": wince_hive, "fw.shrs": shrs, "fw.encrpted_img": encrpted_img,
    "fw.salted": openssl_salted, "fw_unknown.salted": lambda: openssl_salted("some other password"), "fw.mh01": mh01, "fw.dlk": dlk, "fw.tlv": tlv, "fw.engenius": engenius, "fw.dlink_ota": dlink_ota, "dlk_magic.bin": lambda: b"DLK" + bytes(200),
}
