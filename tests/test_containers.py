import struct
import zlib

from bytestrata.functions import checksums
from bytestrata.operators import containers, extract

from .test_validators import env, vbf


def test_environment_and_vbf():
    assert extract.unpack(env()[512:], "uboot_env")[0][0][2].splitlines()[:2] == [b"arch=arm", b"bootcmd=run x"]
    got, status = extract.unpack(vbf(), "vbf")
    assert status == "ok" and [(p, c) for p, _, c in got[1:]] == [("0x00000000.bin", b"abc"), ("0x00000010.bin", b"defg")]


def test_rtime():
    assert containers.rtime(bytes([97, 0, 98, 0, 97, 4]), 7) == b"abababa"


def test_jffs2():
    def node(kind, body):
        head = struct.pack("<HHI", 0x1985, kind, 12 + len(body))
        raw = head + struct.pack("<I", checksums.crc32_jffs2(head)) + body
        return raw.ljust((len(raw) + 3) // 4 * 4, b"\xff")

    def entry(parent, version, inode, name):
        return node(0xE001, struct.pack("<IIIIBBHII", parent, version, inode, 0, len(name), 8, 0, 0, 0) + name)

    def part(inode, version, mode, size, offset, body, codec):
        raw = zlib.compress(body) if codec == 6 else body
        return node(0xE002, struct.pack("<IIIHHIIIIIIIBBHII", inode, version, mode, 0, 0, size, 0, 0, 0, offset, len(raw), len(body), codec, codec, 0, 0, 0) + raw)

    image = entry(1, 1, 2, b"etc") + part(2, 1, 0o040755, 0, 0, b"", 0) + entry(2, 1, 3, b"conf") + part(3, 1, 0o100644, 3, 0, b"old", 0) + part(3, 2, 0o100644, 500, 0, b"new" * 100, 6) + part(3, 3, 0o100644, 500, 300, b"z" * 200, 0)
    image += entry(1, 2, 4, b"link") + part(4, 1, 0o120777, 8, 0, b"etc/conf", 0) + entry(1, 3, 5, b"gone") + part(5, 1, 0o100644, 1, 0, b"x", 0) + entry(1, 4, 0, b"gone")
    got, status = extract.unpack(image, "jffs2")
    assert status == "ok" and {p: (k, c) for p, k, c in got} == {"etc/conf": ("file", b"new" * 100 + b"z" * 200), "link": ("symlink", b"etc/conf")}


def test_android_boot():
    head = struct.pack("<8s8I", b"ANDROID!", 5, 0, 3, 0, 0, 0, 0, 2048) + struct.pack("<I", 0)
    data = head.ljust(2048, b"\0") + b"kerne".ljust(2048, b"\0") + b"ram".ljust(2048, b"\0")
    assert extract.unpack(data, "android_boot") == ([("kernel", "file", b"kerne"), ("ramdisk", "file", b"ram")], "ok")


def test_fit():
    names = b"data\0"
    begin = lambda n: struct.pack(">I", 1) + (n + b"\0").ljust((len(n) + 4) // 4 * 4, b"\0")
    prop = lambda v: struct.pack(">III", 3, len(v), 0) + v.ljust((len(v) + 3) // 4 * 4, b"\0")
    end = struct.pack(">I", 2)
    body = begin(b"") + begin(b"images") + begin(b"kernel-1") + prop(b"payload") + end + end + end + struct.pack(">I", 9)
    data = struct.pack(">10I", 0xD00DFEED, 40 + len(body) + len(names), 40, 40 + len(body), 40, 17, 16, 0, len(names), len(body)) + body + names
    assert extract.unpack(data, "fit") == ([("kernel-1", "file", b"payload")], "ok")


def test_iso9660():
    def record(start, size, flags, name, use=b""):
        raw = struct.pack("<BB", 0, 0) + struct.pack("<I", start) + struct.pack(">I", start) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags, 0, 0]) + bytes(4) + bytes([len(name)]) + name
        raw += bytes(not len(name) & 1) + use
        raw += bytes(len(raw) & 1)
        return bytes([len(raw)]) + raw[1:]

    rock = lambda n: b"NM" + bytes([5 + len(n), 1, 0]) + n
    link = b"SL" + bytes([5 + 2 + 3, 1, 0, 0, 3]) + b"etc"
    files = record(18, 5, 0, b"README.TXT;1", rock(b"readme.txt")) + record(19, 2048, 2, b"SUB") + record(18, 0, 0, b"LINK.;1", rock(b"link") + link)
    root = record(17, 2048, 2, b"\0") + record(17, 2048, 2, b"\1") + files
    sub = record(19, 2048, 2, b"\0") + record(17, 2048, 2, b"\1") + record(18, 3, 0, b"A.BIN;1")
    top = (b"\1CD001\1" + bytes(149) + record(17, 2048, 2, b"\0")).ljust(2048, b"\0")
    data = bytes(16 * 2048) + top + root.ljust(2048, b"\0") + b"hello".ljust(2048, b"\0") + sub.ljust(2048, b"\0")
    got, status = extract.unpack(data, "iso9660")
    assert status == "ok" and {p: (k, c) for p, k, c in got} == {"readme.txt": ("file", b"hello"), "link": ("symlink", b"etc"), "SUB/A.BIN": ("file", b"hel")}
