import lzma
import shutil
import struct
import subprocess
import zlib

import pytest

from bytestrata.operators import extract


def cramfs(files, order):
    """A root directory of files; each is one or more compressed blocks."""
    names = {k: k.encode().ljust((len(k) + 3) // 4 * 4, b"\0") for k in files}
    at = 76 + sum(12 + len(n) for n in names.values())
    entries, bodies = b"", b""

    def inode(mode, size, name, offset):
        if order == "<":
            return struct.pack("<HHII", mode, 0, size, name | offset << 6)
        return struct.pack(">HHII", mode, 0, size << 8, name << 26 | offset)

    for k, v in sorted(files.items()):
        blocks = [zlib.compress(v[i : i + 4096]) for i in range(0, len(v), 4096)]
        start = at + len(bodies)
        ends, here = [], start + 4 * len(blocks)
        for b in blocks:
            here += len(b)
            ends.append(here)
        body = struct.pack(f"{order}{len(ends)}I", *ends) + b"".join(blocks)
        entries += inode(0o100644, len(v), len(names[k]) // 4, start // 4) + names[k]
        bodies += body.ljust((len(body) + 3) // 4 * 4, b"\0")
    head = struct.pack(order + "IIII16sIIII16s", 0x28CD3D45, at + len(bodies), 0, 0, b"Compressed ROMFS", 0, 0, 1, len(files) + 1, b"x")
    return head + inode(0o040755, len(entries), 0, 19) + entries + bodies


def squashfs(files, order, codec, pack):
    """One directory; small files share a fragment, larger ones have blocks."""
    block, out, frag, inodes, listing = 4096, bytearray(96), b"", b"", b""
    for k, (name, body) in enumerate(sorted(files.items())):
        sizes, start = [], len(out)
        for i in range(0, len(body) // block * block, block):
            raw = pack(body[i : i + block])
            out += raw
            sizes.append(len(raw))
        rest = body[len(body) // block * block :]
        place = len(inodes)
        inodes += struct.pack(order + "HHHHII", 2, 0o644, 0, 0, 0, k + 2) + struct.pack(order + "IIII", start, 0 if rest else 0xFFFFFFFF, len(frag), len(body)) + struct.pack(f"{order}{len(sizes)}I", *sizes)
        frag += rest
        listing += struct.pack(order + "HhHH", place, k, 2, len(name) - 1) + name.encode()
    listing = struct.pack(order + "III", len(files) - 1, 0, 2) + listing
    root = len(inodes)
    inodes += struct.pack(order + "HHHHII", 1, 0o755, 0, 0, 0, 1) + struct.pack(order + "IIHHI", 0, 2, len(listing) + 3, 0, 99)
    meta = lambda raw: struct.pack(order + "H", len(pack(raw))) + pack(raw)
    frag_at = len(out)
    out += pack(frag)
    inode_at = len(out)
    out += meta(inodes)
    dir_at = len(out)
    out += meta(listing)
    frag_meta = len(out)
    out += meta(struct.pack(order + "QII", frag_at, len(pack(frag)), 0))
    frag_table = len(out)
    out += struct.pack(order + "Q", frag_meta)
    id_table = len(out)
    out += bytes(8)
    out[:96] = struct.pack(order + "IIIIIHHHHHHQQQQQQQQ", 0x73717368, len(files) + 1, 0, block, 1, codec, 12, 0, 1, 4, 0, root, len(out), id_table, 2**64 - 1, inode_at, dir_at, frag_table, 2**64 - 1)
    return bytes(out)


FILES = {"readme": b"hello " * 30, "large": bytes(range(256)) * 50, "empty": b""}


@pytest.mark.parametrize("order", ["<", ">"])
def test_cramfs(order):
    got, status = extract.unpack(cramfs(FILES, order), "cramfs")
    assert status == "ok" and {p: c for p, _, c in got} == FILES


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("codec", "pack"), [(1, zlib.compress), (4, lzma.compress)])
def test_squashfs(order, codec, pack):
    image = squashfs(FILES, order, codec, pack)
    got, status = extract.unpack(image, "squashfs")
    assert status == "ok" and {p: c for p, _, c in got} == FILES
    assert extract.unpack(image[:200], "squashfs")[1] != "ok"


@pytest.mark.parametrize("kind", ["ext2", "ext3", "ext4"])
def test_ext(kind, tmp_path):
    tool = shutil.which("mke2fs")
    if not tool:
        pytest.skip("no mke2fs")
    tree = {"etc/conf": b"a = 1\n", "bin/large": bytes(range(256)) * 3000, "empty": b"", "deep/er/x": b"y" * 5000}
    for name, body in tree.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (tmp_path / "tree/link").symlink_to("etc/conf")
    image = tmp_path / "image"
    subprocess.run([tool, "-q", "-t", kind, "-b", "1024", "-d", str(tmp_path / "tree"), str(image), "8M"], check=True, capture_output=True)
    got, status = extract.unpack(image.read_bytes(), "ext")
    assert status == "ok" and {p: c for p, k, c in got if k == "file"} == tree
    assert [(p, c) for p, k, c in got if k == "symlink"] == [("link", b"etc/conf")]


def fat(bits):
    """A volume of 512-byte clusters with one file in the root and one, with a long name, below."""
    clusters = {12: 100, 16: 5000}[bits]
    size = -(-(clusters + 2) * bits // 8 // 512) + 1
    boot = struct.pack("<3s8sHBHBHHBHHHII", b"\xeb\x3c\x90", b"x", 512, 1, 1, 1, 16, 0, 0xF8, size, 0, 0, 0, 1 + size + 1 + clusters)
    table = [0xFFF8, 0xFFFF, 3, 4, 0xFFFF, 0xFFFF, 0xFFFF]
    raw = bytearray(size * 512)
    for k, v in enumerate(table):
        if bits == 16:
            raw[2 * k : 2 * k + 2] = struct.pack("<H", v)
        else:
            v, at = v & 0xFFF, k * 3 // 2
            word = int.from_bytes(raw[at : at + 2], "little") | (v << 4 if k & 1 else v)
            raw[at : at + 2] = struct.pack("<H", word)
    entry = lambda name, attr, c, n: struct.pack("<11sB8xHHHHI", name, attr, 0, 0, 0, c, n)
    long = "A long name.txt".encode("utf-16-le").ljust(52, b"\0")
    part = lambda k, last: bytes([k | 0x40 * last]) + long[26 * k - 26 : 26 * k - 16] + b"\x0f\0\0" + long[26 * k - 16 : 26 * k - 4] + b"\0\0" + long[26 * k - 4 : 26 * k]
    root = (entry(b"DATA    BIN", 0x20, 2, 1200) + entry(b"SUB        ", 0x10, 5, 0)).ljust(512, b"\0")
    sub = (entry(b".          ", 0x10, 5, 0) + part(2, 1) + part(1, 0) + entry(b"ALONGN~1TXT", 0x20, 6, 5)).ljust(512, b"\0")
    body = bytes(range(240)) * 5
    return boot.ljust(512, b"\0") + bytes(raw) + root + body.ljust(1536, b"\0") + sub + b"hello".ljust(512, b"\0") + bytes(512 * (clusters - 5)), {"DATA.BIN": body, "SUB/A long name.txt": b"hello"}


@pytest.mark.parametrize("bits", [12, 16])
def test_fat(bits):
    image, want = fat(bits)
    got, status = extract.unpack(image, "fat")
    assert status == "ok" and {p: c for p, _, c in got} == want
