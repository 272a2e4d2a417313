import gzip
import io
import lzma
import random
import struct
import tarfile
import zipfile
import zlib

import duckdb
import pytest

from bytestrata.operators import identify as ident
from bytestrata.queries import oracle_sql, queries
from bytestrata.sources import catalog


@pytest.fixture(scope="module")
def matcher():
    return ident.Matcher(catalog.default())


def found(data, matcher):
    return {f.type: f for f in ident.resolve(ident.scan(data, matcher), len(data))}


def uimage(payload=b"kernel", good=True):
    head = struct.pack(">7I4B32s", 0x27051956, 0, 1, len(payload), 0, 0, zlib.crc32(payload), 5, 5, 2, 1, b"Linux")
    return head[:4] + struct.pack(">I", zlib.crc32(head) if good else 1) + head[8:] + payload


def tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name in ("etc/passwd", "bin/sh"):
            info = tarfile.TarInfo(name)
            info.size = 700
            t.addfile(info, io.BytesIO(b"x" * 700))
    return out.getvalue()


def zip_():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("config.xml", "<a/>" * 50)
    return out.getvalue()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0")) + chunk(b"IEND", b"")


def elf():
    return b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0) + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 200, 200, 4096) + bytes(80)


@pytest.mark.parametrize(
    ("name", "data", "type_", "least", "size"),
    [
        ("uimage", uimage(), "uimage", 99, 70), ("tar", tar(), "tar", 85, None), ("zip", zip_(), "zip", 85, len(zip_())), ("png", png() + b"tail", "png", 99, len(png())), ("elf", elf(), "elf", 85, 200),
        ("gzip", gzip.compress(b"x" * 99), "gzip", 60, None), ("xz", lzma.compress(b"abc" * 99), "xz", 99, None), ("lzma", lzma.compress(bytes(range(256)) * 40, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16}]), "lzma", 99, None),
        ("gif", b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0\2\2\x4c\1\0\x3b", "gif", 85, None), ("pdf", b"%PDF-1.4\n...", "pdf", 60, None), ("key", b"-----BEGIN PRIVATE KEY-----\nabc", "private_key", 85, None),
        ("ihex", b":0300300002337A1E\r\n:00000001FF\r\n", "ihex", 85, None), ("cpio", b"070701" + b"%08x" * 13 % (1, 0o100644, 0, 0, 1, 0, 4, 0, 0, 0, 0, 2, 0) + b"a\0" + b"data" + bytes(8), "cpio", 85, None),
    ],
)
def test_formats(matcher, name, data, type_, least, size):
    got = found(data, matcher)
    assert type_ in got and got[type_].confidence >= least, got
    assert size is None or got[type_].size == size


def test_negatives(matcher):
    rng = random.Random(1)
    assert not found(b"\xfd7zXZ\0\0\4" + b"\0\0\0\0" + bytes(20), matcher)
    assert not found(b"key = value\nother = 1\n" * 20, matcher)
    assert not [f for f in found(rng.randbytes(4096), matcher).values() if f.confidence >= 85]
    assert found(uimage(good=False), matcher)["uimage"].confidence == 60
    assert not found(b"abc", matcher)


def test_overlaps_and_sizes(matcher):
    box = uimage(b"....." + gzip.compress(b"x" * 50))
    data = bytes(100) + box + bytes(50) + gzip.compress(b"y" * 50) + bytes(30)
    got = ident.resolve(ident.scan(data, matcher), len(data))
    assert [(f.type, f.offset) for f in got] == [("uimage", 100), ("gzip", 150 + len(box))]
    assert got[1].size == len(data) - got[1].offset


def test_magic_inside_a_header(matcher):
    """A header of wrong CRC has no size, but what only a magic speaks for is none of its fields' rivals; what has more is."""
    head = lambda time, load, name: struct.pack(">7I4B32s", 0x27051956, 1, time, 6, load, 0, 0, 5, 5, 2, 1, name)
    found = lambda data: [(f.offset, f.size, f.type, [(g.offset, g.type) for g in f.also]) for f in ident.findings(data, matcher)]
    assert found(head(0, 0x4C4B, b"a") + b"kernel") == [(0, 70, "uimage", [(10, "lk")])]
    assert found(head(0x4C4B, 0x4C4B, b"a") + b"kernel") == [(0, 70, "uimage", [(2, "lk"), (10, "lk")])]
    assert found(head(0, 0, b"a") + b"kernel--LK\0\0") == [(0, 64, "uimage", []), (64, 12, "lk", [])]
    assert [f[:3] for f in found(head(0, 0, gzip.compress(b"")) + b"kernel")] == [(0, 32, "uimage"), (32, 38, "gzip")]
    assert found(bytes(100) + head(0, 0x4C4B, b"a") + b"kernel") == [(100, 70, "uimage", [(110, "lk")])]


def test_packed_orders_with_magics_in_their_numbers(spark, tmp_path):
    """Keys and customers whose bytes are LK, with two zero bytes behind, or cpio's digits, in the header: the SQL's rows all the same."""
    rows = [(19531, 6903, "O", "5-LOW"), (85067, 10298, "P", "1-URGENT"), (7, 19531, "O", "2-HIGH"), (150603, 85067, "P", "5-LOW"), (19532, 19531, "F", "5-LOW"), (216139, 1, "F", "3-MEDIUM"), (1070701, 5, "O", "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries()["identify_packed"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['identify_packed']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_partition_rescue(matcher):
    """A file system that begins where the table says a partition does is found inside a stale one that covers it."""
    sector, size = 512, 2 << 20
    disk = bytearray(size)

    def ext(at, blocks):
        disk[at + 1024 : at + 1032] = struct.pack("<II", 64, blocks)
        disk[at + 1044 : at + 1052] = struct.pack("<II", 1, 0)
        disk[at + 1080 : at + 1084] = b"\x53\xef\1\0"

    ext(0x8000, 256)
    ext(0x40000, 256)
    table = bytearray(128 * 128)
    for k, (first, last) in enumerate(((0x10000, 0x3FFFF), (0x40000, 0x7FFFF))):
        table[128 * k : 128 * k + 48] = bytes(range(1, 33)) + struct.pack("<QQ", first // sector, last // sector)
    head = b"EFI PART" + struct.pack("<IIIIQQQQ16sQIII", 0x10000, 92, 0, 0, 1, size // sector - 1, 34, size // sector - 34, bytes(16), 2, 128, 128, zlib.crc32(bytes(table)))
    head = head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:]
    plain = bytes(disk)
    disk[512 : 512 + len(head)] = head
    disk[1024 : 1024 + len(table)] = table
    offsets = lambda d: [f.offset for f in ident.resolve(ident.scan(bytes(d), matcher), size) if f.type == "ext"]
    assert offsets(plain) == [0x8000] and offsets(disk) == [0x8000, 0x40000]


def test_coalesce():
    mk = lambda o, s: ident.Finding(o, s, "jffs2", "filesystem", 60, "little", coalesce=True, diagnostics=[("warning", "w")])
    (one,) = ident.resolve([mk(0, 50), mk(50, 50), mk(100, 8)], 1000)
    assert (one.size, one.coalesced, one.diagnostics) == (108, 3, [("warning", "w")])


def test_order_is_stable():
    a, b = ident.Finding(0, 10, "x", "c", 60, "little"), ident.Finding(0, 10, "y", "c", 60, "little")
    for pair in ([a, b], [b, a]):
        got = ident.resolve([ident.replace(f, also=[]) for f in pair], 100)
        assert [f.type for f in got] == ["x"] and [g.type for g in got[0].also] == ["y"]


def test_dataframe(spark):
    texts = [(catalog.HERE / n).read_text() for n in ("curated.toml", "vendor.toml")]
    df = spark.createDataFrame([(1, bytearray(uimage())), (2, bytearray(tar())), (3, None), (4, bytearray())], "blob_id long, content binary")
    rows = ident.identify(df, texts).collect()
    assert {(r.blob_id, r.type_, r.tier) for r in rows} == {(1, "uimage", "verified"), (2, "tar", "consistent")}


def test_window_suppression_agrees_with_the_fold(spark):
    d = "/root/testdata/sf0.001"
    assert queries()["suppress_interior"](spark, d).count() <= queries()["resolve_findings"](spark, d).count()
