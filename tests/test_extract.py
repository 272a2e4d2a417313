import gzip
import io
import lzma
import tarfile
import zipfile

import zstandard

from bytestrata.operators import extract
from bytestrata.sources import catalog


def _tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


FILES = {"etc/passwd": b"root:x:0\n" * 20, "bin/sh": bytes(range(256)) * 3}


def test_round_trips():
    assert extract.unpack(_tar(FILES), "tar") == ([(k, "file", v) for k, v in FILES.items()], "ok")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in FILES.items():
            z.writestr(k, v)
    assert dict((p, c) for p, _, c in extract.unpack(out.getvalue(), "zip")[0]) == FILES
    for type_, pack in (("gzip", gzip.compress), ("xz", lzma.compress)):
        assert extract.unpack(pack(b"abc" * 99), type_) == ([("data", "file", b"abc" * 99)], "ok")
    assert extract.unpack(b":03000000010203F7\n:0200030004052F\n:00000001FF\n", "ihex")[0] == [("0x00000000.bin", "file", b"\1\2\3\4\5")]


def test_hostile_input():
    assert extract.unpack(gzip.compress(b"x" * 500)[:-9], "gzip")[1].startswith("error")
    assert extract.unpack(_tar({"../up": b"x"}), "tar") == ([], "error:unsafe-path")
    assert extract.unpack(b"", "tar")[1] != "ok" and extract.unpack(b"abc", "nothing") == ([], "unsupported")


def test_lz4():
    assert extract.lz4_block(bytes([0x33]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z") == b"abcabcabcaz"


def test_levels(spark):
    texts = [(catalog.HERE / "curated.toml").read_text()]
    inner = gzip.compress(_tar(FILES))
    df = spark.createDataFrame([(1, bytearray(_tar({"fw/image.gz": inner}))), (2, bytearray(b"nothing here"))], "blob_id long, content binary")
    rows = extract.extract(df, texts).collect()
    assert {(r.depth, r.path) for r in rows} == {(1, "fw/image.gz"), (2, "data"), (3, "etc/passwd"), (3, "bin/sh")}
    assert {bytes(r.content) for r in rows if r.depth == 3} == set(FILES.values())


def test_limits(monkeypatch):
    """LIM-3; a stream above the limit says so, and nothing is cut."""
    assert (extract.MOST_BYTES, extract.MOST_FILES) == (4 << 30, 500_000)
    packs = {"gzip": gzip.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}
    for name in ("MOST_BYTES", "MOST_CELL"):
        with monkeypatch.context() as m:
            m.setattr(extract, name, 1000)
            for type_, pack in packs.items():
                assert extract.unpack(pack(b"ab" * 500), type_) == ([("data", "file", b"ab" * 500)], "ok")
                assert extract.unpack(pack(b"ab" * 5000), type_) == ([], "error:too-large")
    with monkeypatch.context() as m:
        m.setattr(extract, "MOST_CELL", 700)
        assert extract.unpack(_tar(FILES), "tar") == ([("etc/passwd", "file", FILES["etc/passwd"])], "partial")
