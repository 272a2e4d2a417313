import io
import struct
import zipfile

from bytestrata.operators import identify as ident
from bytestrata.operators import listing
from bytestrata.sources import catalog

from .test_extract import FILES, _tar


def _zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("config.xml", "<a/>")
        z.writestr("lib/app.so", b"x" * 99)
    return out.getvalue()


def test_members():
    assert listing.members(_tar(FILES), "tar", 0)[0] == [(k, len(v), "") for k, v in FILES.items()]
    assert listing.members(b"pad!" + _zip(), "zip", 4)[0] == [("config.xml", 4, "deflate"), ("lib/app.so", 99, "deflate")]
    file_ = struct.pack("<IIHHHH", 5, 0, 0, 0, 0, 32) + b"a\\b.txt\0"
    cab = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, 44 + len(file_), 0, 44, 0, 3, 1, 1, 1, 0, 1, 0) + struct.pack("<IHH", 60, 1, 1) + file_
    assert listing.members(cab, "cab", 0)[0] == [("a/b.txt", 5, "mszip")]
    assert listing.members(b"junk" * 200, "tar", 0) == ([], False)


def test_cut(monkeypatch):
    monkeypatch.setattr(listing, "MOST_MEMBERS", 1)
    assert listing.members(_tar(FILES), "tar", 0) == ([("etc/passwd", 180, "")], True)


def test_rows(spark):
    df = spark.createDataFrame([(1, bytearray(_tar(FILES))), (2, bytearray(_zip())), (3, bytearray(b"no"))], "blob_id long, content binary")
    rows = listing.listed(df, ident.identify(df, [(catalog.HERE / "curated.toml").read_text()])).collect()
    assert {(r.blob_id, r.name) for r in rows} == {(1, "etc/passwd"), (1, "bin/sh"), (2, "config.xml"), (2, "lib/app.so")}
