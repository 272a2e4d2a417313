import json
import os

import pytest

from bytestrata import __main__ as cli
from bytestrata.operators import extract, reports
from bytestrata.samples import images
from bytestrata.sources import catalog


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/fw.bin").write_bytes(images.uimage(images.gzip_(images.tar())))
    (tmp_path / "in/plain.txt").write_bytes(b"nothing\n" * 9)
    assert cli.main([str(tmp_path / "in"), "--extract", str(tmp_path / "out")], spark) == 0
    assert "uimage  verified" in capsys.readouterr().out
    written = {os.path.relpath(os.path.join(d, f), tmp_path / "out").split("/", 2)[2]: open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert written == {"payload": images.tar(), "etc/conf": images.FILES["etc/conf"], "readme": images.FILES["readme"], "link.symlink": b"etc/conf"}
    assert cli.main([str(tmp_path / "in"), "--json"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["file_count"] == 2 and [f["path"].rsplit("/", 1)[1] for f in doc["files"]] == ["fw.bin", "plain.txt"] and doc["by_type"] == {"uimage": 1, "unknown": 1}
    assert cli.main([str(tmp_path / "in/plain.txt")], spark) == 1
    assert cli.main([str(tmp_path / "missing")], spark) == 2 and cli.main([], spark) == 2


def test_links_are_not_followed(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, "tar", "a/b", "file", bytearray(b"x"), 7)], "root_id long, depth int, offset_ long, type_ string, path string, kind string, content binary, parent_id long")
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "out/1").mkdir(parents=True)
    (tmp_path / "out/1/1-00000007-0x0-tar").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(OSError):
        reports.write_files(rows, str(tmp_path / "out"))
    assert not list((tmp_path / "elsewhere").iterdir())


def test_folded_siblings():
    f = lambda k, t, stays=False: {"place": k, "type_": t, "size_": 2, "stays": stays, "line": f"{t}{k}"}
    rows = [f(1, "png"), f(2, "key", True)] + [f(k, "png") for k in range(3, 7)]
    assert [x["line"] for x in reports._folded(rows)] == ["png ×5, 10 bytes", "key2"]
    assert len(reports._folded(rows[:5])) == 5


def test_roots_of_signatures(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path))
    monkeypatch.delenv("BYTESTRATA_SIGNATURES", raising=False)
    assert catalog.find_root() is None
    (tmp_path / "bytestrata/signatures").mkdir(parents=True)
    assert catalog.find_root() == tmp_path / "bytestrata/signatures"
    monkeypatch.setenv("BYTESTRATA_SIGNATURES", str(tmp_path))
    assert catalog.find_root() == tmp_path and catalog.find_root(str(tmp_path / "bytestrata")) == tmp_path / "bytestrata"


def test_covered_findings_are_not_unpacked_again():
    from bytestrata.operators import identify as ident

    stored = images.gzip_(images.squashfs())
    data = b"\x1f\x8b\x08\0\0\0\0\0\2\xff" + b"\1" + len(images.squashfs()).to_bytes(2, "little") + (len(images.squashfs()) ^ 0xFFFF).to_bytes(2, "little") + images.squashfs() + stored[-8:]
    matcher = ident.matcher_of(tuple((catalog.HERE / n).read_text() for n in ("curated.toml", "vendor.toml")))
    found = ident.findings(data, matcher)
    assert [f.type for f in found] == ["gzip", "squashfs"]
    assert [f.type for f, _, _ in extract.unpacked(data, found)] == ["gzip"]
    two = images.jffs2() + bytes(600_000) + images.jffs2()
    assert [f.type for f, _, _ in extract.unpacked(two, ident.findings(two, matcher))] == ["jffs2"]
