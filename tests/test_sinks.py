import gzip
import json

from bytestrata.operators import identify as ident
from bytestrata.operators import sinks, summaries
from bytestrata.sources import blobs, catalog
from bytestrata.streaming import watch

TEXTS = [(catalog.HERE / "curated.toml").read_text()]


def _blob():
    return b"x" * 2048 + gzip.compress(b"one" * 50) + bytes(4096) + gzip.compress(b"two" * 50) + b"tail" * 75


def test_carve_and_json(spark):
    data = _blob()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"plain text")), (3, None)], "blob_id long, content binary")
    found = ident.identify(df, TEXTS)
    cut = sinks.carve(df, found, 256).collect()
    for r in cut:
        if r.blob_id == 1:
            assert bytes(r.content) == data[r.offset_ : r.offset_ + r.size_] and r.name == f"0x{r.offset_:08x}-{r.type_}.bin"
    assert {r.type_ for r in cut if r.blob_id == 1} == {"unknown", "gzip"}
    docs = {r.blob_id: json.loads(r.json) for r in sinks.documents(df, found).collect()}
    assert [f["type"] for f in docs[1]["findings"]] == ["gzip", "gzip"] and docs[1]["schema_version"] == 1 and "label" not in docs[1]["findings"][0]
    assert docs[2]["summary"] == "no known signatures identified" and docs[3]["findings"] == []


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.bin").write_bytes(gzip.compress(b"a" * 100))
    (tmp_path / "in/sub/b.bin").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "in/empty").write_bytes(b"")
    found = ident.identify(blobs.from_files(spark, str(tmp_path / "in")), TEXTS)
    assert {r.type_ for r in found.collect()} == {"gzip", "pdf"}
    stream = watch.write(watch.identified(watch.arriving(spark, str(tmp_path / "in")), TEXTS), str(tmp_path / "out"), str(tmp_path / "state"))
    stream.awaitTermination(60)
    assert {r.type_ for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"gzip", "pdf"}


def test_entropy_of_ranges(spark):
    df = spark.createDataFrame([(1, bytearray(bytes(512) + bytes(range(256)) * 4))], "blob_id long, content binary")
    ranges = spark.createDataFrame([(1, 0, 512), (1, 512, 1024), (1, 5, 0)], "blob_id long, offset_ long, size_ long")
    assert {(r.offset_, r.entropy) for r in summaries.range_entropy(df, ranges).collect()} == {(0, 0.0), (512, 8.0)}
