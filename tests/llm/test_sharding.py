import zlib

from bytestrata.llm import sharding


def _check(rows, docs):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, most = sum(r.size for r in rows), max((r.size for r in rows), default=0)
    for k in range(16):
        assert abs(sum(r.size for r in by.get(k, [])) - total / 16) <= most
    # contiguous in the order of doc_id
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: (r.doc_id, r.shard, r.slot))
    assert [r.shard for r in order] == sorted(r.shard for r in order)


def test_odd_rows(odd_docs):
    _check(sharding.annotate(odd_docs).collect(), odd_docs.select("doc_id", "text").collect())


def test_real_table_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sharding.annotate(docs).collect()
    _check(rows, docs.collect())
    again = sharding.annotate(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_empty(no_docs):
    assert sharding.annotate(no_docs).count() == 0
