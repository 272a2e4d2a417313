import hashlib
from collections import Counter

import corpus_pipeline as p
from bytestrata.llm import quality_rules

from .test_exact_dedup import brute as exact_brute
from .test_near_join import brute as near_brute
from .test_quality_rules import brute as quality_brute


def test_stages_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality == 1}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "bpe":
            assert tuple(docs.columns) == p.COLUMNS
        if name == "quality rules":
            assert ids(docs) == sorted(r[0] for r in quality_brute(before, good) if r[-1]) and quality_rules.THRESHOLD < 0
        elif name == "exact dedup":
            assert ids(docs) == sorted(r[0] for r in exact_brute(before) if r[3])
        elif name == "n-gram jaccard join":
            assert ids(docs) == sorted(r[0] for r in near_brute(before) if r[0] == r[1])
        elif name == "mixing":
            n = Counter(ids(docs))
            assert set(n) <= {r.doc_id for r in before} and max(n.values()) <= 2
            words = sum(len(r.text.split()) * n[r.doc_id] for r in before) / sum(len(r.text.split()) for r in before)
            assert abs(words - 1.5) < 0.1
        else:
            assert Counter((r.doc_id, r.decoded_sha256) for r in docs.collect()) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before)


def test_run_and_empty(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    assert p.run(spark, d).count() > 0
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0


def test_stages_on_odd_rows(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows, clashing column names: no stage loses a text that has no like."""
    d = "/root/testdata/sf0.001"
    texts = {r.text for r in odd_docs.collect() if r.text and r.text.strip()}
    for name, stage in p.STAGES:
        out = stage(spark, odd_docs, d)
        rows = out.collect()
        if name != "bpe":
            assert tuple(out.columns) == p.COLUMNS
            assert {r.text for r in rows if r.text and r.text.strip()} <= texts
        else:
            assert len(rows) == odd_docs.count()
        if name == "exact dedup":
            assert len(rows) == len({"".join((r.text or "").split()) for r in odd_docs.collect()})
        elif name == "n-gram jaccard join":
            assert len({r.doc_id for r in rows} & {1, 7, 9, 10, 11}) == 5
