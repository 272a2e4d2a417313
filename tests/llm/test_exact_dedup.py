import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from bytestrata.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    out = []
    for text, own in groups.items():
        own.sort(key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for k, r in enumerate(own):
            out.append((r.doc_id, own[0].doc_id, len(own), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(odd_docs):
    got = sorted((tuple(r) for r in exact_dedup.annotate(odd_docs).collect()), key=str)
    assert got == brute(odd_docs.collect())


def test_weak_digest_gives_the_same(odd_docs):
    got = exact_dedup.annotate(odd_docs, digest=lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256)))
    want = [r[:4] for r in brute(odd_docs.collect())]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)


def test_hot_group_is_salted(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = exact_dedup.annotate(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(df.collect())


def test_survivors_keep_columns(odd_docs):
    kept = exact_dedup.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(odd_docs.collect()) if r[3])


def test_empty(no_docs):
    assert exact_dedup.annotate(no_docs).count() == 0
    assert exact_dedup.survivors(no_docs).count() == 0
