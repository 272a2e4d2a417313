import random
import zlib

import numpy as np

from bytestrata.llm import quality_knn as q

from .conftest import words


def _corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(60, rng)
        rows.append((i, " ".join(w + "***" for w in text.split()) if bad else text))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_shape(spark):
    docs, labels = _corpus(spark)
    got = q.annotate(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = _corpus(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    key = lambda r: r.doc_id
    assert sorted(q.annotate(docs, labels).collect(), key=key) == sorted(q.annotate(docs, flipped).collect(), key=key)


def test_odd_rows(spark, odd_docs, no_docs):
    _, labels = _corpus(spark)
    got = q.annotate(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert {r.score for r in got if r.doc_id in (4, 5)} == {0.0}
    assert q.annotate(no_docs, labels).count() == 0
    assert {r.score for r in q.annotate(odd_docs, labels.limit(0)).collect()} == {0.0}


def test_whole_text_counts():
    a, b = q.counts("abc def " * 10), q.counts("abc def " * 10 + "#" * 50)
    assert (a != b).any()
    long = "abcdefgh" * (q.STEP // 4)
    assert q.counts(long)[: q.TERMS].sum() == len(long) - 2


def brute(found, labels, queries):
    """Scores by a dense decomposition, the cosine with every labelled text, and a sort."""
    idf = np.log((1 + len(found)) / (1 + (found > 0).sum(0))) + 1
    idf[q.TERMS :] *= q.FORM
    x = np.log1p(found) * idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    turn = np.linalg.svd(x, full_matrices=False)[2][: q.DIMS]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    vectors, asked = unit(np.log1p(found) * idf @ turn.T), unit(np.log1p(queries) * idf @ turn.T)
    out = []
    for row in asked:
        cosine = vectors @ row
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: q.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** q.SHARPNESS for k in near]
        out.append(sum(w * labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else 0.0)
    return np.array(out)


def test_scores_against_a_dense_decomposition():
    """With fewer labelled texts than directions the subspace is exact; with more, the leading directions agree."""
    rng = random.Random(9)
    for n, allowed in ((50, 1e-4), (150, 0.05)):
        found = np.stack([q.counts(words(rng.randint(20, 90), rng, 2)) for _ in range(n)])
        labels = np.array([rng.random() < 0.6 for _ in range(n)], float)
        queries = np.stack([q.counts(words(40, rng, 2)) for _ in range(60)])
        got, want = q.fit(found, labels).score(queries), brute(found.astype(np.float64), labels, queries)
        assert np.median(abs(got - want)) < allowed and abs(got - want).max() < 3 * allowed + 0.05


def test_ties_and_repeated_ids(spark):
    found = np.stack([q.counts("the same words " * 3)] * 80 + [q.counts("quite other text")] * 5)
    labels = np.array([1.0, 0.0] * 40 + [0.0] * 5)
    assert np.allclose(q.fit(found, labels).score(found[:1]), 0.5)  # all 80 tie, and vote
    docs, labels = _corpus(spark)
    repeated = docs.unionByName(docs).unionByName(docs.selectExpr("doc_id", "concat(text, ' z') AS text"))
    one = {r.doc_id: r.score for r in q.annotate(repeated.repartition(5), labels).collect() if not r.doc_id % 7}
    assert q.annotate(repeated, labels).count() == 1200 and len(one) == 58
    learnt = q.learn(repeated, labels)
    assert len(learnt.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
