import math
import re
from collections import Counter

import xxhash

from bytestrata.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    at = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(at)
    covered = {i + k for i, g in enumerate(at) if n[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


class Int(int):
    """A 32-bit argument of the hash; other integers have 64 bits."""


def h(*parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p if isinstance(p, bytes) else p.to_bytes(4 if isinstance(p, Int) else 8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


def grams(text):
    w = WORD.findall(text or "")
    one = [h(x) for x in w]
    two = [q.TWICE if a == b else a ^ (b % 2**64 >> 7) for a, b in zip(one, one[1:])]
    ends = [h(x.encode()[-q.ENDING :], Int(q.ENDING)) for x in w]
    return [g & (q.BUCKETS - 1) for g in one + two + ends]


def brute(rows, trusted):
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(grams(r.text))
        if r.doc_id in trusted:
            good.update(grams(r.text))
    nr, ng = sum(raw.values()) + q.BUCKETS, sum(good.values()) + q.BUCKETS
    ratio = lambda b: round(math.log((good[b] + 1) / ng) - math.log((raw[b] + 1) / nr), 5) if good else 0.0
    out = []
    for r in rows:
        g = grams(r.text)
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        b = base(r.text)
        out.append((r.doc_id, *b, not b[5] and score >= q.THRESHOLD))
    return sorted(out, key=str)


def test_matches_brute_force(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 1, 0), (3, 0, 0), (None, 1, None), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = q.annotate(odd_docs, labels)
    want = brute(odd_docs.select("doc_id", "text").collect(), {1, 7})
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == want


def test_real_texts(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert sorted((tuple(r)[:8] for r in q.annotate(docs, labels).collect()), key=str) == brute(docs.collect(), good)


def test_repeated_windows(spark):
    w = [f"w{i}" for i in range(30)]
    texts = [" ".join(w + w[5:14] + ["z"] * 3), " ".join(w[:12] * 2), " ".join(["a"] * 25), " ".join(w), "a\nb\na\n\n \nb", "# a | b <c>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:7] for r in q.annotate(df, labels).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_survivors_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = q.survivors(odd_docs, labels)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3}
    assert q.survivors(no_docs, labels).count() == 0
    assert q.annotate(no_docs, labels.limit(0)).count() == 0
