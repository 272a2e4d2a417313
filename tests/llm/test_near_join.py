import random
import re
from fractions import Fraction

import numpy as np

from bytestrata.llm import components, near_join

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id, class_id, n_links, n_copies of every row, from all pairs."""
    nodes = {}
    for r in rows:
        nodes.setdefault(tuple(WORD.findall(r.text or "")), []).append(r.doc_id)
    keys = [(min((i for i in ids if i is not None), default=None), k, len(ids)) for k, ids in nodes.items()]
    named = {n: shingle_set(" ".join(k)) for n, k, _ in keys if n is not None}
    links = {n: {m for m, t in named.items() if m != n and s and t and 5 * len(s & t) >= 4 * len(s | t)} for n, s in named.items()}
    root = {n: n for n in named}
    for _ in named:
        for n in named:
            root[n] = min([root[n], *(root[m] for m in links[n])])
    info = {k: (root.get(n), len(links.get(n, ())), c) for n, k, c in keys}
    return sorted([(r.doc_id, *info[tuple(WORD.findall(r.text or ""))]) for r in rows], key=str)


def test_matches_all_pairs(odd_docs):
    got = sorted((tuple(r) for r in near_join.annotate(odd_docs).collect()), key=str)
    assert got == brute(odd_docs.collect())


def _family(n, rng):
    """Near copies of one text: each changes one or two words."""
    base = words(150, rng).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(150)] = words(1, rng)
        out.append(" ".join(w))
    return out


def test_tiles_lose_no_link(spark):
    rng = random.Random(2)
    texts = _family(60, rng) + _family(25, rng) + [words(80, rng) for _ in range(40)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(df.collect())
    for tile in (2048, 8):
        assert sorted((tuple(r) for r in near_join.annotate(df, tile_docs=tile).collect()), key=str) == want


def test_survivors_and_empty(spark, odd_docs, no_docs):
    kept = near_join.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 8 not in ids
    assert near_join.annotate(no_docs).count() == 0
    assert near_join.survivors(no_docs).count() == 0


def test_prefix_length_reaches_recall():
    d = near_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**d) ** near_join.TREES >= near_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_join.TREES


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(300)]
    got = near_join._shared(sets)
    for a, b in [(0, 1), (5, 9), (299, 3), (100, 200)]:
        assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(60 - i, 59 - i) for i in range(9)] + [(101, 100), (102, 100), (102, 101)]
    got = components.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(1, 31)} | {i: 51 for i in range(52, 61)} | {101: 100, 102: 100}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similarity_is_exact(spark):
    """9 of 11 shingles shared is 0.818; 8 of 12 is less than 0.8."""
    w = [f"w{i}" for i in range(14)]
    texts = [" ".join(w), " ".join([*w[:13], "other"]), " ".join([*w[:12], "an", "other"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in near_join.annotate(df, similarity=Fraction(4, 5)).collect()) == brute(df.collect())


def _pair(similarity, rng):
    """Two texts whose shingle sets have about this similarity: each cut of a word changes five shingles."""
    w = words(400, rng).split()
    other, n = list(w), 396
    cuts = max(1, round((1 - similarity) / (1 + similarity) * n / 5))
    for k in range(cuts):
        other[5 + k * (390 // cuts)] = words(1, rng)
    return " ".join(w), " ".join(other)


def test_forest_recall(spark):
    """Measured: the share of linked pairs at several similarities that the forest finds, at least 0.99 of each."""
    rng = random.Random(21)
    texts, kind = [], []
    for s in (0.81, 0.85, 0.9):
        for _ in range(100):
            texts += _pair(s, rng)
            kind += [s]
    got = {r.doc_id: r for r in near_join.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for s in (0.81, 0.85, 0.9):
        linked = [k for k in range(len(kind)) if kind[k] == s and 5 * len(shingle_set(texts[2 * k]) & shingle_set(texts[2 * k + 1])) >= 4 * len(shingle_set(texts[2 * k]) | shingle_set(texts[2 * k + 1]))]
        assert len(linked) > 50
        assert sum(got[2 * k + 1].class_id == 2 * k for k in linked) / len(linked) >= 0.99


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    """Weak pairs ask for shorter prefixes than near copies; each level looks up one length."""
    rng, asked = random.Random(22), []
    clusters = near_join._clusters
    monkeypatch.setattr(near_join, "_clusters", lambda trie, d, depth: asked.append(d) or clusters(trie, d, depth))
    strong = [t for _ in range(30) for t in _pair(0.97, rng)]
    near_join.annotate(spark.createDataFrame(list(enumerate(strong)), "doc_id long, text string")).count()
    assert asked == [near_join.DEPTH]
    asked.clear()
    weak = [t for _ in range(60) for t in _pair(0.8, rng)]
    near_join.annotate(spark.createDataFrame(list(enumerate(weak)), "doc_id long, text string")).count()
    assert asked == [near_join.DEPTH, near_join.prefix_length(0.8)]


def test_survivors_of_shared_ids(spark):
    """Rows that share a doc_id and differ in words are documents of their own; null ids are compared like any."""
    rng = random.Random(23)
    a, u = words(60, rng), words(60, rng)
    near = a.replace(a.split()[30], "other")
    df = spark.createDataFrame([(1, a), (9, a), (9, u), (None, near), (None, u + " more"), (None, words(50, random.Random(1))), (9, u)], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text[:20]) for r in near_join.survivors(df).collect())
    assert kept == sorted([("1", a[:20]), ("9", u[:20]), ("None", words(50, random.Random(1))[:20])])
