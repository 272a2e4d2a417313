import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytestrata.llm import mixing

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    free = [t / w for t, w, s in zip(got, weights, sizes, strict=True) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(free)


def test_split_tree_is_exact():
    quotas = [100, 3, 0, 57, 1]
    got = mixing.split_tree(quotas, 16, np.random.default_rng(1))
    assert got.shape == (16, 5) and got.sum(0).tolist() == quotas and got.sum(1).max() - got.sum(1).min() <= 1


def _check(rows, docs):
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), len(WORD.findall(d.text or ""))) for d in docs)
    assert all(0 <= r.taken <= 2 * r.size and len(r.shards) * r.size == r.taken for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.annotate(odd_docs).collect()
    _check(rows, odd_docs.select("doc_id", "text").collect())
    assert mixing.annotate(no_docs).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mixed(no_docs).count() == 0


def test_sources_come_near_their_targets(spark):
    rng = random.Random(4)
    docs = [(i, words(rng.randint(1, 300), rng, 3), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.annotate(df).collect()
    _check(rows, df.collect())
    source = {d[0]: d[2] for d in docs}
    sums, want, size = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sums[s], want[s], size[s] = sums.get(s, 0) + r.taken, r.target, size.get(s, 0) + r.size
        assert r.source_size >= r.size
    names = sorted((s for s in want if s is not None)) + [None]
    expected = mixing.targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert all(abs(want[s] - e) < 1e-6 for s, e in zip(names, expected, strict=True))
    assert all(abs(sums[s] - want[s]) <= 0.005 * want[s] for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.annotate(df.repartition(9)).collect()))
    mixed = [r.doc_id for r in mixing.mixed(df).collect()]
    times = {r.doc_id: len(r.shards) for r in rows}
    assert sorted(mixed) == sorted(i for i, n in times.items() for _ in range(n))


def brute(docs, seed=mixing.SEED, shards=mixing.SHARDS):
    """Each document's draws as (shard, draw), from the rows and their hashes, block by block."""
    names = sorted({d.source for d in docs if d.source is not None}) + ([None] if any(d.source is None for d in docs) else [])
    goal = mixing.targets([sum(d.size for d in docs if d.source == s) for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    out, lists = {}, []
    for rank, (name, target) in enumerate(zip(names, goal, strict=True)):
        own = [d for d in docs if d.source == name]
        n = max(1, min(-(-len(own) // mixing.BLOCK_DOCS), mixing.BLOCKS * len(own) // len(docs)))
        blocks = {}
        for d in own:
            blocks.setdefault(d.h % n, []).append(d)
        keys, order, done, draws = sorted(blocks), np.random.default_rng([seed, rank]), 0.0, []
        for draw in range(mixing.MOST):
            for k in order.permutation(len(keys)):
                if done is not None:
                    total = sum(d.size for d in blocks[keys[k]])
                    if done + total <= target + 1e-6:
                        draws.append((blocks[keys[k]], draw))
                        done += total
                    else:
                        draws.append((cut(blocks[keys[k]], int(round(target - done))), draw))
                        done = None
        lists.append(draws)
    dealt = mixing.split_tree([len(x) for x in lists], shards, np.random.default_rng([seed, len(lists)]))
    for rank, draws in enumerate(lists):
        for (block, draw), shard in zip(draws, np.repeat(np.arange(shards), dealt[:, rank]), strict=True):
            for d in block:
                if d.size:
                    out.setdefault(d.doc_id, []).append(int(shard))
    return {k: sorted(v) for k, v in out.items()}


def cut(block, left):
    taken, over = [], None
    for d in sorted(block, key=lambda d: (-d.size, d.h, d.doc_id)):
        if 0 < d.size <= left:
            taken, left = [*taken, d], left - d.size
        elif d.size:
            over = d
    return [*taken, over] if over is not None and over.size - left < left else taken


def test_draws_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, words(rng.randint(0, 60), rng, 3), rng.choice(["a", "b", "b", "c", "d", None])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = brute(mixing.sized(df, "doc_id", "text", "source", mixing.SEED).collect())
    got = {r.doc_id: sorted(r.shards) for r in mixing.annotate(df).collect() if r.shards}
    assert got == want and max(map(len, want.values())) == 2


def test_mix_is_sharded_and_shuffled(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, words(rng.randint(1, 40), rng, 3), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    places = {}
    for r in mixing.annotate(df).collect():
        for shard, place in zip(r.shards, r.places, strict=True):
            places.setdefault(shard, []).append((place, r.doc_id))
    for parts in (16, 48):
        out = [r for r in mixing.mixed(df, partitions=parts).select("doc_id", F.spark_partition_id().alias("p")).collect()]
        rows = {}
        for r in out:
            rows.setdefault(r.p // (parts // 16), []).append(r.doc_id)
        assert rows == {shard: [d for _, d in sorted(x)] for shard, x in places.items()}
        assert all(x != sorted(x) for x in rows.values())


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 500 + [(i, "d e", "t") for i in range(2, 300)], "doc_id long, text string, source string")
    rows = mixing.annotate(df).collect()
    assert len(rows) == 798 and len({tuple(r.shards) for r in rows if r.doc_id == 1}) == 1
