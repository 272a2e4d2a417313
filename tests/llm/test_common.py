import random

from bytestrata.llm import _common, line_dedup, near_join

from .conftest import words
from .test_line_dedup import exact, removed
from .test_near_join import _family, brute


def few(monkeypatch):
    """Make keys hot from three rows on."""
    monkeypatch.setattr(_common, "LEAST_HOT", 2)
    monkeypatch.setattr(_common, "HOT_KEYS", 50)


def test_hot_keys_meet_like_others(spark, monkeypatch):
    few(monkeypatch)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 5 + [3, 3, 4, 5, None])], "k int, i int")
    right = spark.createDataFrame([(1, "a", 40), (2, "b", 5), (3, "c", 2), (9, "z", 0)], "k int, v string, n long")
    names = {1: "a", 2: "b", 3: "c"}
    want = [(r.k, r.i, names[r.k]) for r in left.collect() if r.k in names]
    assert sorted(map(tuple, _common.meet(left, right, ["k"]).collect())) == sorted(want)
    assert sorted(map(tuple, _common.meet(left, right.drop("v"), ["k"], "left_semi").collect())) == sorted(w[:2] for w in want)
    assert _common.meet(left, right.limit(0), ["k"]).count() == 0


def test_hot_windows(spark, monkeypatch):
    few(monkeypatch)
    rng = random.Random(3)
    shared = [words(13, rng) for _ in range(4)]
    docs = [(i, "\n".join([words(5, rng), *shared[: 2 + i % 3], words(6, rng)])) for i in range(60)]
    assert removed(spark, docs) == exact(docs, line_dedup.NOISE)


def test_hot_copies_and_prefixes(spark, monkeypatch):
    few(monkeypatch)
    rng = random.Random(4)
    texts = _family(12, rng) + [words(40, rng)] * 30 + [words(30, rng) for _ in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((tuple(r) for r in near_join.annotate(df).collect()), key=str) == brute(df.collect())
