import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, rng: random.Random, size: int = 6) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=size)) for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and further columns whose names clash."""
    rng = random.Random(7)
    long = words(20_000, rng)
    some = words(120, rng)
    near = some.replace(some.split()[60], "changed")
    rows = [
        (1, some, "en", "b", 5), (2, some + " \n", None, "a", None), (3, near, "en", "b", 5), (4, None, "en", None, 0), (5, "", None, None, None),
        (6, " \t\n", "en", "b", 3), (7, long, "en", "c", len(long)), (8, long + " tail", "en", "c", 1), (9, "one two", "en", "a", 7), (9, "one two", "en", "a", 7),
        (None, some, "en", "b", 5), (None, None, None, None, None), (10, "x" * 70_000, "de", "z", 70_000), (11, "ünï cödé 🙂 " * 30, "de", "é", 1), (12, "one  two", "en", "a", 8),
    ]
    base = spark.createDataFrame(rows, SCHEMA)
    clash = {c: base["doc_id"].cast("string") for c in ("digest", "norm", "size", "shard", "salt", "best", "words", "keys", "node", "kept", "score", "h", "part", "uses", "rank", "spans", "lines", "n_words", "label", "quality")}
    return base.withColumns(clash)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
