"""Folds over one large blob against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from bytestrata.operators import intervals

COLUMNS = "blob_id long, offset_ long, size_ long, type_ string, category string, confidence int, endian string"


def candidates(n, seed, span):
    rng = random.Random(seed)
    return [(1, rng.randrange(span), rng.choice([0, 8, 40, 200, 1000]), f"t{rng.randrange(5)}", rng.choice(["filesystem", "container", "archive", "crypto", "image"]), rng.choice([25, 60, 85, 99]), rng.choice(["little", "big"])) for _ in range(n)]


def fold(rows):
    kept, owner, end = [], None, -1
    for r in sorted(rows, key=lambda r: (r[1], -r[5], r[2], r[3], r[6] == "big", r[4])):
        if kept and kept[-1][0][1] == r[1]:
            kept[-1][1] += 1
        elif owner and r[1] < end:
            owner[1] += 1
        else:
            kept.append([r, 0])
            if r[5] >= 60 and r[2] > 0:
                owner, end = kept[-1], r[1] + r[2]
    return sorted((*r, also) for r, also in kept)


@pytest.mark.parametrize(("n", "span"), [(100_000, 5_000_000), (3000, 400), (500, 1_000_000)])
def test_one_blob_of_many_candidates(spark, n, span):
    rows = candidates(n, n, span)
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, intervals.owned(df).collect())) == fold(rows)


def test_batches_cut_anywhere(spark):
    rows = [(b, *r[1:]) for b in range(30) for r in candidates(97, b, 900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = intervals.owned(spark.createDataFrame(rows, COLUMNS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [x for b in range(30) for x in fold([r for r in rows if r[0] == b])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_parents_in_one_blob(spark):
    rows = candidates(2000, 5, 6000)
    placed = sorted(rows, key=lambda r: (r[1], -r[5], r[2], r[3], r[6] == "big", r[4]))
    boxes = [(r[2], k, r[1], r[1] + r[2], r[3]) for k, r in enumerate(placed) if r[4] in ("filesystem", "container") and r[2]]
    want = {}
    for k, r in enumerate(placed):
        around = [(size, p, t) for size, p, a, b, t in boxes if a <= r[1] and r[1] + r[2] <= b and size > r[2]]
        want[k] = min(around)[1:] if around else (None, None)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(placed)], COLUMNS + ", place int")
    assert {r.place: (r.parent_place, r.parent_type) for r in intervals.parents(df).collect()} == want


def test_gaps_of_blobs_without_findings(spark):
    blobs = spark.createDataFrame([(1, 1000), (2, 500), (3, None), (4, 0)], "blob_id long, length long")
    rows = spark.createDataFrame([(1, 100, 50, "a", "image", 60, "little"), (1, 300, 100, "b", "container", 60, "little"), (1, 450, 50, "c", "container", 60, "little"), (1, 700, 0, "d", "image", 60, "little")], COLUMNS)
    got = intervals.gaps(blobs, rows, 20).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 100), (1, 150, 150), (1, 500, 500), (2, 0, 500)]  # 400 to 450 is bridged


def test_swarms_keep_what_matters(spark):
    rows = [(1, k, 1, t, c, 60, "little", 7) for t, c in (("private_key", "crypto"), ("certificate", "crypto"), ("elf", "executable"), ("png", "image")) for k in range(6 if t != "png" else 4)]
    df = spark.createDataFrame(rows, COLUMNS + ", parent_place int")
    assert [(r.type_, r.n, r.bytes) for r in intervals.swarms(df).collect()] == [("certificate", 6, 6)]
    assert df.where(~intervals.keep_expanded(F.col("type_"), F.col("category"))).count() == 10
