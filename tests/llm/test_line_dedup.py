import random

from pyspark.sql import functions as F

from bytestrata.llm import line_dedup

from .conftest import words


def test_planted_runs(spark):
    rng = random.Random(1)
    w = lambda n: words(n, rng)
    p, big = [w(10) for _ in range(6)], w(60)
    docs = [
        (1, "\n".join([w(9), *p, w(12)])), (2, "\n".join([w(8), w(9), *p[:3], "", *p[3:], w(7)])), (3, "\n".join([w(5), big])), (4, "\n".join([big, w(30), p[0], p[1]])),
        (9, "\n".join([w(30), *p, *p])), (10, w(200)), (11, None), (12, ""), (13, "a\nb\na"),
    ]
    docs += [(6, docs[0][1]), (None, docs[0][1]), (7, "x"), (7, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("lines", "spans", "th", "h", "marks", "u", "k")})
    got = {}
    for r in line_dedup.annotate(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_removed, [tuple(s) for s in r.spans]))
    assert got[1] == [(8, 0, [])] and got[2] == [(10, 7, [(2, 8)])] and got[3] == [(2, 0, [])] and got[4] == [(4, 1, [(0, 0)])]
    assert got[9] == [(13, 12, [(1, 6), (7, 12)])] and got[6] == [(8, 8, [(0, 7)])] and got[None] == [(8, 0, [])]
    assert got[7] == [(1, 0, [])] * 2 and got[10] == [(1, 0, [])] and got[11] == got[12] == [(1, 0, [])] and got[13] == [(3, 0, [])]


def brute(docs):
    """Line numbers of each document that lie in a run of NOISE + WINDOW - 1 words seen at an earlier place, and in one of NOISE."""
    sure, may = {}, {}
    for least, out in ((line_dedup.NOISE + line_dedup.WINDOW - 1, sure), (line_dedup.NOISE, may)):
        first = {}
        for i, text in sorted(docs):
            lines = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(text.split("\n"))]
            lines = [(k, x) for k, x in lines if x]
            for a in range(len(lines)):
                n, b = 0, a
                while b < len(lines) and n < least:
                    n += len(lines[b][1].split())
                    b += 1
                if n < least:
                    break
                run = tuple(x for _, x in lines[a:b])
                if run in first:
                    out.setdefault(i, set()).update(k for k, _ in lines[a:b])
                first.setdefault(run, (i, a))
    return sure, may


def test_guarantee_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sure, may = brute([(r.doc_id, r.text) for r in docs.collect()])
    for r in line_dedup.annotate(docs).collect():
        lines = r.text
        gone = {k for a, b in r.spans for k in range(a, b + 1)}
        assert sure.get(r.doc_id, set()) <= gone, r.doc_id
        assert not gone or gone & may.get(r.doc_id, set()), r.doc_id
        assert r.n_removed == len(gone) and lines is not None


def test_long_and_empty(spark, odd_docs, no_docs):
    got = line_dedup.annotate(odd_docs)
    assert got.count() == odd_docs.count()
    assert line_dedup.annotate(no_docs).count() == 0
    rng = random.Random(5)
    text = "\n".join(words(3, rng) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, "head\n" + text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.annotate(df).collect()} == {1: 0, 2: 3000}


def exact(docs, least):
    """Line numbers of each document that lie in any run of so many words seen at an earlier place."""
    first, out = {}, {}
    for i, text in sorted(docs):
        lines = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if len(" ".join(run).split()) >= least and first.setdefault(run, (i, a)) != (i, a):
                    out.setdefault(i, set()).update(range(lines[a][0], lines[b - 1][0] + 1))
    return out


def removed(spark, docs):
    got = line_dedup.annotate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: {k for a, b in r.spans for k in range(a, b + 1)} for r in got if r.n_removed}


def test_nested_passages(spark):
    """A passage alone in one document, inside a longer run that two others share; and two longer runs of one document."""
    rng, docs = random.Random(11), []
    run = lambda n: [words(5, rng) for _ in range(n)]
    for at in range(0, 400, 10):
        x, p, y = run(3), run(6), run(3)
        docs += [(at + k, "\n".join(t)) for k, t in enumerate([run(2) + p + run(2), run(2) + x + p + y, x + p + y + run(2), p + run(1) + x + p + y])]
    want = exact(docs, 50)
    got = removed(spark, docs)
    assert len(want) >= 80 and all(lines <= got.get(i, set()) for i, lines in want.items())


def test_every_run_from_noise_on(spark):
    """Lines of 1 to 30 words from a small stock, with empty ones between: what goes is what brute force finds, no more."""
    rng = random.Random(12)
    stock = [words(n, rng) for n in (1, 2, 3, 5, 8, 11, 13, 24, 25, 26, 30)] + [""]
    docs = [(k, "\n".join(rng.choice(stock) if rng.random() < 0.8 else words(4, rng) for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    want = exact(docs, line_dedup.NOISE)
    assert len(want) > 80 and removed(spark, docs) == want
