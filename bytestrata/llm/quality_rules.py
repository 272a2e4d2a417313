"""Quality rules: base counts of a text, and a log-likelihood ratio of hashed n-grams between two multinomials.

Word unigrams, word bigrams and word endings are hashed into ``buckets`` buckets. One multinomial over the buckets is counted from trusted
texts, one from the whole raw corpus, every n-gram of every text. A text's score is the mean over its n-grams of
log(p_trusted / p_raw); division by the number of n-grams makes long and short texts comparable. A text is kept when its
score reaches ``threshold``: no sampling, the same text always gets the same verdict.

Only DataFrame functions run. Counting shuffles one row per bucket and task. Scoring is a projection: the ratios, as many
as there are buckets whatever the corpus, are a constant of the plan.

Trusted texts are at most ``TRUSTED`` of the rows labelled good, those whose ids have the smallest hashes: a documented
bound of what is fitted on, which also bounds the broadcast of their ids. The raw counts have no bound.

Defined results: a null text has no words, and a text without words scores 0; null ids are never trusted; without
trusted or without raw n-grams all ratios are 0; rows that repeat are judged alike; further columns of the input play no part.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, text_or_empty, words_of

#: Hash buckets of the n-grams (a power of two); also the length of the constant that is sent with the tasks.
BUCKETS = 1 << 14
#: Bytes of a word's end that make an n-gram.
ENDING = 3
#: The hash of any word followed by itself.
TWICE = 20_263
#: The most trusted texts that the target multinomial is fitted on.
TRUSTED = 20_000
#: Added to every bucket's count.
SMOOTHING = 1.0
#: The least mean log ratio of a text that stays.
THRESHOLD = -0.2
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"


def _pairs(hashes: Column, apart: int, left: Column) -> Column:
    """Hashes of what stands at a place and ``apart`` places later, for the first ``left`` places."""
    n = F.greatest(left, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def _bigram(a: Column, b: Column) -> Column:
    """Of two words' hashes; a word twice in a row is one bigram, whatever the word."""
    return F.when(a == b, F.lit(TWICE).cast("long")).otherwise(a.bitwiseXOR(F.shiftrightunsigned(b, 7)))


def _ending(word: Column) -> Column:
    """Of a word's last ENDING bytes."""
    return F.xxhash64(F.substring(word.cast("binary"), -ENDING, ENDING), F.lit(ENDING))


def _ngrams(words: Column, hashes: Column) -> Column:
    """Hashes of a text's word unigrams, word bigrams and word endings."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.concat(hashes, F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), _bigram), F.transform(words, _ending))


def _covered(grams: Column) -> Column:
    """How many words lie in windows whose hash is found twice or more.

    grams: struct(hash, place) of each window, sorted.
    """
    twice = F.filter(grams, lambda g, k: (F.get(grams, k - 1)["h"] == g["h"]) | (F.get(grams, k + 1)["h"] == g["h"]))
    places = F.array_sort(F.transform(twice, lambda g: g["i"]))
    steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(F.lit(REPEAT_WINDOW), b - a), F.lit(REPEAT_WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct ``__q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the n-grams' hashes."""
    text = text_or_empty(text_col)
    w = docs.withColumn("__text", text).withColumn("__words", words_of(F.col("__text")))
    w = w.withColumn("__n", F.size("__words")).withColumn("__h1", F.transform("__words", lambda x: F.xxhash64(x)))
    w = w.withColumn("__h2", _pairs(F.col("__h1"), 1, F.col("__n") - 1))
    w = w.withColumn("__h4", _pairs(F.col("__h2"), 2, F.col("__n") - 3))
    w = w.withColumn("__h8", _pairs(F.col("__h4"), 4, F.col("__n") - (REPEAT_WINDOW - 1)))
    again = F.size(F.array_distinct("__h8")) < F.size("__h8")
    w = w.withColumn("__grams", F.when(again, F.array_sort(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    w = w.withColumn("__lines", lines)
    q = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("__grams")), F.lit(0)).cast("long").alias("n_repeat_words"),
        _ngrams(F.col("__words"), F.col("__h1")).alias("grams"),
    )
    return w.withColumn("__q", q).drop("__text", "__words", "__n", "__h1", "__h2", "__h4", "__h8", "__grams", "__lines")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """At most ``most`` ids that labels call good and never bad, by the smallest hashes."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long").alias("__trusted"))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """log(p_trusted / p_raw) of each bucket. trusted: a column of at most TRUSTED ids, which are broadcast."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), words_of(text_or_empty(text_col)).alias("__w"))
    known = texts.join(F.broadcast(trusted), F.col("__id") == F.col("__trusted"), "left")
    # the same n-grams as _ngrams', word by word: all of it, hashes and counts, is compiled into one loop
    beside = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, F.size("__w")).alias("b"))
    pairs = known.select(F.col("__trusted").isNotNull().cast("long").alias("__t"), F.explode(beside).alias("__p"))
    hashed = pairs.select("__t", "__p.a", F.xxhash64("__p.a").alias("ha"), F.when(F.col("__p.b").isNotNull(), F.xxhash64("__p.b")).alias("hb"))
    grams = hashed.select("__t", F.explode(F.array("ha", _bigram(F.col("ha"), F.col("hb")), _ending(F.col("a")))).alias("__g")).where("__g is not null")
    rows = grams.groupBy(F.col("__g").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("__t").alias("good")).collect()  # one row per bucket
    raw, good = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * buckets
    n_raw, n_good = sum(raw) + SMOOTHING * buckets, sum(good) + SMOOTHING * buckets
    return [round(log((g + SMOOTHING) / n_good) - log((r + SMOOTHING) / n_raw), 5) for g, r in zip(good, raw, strict=True)]


def _score(grams: Column, ratios: list[float]) -> Column:
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<double>)")
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g.bitwiseAND(F.lit(len(ratios) - 1)).cast("int")))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))


def judge(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct ``__q`` of the base counts, score, base_failed and kept."""
    counted = measure(docs, text_col)
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    scored = counted.withColumn("__score", _score(q["grams"], ratios))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # the partition id is never negative; as it isn't deterministic, a filter on the verdict stays above this projection
    # instead of repeating all of it, again for each reference, in its condition
    kept = ~failed & (F.col("__score") >= threshold) & (F.spark_partition_id() >= 0)
    found = F.struct(*[q[x].alias(x) for x in names], failed.alias("base_failed"), kept.alias("kept"), F.col("__score").alias("score"))
    return scored.withColumn("__q", found).drop("__score")


def annotate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return judge(slim, fit(slim, trusted_ids(labels))).select("doc_id", "__q.*")


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    return judge(docs, fit(docs, trusted_ids(labels), id_col, text_col), text_col).where("__q.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
