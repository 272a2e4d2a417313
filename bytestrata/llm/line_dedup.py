"""Line dedup by winnowing: later copies of runs of lines are deleted across and within documents.

Lines are trimmed, and lines without words are passed over. Documents are ordered by doc_id.

1. *Line hashes*: lines are hashed. A window is the shortest run of lines from a given line on, or back from it, that has
   ``NOISE`` words or more; where one line is enough, it and the next are a window too.
2. *Winnowing*: the least line hash of a window, at its first place there, is the window's fingerprint. Neighbouring
   windows mostly have the same one. Equal windows have equal fingerprints, so one that stands at a single place of the
   whole corpus says that its windows are no copies: for most texts that is all that is shuffled, 8 bytes a fingerprint.
3. *Positions and extension*: a fingerprint of several places is extended both ways, back and on, to the windows that it
   is the fingerprint of. A window meets the first place of all windows with the same lines, so one that a third of all
   documents have costs one row a place, not one a pair of places, and a run finds its copy wherever that stands: not only
   in the document that has the fingerprint first.
4. *Deletion*: all lines of each window that isn't at its first place go, with the lines without words inside it. Windows
   that overlap are one span, so a repeated run goes whole.

Every line of every run of NOISE words or more that stands at an earlier place goes, and no other: a line of such a run
lies in a window inside the run, forward from it or, near the run's end, back from there; lines next to each other share
one. A line's first place in the corpus is in no later copy, so one copy of every line stays.

Texts are shuffled once, to meet their deletions; a fingerprint or window that very many places share meets its places by
broadcast, so no task gets them all. Only DataFrame functions run.

Defined results: a null text is empty; rows without doc_id neither lose lines nor cost others any; rows that share doc_id
and text are one document, returned as often as it stands; a copy of a whole document of NOISE words or more is left with
no lines, and an empty text; an empty table gives no rows; further columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, SPACE_CHARS, cut_lineage, meet, text_or_empty

#: Words that a window has at least; shorter repeated runs stay.
NOISE = 25
#: Windows that a repeated run must hold: runs of NOISE + WINDOW - 1 words are always found.
WINDOW = 1


def _lines(text: Column) -> Column:
    """struct(h, i, w) of each line with words: its hash, its number and its words."""
    trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(SPACE_CHARS)).alias("t"), i.alias("i")))
    return F.transform(F.filter(trimmed, lambda x: F.length(x["t"]) > 0), lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), x["i"].alias("i"), F.size(F.split(x["t"], SPACE + "+")).alias("w")))


def _window(words: Column) -> Column:
    """How many of the lines with these words the window has; 0 if they are too few."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
    return F.aggregate(words, first, lambda s, x: F.when(s["w"] >= NOISE, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["w"] + x).alias("w"))), lambda s: F.when(s["w"] >= NOISE, s["n"]).otherwise(0))


def _mark(k: Column, n: Column | int) -> Column:
    """struct(u, s, e, f, p) of the n lines from line k on: their hash, first and last line number, least line hash and its place."""
    lines = F.slice("h", k + 1, n)
    least = F.array_min(lines)
    return F.struct(F.xxhash64(lines).alias("u"), F.get("i", k).alias("s"), F.get("i", k + n - 1).alias("e"), least.alias("f"), (k + F.array_position(lines, least)).cast("int").alias("p"))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (the text's hash) and marks, the windows."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id is not null").where(F.length(F.btrim("text", F.lit(SPACE_CHARS))) > 0)
    d = d.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("lines"))
    d = d.select("doc_id", "th", F.transform("lines", lambda x: x["h"]).alias("h"), F.transform("lines", lambda x: x["i"]).alias("i"), F.transform("lines", lambda x: x["w"]).alias("w"))
    d = d.withColumn("on", F.transform("w", lambda _, k: _window(F.slice("w", k + 1, NOISE))))
    d = d.withColumn("back", F.transform("w", lambda _, k: _window(F.reverse(F.slice("w", F.greatest(k + 2 - NOISE, F.lit(1)), F.least(k + 1, F.lit(NOISE)))))))
    on = F.transform("on", lambda n, k: F.when(n > 0, _mark(k, n)))
    pair = F.transform("on", lambda n, k: F.when((n == 1) & (k + 1 < F.size("on")), _mark(k, F.lit(2))))

    def rest(n: Column, k: Column) -> Column:
        """The window back from line k, if it isn't among the others."""
        there = F.get("on", k + 1 - n)
        return F.when((n > 0) & (there != n) & ~((there == 1) & (n == 2)), _mark(k + 1 - n, n))

    marks = F.filter(F.concat(on, pair, F.transform("back", rest)), lambda x: x.isNotNull())
    return d.select("doc_id", "th", marks.alias("marks"))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th and spans, an array of (start, end) line numbers, both included, of documents that lose lines."""
    rows = cut_lineage(hashed(docs, id_col, text_col))
    places = rows.select(F.explode(F.array_distinct(F.transform("marks", lambda m: F.struct(m["f"].alias("f"), m["p"].alias("p"))))).alias("at"))
    shared = cut_lineage(places.groupBy("at.f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f", "n"))
    every = rows.select("doc_id", "th", F.explode("marks").alias("m")).select("doc_id", "th", "m.*").drop("p")
    marks = cut_lineage(meet(every, shared, ["f"], "left_semi"))
    first = cut_lineage(marks.groupBy("u").agg(F.min(F.struct("doc_id", "th", "s")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = meet(marks, first, ["u"]).where("not (doc_id = at.doc_id and th = at.th and s = at.s)").groupBy("doc_id", "th", "s").agg(F.max("e").alias("e"))
    text = Window.partitionBy("doc_id", "th").orderBy("s")
    before = F.max("e").over(text.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("span", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.groupBy("doc_id", "th", "span").agg(F.struct(F.min("s").alias("start"), F.max("e").alias("end")).alias("span_"))
    return spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("span_")).alias("spans"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, spans and the text that is left."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    gone = deletions(docs, id_col, text_col)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    met = own.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    met = met.withColumn("lines", F.split("text", "\n"))
    left = F.filter("lines", lambda x, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i <= s["end"])))
    met = met.withColumn("left", F.when(F.size("spans") > 0, left))
    return met.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"), "spans", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("text")
    )
