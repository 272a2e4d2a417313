"""Exact dedup: local combining, salted digest groups, then a global combination of the salts' winners.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Every stage of the
combination groups by the whole normalised text beside its digest, so a digest that two texts share does not join them:

1. *locally*: the partial aggregation of each task leaves one row per text and task, whatever the number of copies;
2. *salted*: a hot digest, one that holds more than 1/``HOT_SHARE`` of all rows, is split by the task that its rows come
   from, so no reducer gets a row of each task of a large cluster; other digests have no salt;
3. *globally*: the winners of a hot digest's salts are combined. Other rows pass with their digest alone, without text.

So texts cross the network once, after local combining; what follows are rows of some 60 bytes.

A hot digest holds over 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE of them: that bounds what is broadcast.

Defined results: a null text is an empty one; a null doc_id loses against any other, and a group with no other has a
null keep_id; of rows that repeat the winner's doc_id and length one, and only one, is kept; an empty table gives an
empty result; further columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, cut_lineage, text_or_empty

#: A digest with more than 1/HOT_SHARE of all rows (and MIN_HOT rows) is salted.
HOT_SHARE = 2048
MIN_HOT = 32
#: Salts of a hot digest while texts are combined.
TEXT_SALTS = 64

_HALF, _WHOLE = 2**63, 2**65


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that is the greater the more characters, then the smaller the doc_id; null ids rank last.

    It has a fixed width, so its maximum is kept in a hash aggregation.
    """
    by_id = F.coalesce((_decimal(_HALF) - doc_id.cast("decimal(38,0)")).cast("decimal(38,0)"), _decimal(0))
    return ((n_chars.cast("decimal(12,0)") * F.lit(str(_WHOLE)).cast("decimal(21,0)")).cast("decimal(38,0)") + by_id).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    rest = (rank % _decimal(_WHOLE)).cast("decimal(38,0)")
    return F.when(rest == 0, F.lit(None).cast("long")).otherwise((_decimal(_HALF) - rest).cast("long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    normal = texts.select("doc_id", F.char_length("text").cast("long").alias("n_cp"), F.regexp_replace("text", SPACE + "+", "").alias("norm"))
    return normal.withColumn("digest", digest(F.col("norm")))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the doc_id of the group's row with the most code points, then the smallest doc_id. digest only spreads
    the texts: results are the same with a weak one.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    slim = cut_lineage(keyed.select("doc_id", "n_cp", "digest"))
    total = slim.count()
    share = max(MIN_HOT, total // HOT_SHARE)
    # fewer than HOT_SHARE rows, as each stands for more than 1/HOT_SHARE of the total
    hot = cut_lineage(slim.groupBy("digest").count().where(F.col("count") > share).select("digest", F.ceil(F.col("count") / share).cast("int").alias("salts")))

    salted = keyed.join(F.broadcast(hot), "digest", "left").select(
        "digest", "norm", F.when(F.col("salts").isNotNull(), F.spark_partition_id() % TEXT_SALTS).alias("salt"), _rank(F.col("n_cp"), F.col("doc_id")).alias("best")
    )
    local = salted.groupBy("digest", "salt", "norm").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    passing = local.select("digest", F.when(F.col("salt").isNotNull(), F.col("norm")).alias("norm"), F.when(F.col("salt").isNull(), F.col("best")).alias("own"), "best", "n")
    contents = passing.repartition("digest").groupBy("digest", "norm", "own").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    groups = cut_lineage(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("best").alias("best"), F.max("n").alias("n")))

    if groups.where("texts > 1").limit(1).count():
        members = _members_by_text(keyed)
    else:
        on_salt = slim.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")).drop("salts")
        spread = groups.join(F.broadcast(hot), "digest", "left").select("digest", "best", "n", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        members = on_salt.join(spread, ["digest", "salt"])
    won = members.withColumn("wins", _rank(F.col("n_cp"), F.col("doc_id")) == F.col("best"))
    nth = F.row_number().over(Window.partitionBy("digest", "salt", "wins", "doc_id").orderBy("n_cp"))
    return won.select(
        "doc_id", _id_of(F.col("best")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("wins") & (nth == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _members_by_text(keyed: DataFrame) -> DataFrame:
    """The way for digests that several texts share: rows meet their group by the whole text."""
    groups = keyed.groupBy("digest", "norm").agg(F.max(_rank(F.col("n_cp"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n"))
    # the winner's rank tells the texts of one digest apart, as no two texts have the same doc_id and length but in repeated ids
    return keyed.join(groups, ["digest", "norm"]).withColumn("salt", F.xxhash64("norm")).drop("norm")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    every = cut_lineage(annotate(docs, id_col, text_col).select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"), "kept"))
    kept = every.where("kept").drop("kept")
    own = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__sha": F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE + "+", ""), 256), "__cp": F.char_length(text_or_empty(text_col))})
    hit = own.join(kept, (F.col("__id").eqNullSafe(F.col("__kept_id"))) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    if every.groupBy("__kept_id", "__kept_sha").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept and n > 1").limit(1).count():
        # rows that repeat a doc_id with an equal text: the longest of them, and one only
        first = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy(F.desc("__cp")))
        hit = hit.withColumn("__nth", first).where("__nth = 1")
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns])
