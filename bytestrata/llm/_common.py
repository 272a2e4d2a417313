"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage as cut_lineage
from ..operators.lineage import shared_folder as shared_folder
from ..sources.tables import read as read

#: The white space that separates words: U+0020 and U+0009 to U+000D, and nothing else.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none.

    All white space becomes U+0020 first, as a split at one plain character needs no regular expression.
    """
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of what was written between steps."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key of more than 1/HOT_KEYS of all rows (and of LEAST_HOT) is hot.
HOT_KEYS, LEAST_HOT = 1024, 1000


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right (inner or left_semi) on keys that are unique in right, whose n says how many rows of left have them.

    Rows of hot keys don't meet in one task: their rows of right, fewer than HOT_KEYS, are broadcast. right should be written
    out, as it is read several times.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = right.where(F.col("n") > max(LEAST_HOT, total // HOT_KEYS))
    if not hot.limit(1).count():
        return left.join(right.drop("n"), keys, how)
    rest = right.where(F.col("n") <= max(LEAST_HOT, total // HOT_KEYS)).drop("n")
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot.drop("n")), keys, how).unionByName(others.join(rest, keys, how))
