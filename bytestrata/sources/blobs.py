"""Blobs: rows of (blob_id, content) from files, text columns or packed table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def from_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-1, SRC-2: every file under a path: path, length, content and a stable id."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.xxhash64("path").alias("blob_id"), "path", "length", "content")


def from_text(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text column's UTF-8 bytes as blobs."""
    return rows.select(F.col(id_col).cast("long").alias("blob_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("content"))


def number(value: Column, width: int, endian: str = "big") -> Column:
    """An integer column as so many bytes."""
    raw = F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))
    return F.reverse(raw) if endian == "little" else raw


def packed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boot image with a 64-byte header for each order; its payload is the priority's text.

    The header's CRC is right for orders of status F alone.
    """
    orders = tables.read(spark, sf_dir, "orders")
    payload = F.encode("o_orderpriority", "UTF-8")
    head = lambda crc: F.concat(
        F.unhex(F.lit("27051956")), crc, number(F.col("o_custkey"), 4), number(F.octet_length("o_orderpriority"), 4), number(F.col("o_orderkey") % 65536, 4), number(F.lit(0), 4),
        number(F.crc32(payload), 4), F.unhex(F.lit("05050203")), F.rpad(F.encode(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "UTF-8"), 32, F.unhex(F.lit("00"))),
    )
    zero = number(F.lit(0), 4)
    crc = F.when(F.col("o_orderstatus") == "F", number(F.crc32(head(zero)), 4)).otherwise(zero)
    return orders.select(F.col("o_orderkey").alias("blob_id"), F.concat(head(crc), payload).alias("content"))
