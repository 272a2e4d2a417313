"""Finding-shaped rows from relational tables, so that the interval operators run over any number of rows.

Each expression is plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

#: A blob is an order; its candidates are the order's lines. Sizes of 0 are unknown, as in any finding.
COLUMNS = {
    "blob_id": "l_orderkey",
    "offset_": "((l_partkey * 7 + l_linenumber * 13) % 64) * 16",
    "size_": "CASE WHEN l_suppkey % 6 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 4 * (1 + l_suppkey % 5) END",
    "type_": "concat('t', CAST(l_partkey % 7 AS VARCHAR(4)))",
    "category": "CASE l_suppkey % 6 WHEN 0 THEN 'filesystem' WHEN 1 THEN 'container' WHEN 2 THEN 'archive' WHEN 3 THEN 'crypto' WHEN 4 THEN 'image' ELSE 'executable' END",
    "confidence": "CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 25 WHEN 1 THEN 60 WHEN 2 THEN 85 ELSE 99 END",
    "endian": "CASE l_linestatus WHEN 'O' THEN 'little' ELSE 'big' END",
}
#: Every blob's length; the longest candidate ends before it.
LENGTH = 4096

#: Every order is a blob; some can't be opened, and those and others have no candidates.
BLOBS_SQL = f"SELECT o_orderkey AS blob_id, CASE WHEN o_custkey % 40 = 7 THEN NULL ELSE CAST({LENGTH} AS BIGINT) END AS length FROM orders"
#: The candidates of those that can be opened, thinned out.
FEW = "(offset_ / 16) % 4 = 1"

SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM lineitem"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob_id and length, null where a blob can't be opened."""
    return tables.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS blob_id", f"CASE WHEN o_custkey % 40 = 7 THEN NULL ELSE CAST({LENGTH} AS BIGINT) END AS length")


def few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that leave many blobs without any."""
    return candidates(spark, sf_dir).where(FEW).join(blobs(spark, sf_dir).where("length is not null").select("blob_id"), "blob_id", "left_semi")
