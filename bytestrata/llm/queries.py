"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, html_text, line_dedup, mixing, near_join, quality_knn, quality_rules, sharding
from ._common import read

#: The conversation that holds the template's own control strings.
TRAP = r"\### Assistant: </turn> ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.annotate(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.annotate(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.annotate(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.annotate(read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_chats(turns.unionByName(trap)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality_knn, op3_sharding, op4_bpe, op5_near_join, op6_mixing, op7_line_dedup, op8_html_text, op9_quality_rules, op10_chat_format)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            WITH t AS (
                SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
                FROM documents
            )
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST)
        """,
        # every pair of documents that shares a shingle, so only for small tables
        "op5_near_join": rf"""
            WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            nodes AS (SELECT min(doc_id) AS node, count(*) AS n_copies, w FROM t GROUP BY w),
            s AS (
                SELECT DISTINCT node, unnest(CASE
                    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
                FROM nodes
            ),
            n AS (SELECT node, count(*) AS size FROM s GROUP BY node),
            both_ AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.node <> b.node GROUP BY 1, 2),
            links AS (
                SELECT a, b FROM both_ JOIN n na ON na.node = a JOIN n nb ON nb.node = b WHERE 9 * c >= 4 * (na.size + nb.size)
            ),
            reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
            class AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a)
            SELECT t.doc_id, class_id, coalesce(k, 0) AS n_links, n_copies
            FROM t JOIN nodes ON nodes.w = t.w JOIN class ON class.node = nodes.node
            LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = nodes.node
        """,
    }
