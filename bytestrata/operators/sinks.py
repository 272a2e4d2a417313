"""What leaves the engine: JSON documents, carved ranges, manifests. Rows in, rows out; writing is the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import blob_name, mime
from .intervals import gaps
from .summaries import assessments, summary

SCHEMA_VERSION = 1


def documents(blobs: DataFrame, findings: DataFrame, least: int = 4096) -> DataFrame:
    """SNK-1: one JSON document a blob: its size, findings in order, summary, assessment and unidentified regions; empty keys are left out.

    blobs: blob_id, content, and path if there is one.
    """
    f = F.struct(
        F.col("offset_").alias("offset"), F.col("size_").alias("size"), F.col("type_").alias("type"), mime(F.col("type_")).alias("mime"), "category", "confidence", F.col("tier").alias("confidence_tier"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("evidence", "endian", "version", "label", "compression", "description", "vendor")],
        F.when(F.col("coalesced_count") > 1, F.col("coalesced_count")).alias("coalesced_count"),
        *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("references", "limitations", "members", "diagnostics", "also_matched")],
    )
    path = F.col("path") if "path" in blobs.columns else F.col("blob_id").cast("string")
    known = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), path.alias("path"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length"))
    grouped = findings.groupBy("blob_id").agg(F.sort_array(F.collect_list(f)).alias("findings"))
    placed = findings.withColumn("place", F.row_number().over(Window.partitionBy("blob_id").orderBy("offset_", "size_", "type_")))
    regions = gaps(known, findings, least).groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct(F.col("gap_offset").alias("offset"), F.col("gap_size").alias("size")))).alias("unidentified"))
    every = known.join(grouped, "blob_id", "left").join(summary(known, placed), "blob_id").join(assessments(known, placed), "blob_id").join(regions, "blob_id", "left")
    listed = F.coalesce("findings", F.array().cast(grouped.schema["findings"].dataType)).alias("findings")
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "path", F.col("length").alias("size"), "summary", "assessment", listed, "unidentified")
    return every.select("blob_id", F.to_json(doc).alias("json"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """AGG-13: all diagnostics with their finding's place and type, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = findings.select("blob_id", "offset_", "type_", F.explode("diagnostics").alias("d")).select("blob_id", "offset_", "type_", "d.severity", "d.code", "d.message")
    return rows.withColumn("rank", rank)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("blob_id", pa.int64()), ("offset_", pa.int64()), ("size_", pa.int64()), ("type_", pa.string()), ("nth", pa.int32()), ("content", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            data, rows, seen = row["content"] or b"", [], {}
            for r in sorted(row["ranges"] or [], key=lambda r: (r["offset"], r["size"], r["type"])):
                if r["offset"] >= len(data):
                    continue
                key = (r["offset"], r["type"])
                seen[key] = seen.get(key, 0) + 1
                cut = data[r["offset"] : r["offset"] + r["size"]]
                rows.append({"blob_id": row["blob_id"], "offset_": r["offset"], "size_": len(cut), "type_": r["type"], "nth": seen[key], "content": cut})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def carve(blobs: DataFrame, findings: DataFrame, least: int = 1024) -> DataFrame:
    """SNK-6: every sized finding's bytes, and those of the unidentified ranges of at least ``least`` bytes: blob_id, offset_, size_, type_, content, name.

    A name that is there already gets a number (SET-3).
    """
    known = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length"))
    unknown = gaps(known, findings, least).select("blob_id", F.col("gap_offset").alias("offset"), F.col("gap_size").alias("size"), F.lit("unknown").alias("type"))
    every = findings.where("size_ > 0").select("blob_id", F.col("offset_").alias("offset"), F.col("size_").alias("size"), F.col("type_").alias("type")).unionByName(unknown)
    ranges = every.groupBy("blob_id").agg(F.collect_list(F.struct("offset", "size", "type")).alias("ranges"))
    rows = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content").join(ranges, "blob_id", "left")
    cut = rows.mapInArrow(_cut, "blob_id long, offset_ long, size_ long, type_ string, nth int, content binary")
    plain = blob_name(F.col("offset_"), F.col("type_"))
    numbered = F.concat(F.regexp_replace(plain, r"\.bin$", ""), F.lit("-"), F.col("nth").cast("string"), F.lit(".bin"))
    return cut.select("blob_id", "offset_", "size_", "type_", "content", F.when(F.col("nth") > 1, numbered).otherwise(plain).alias("name"))
