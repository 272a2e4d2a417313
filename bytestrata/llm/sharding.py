"""Sharding: contiguous shards of near equal bytes from global prefix sums.

Rows are put in the order of (doc_id, CRC, size) by range partitioning and sorting inside partitions; only the id, the
size and the CRC of a text travel, never the text. Each partition's total bytes and rows are summed, the few totals are
prefixed on the driver (one entry per partition, not per row), and a second pass over the same, written-out partitions
adds each row's running sum to its partition's start. The shard is the equal target that the row's first byte falls in,
so each cut is at most one row off its target.

The ordered rows are written to the shared checkpoint folder before totals are taken: range bounds come from a sample,
so a recomputed partition could otherwise have other rows than those its total was taken from.

Defined results: a null text has no bytes and size 1; null ids come last; rows that repeat are placed side by side; an
empty table gives no rows; further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage

LAW = "bytes"
SHARDS = 16


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id, size, text_crc32: written out, sorted, with the number of the partition that holds the row."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"))
    keys = [F.col("doc_id").asc_nulls_last(), "text_crc32", "size"]
    placed = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut_lineage(placed.select(F.spark_partition_id().alias("part"), "*"))


def _running(batches: Iterator[pa.RecordBatch], starts: dict[int, tuple[int, int]], target: float, shards: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its rows' shards and numbers in the global order."""
    seen: dict[int, tuple[int, int]] = {}
    for batch in batches:
        part = batch.column("part").to_numpy()
        size = batch.column("size").to_numpy()
        first, number = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            byte, row = seen.get(int(part[a])) or starts[int(part[a])]
            ends = byte + np.cumsum(size[a:b])
            first[a:b], number[a:b] = ends - size[a:b], row + np.arange(b - a)
            seen[int(part[a])] = (int(ends[-1]), row + b - a)
        yield batch, np.minimum(np.floor(first / target), shards - 1).astype(np.int32), number


def _heads(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    """The first row's number of each shard, as far as this partition shows."""
    for _, shard, number in _running(batches, **how):
        found, at = np.unique(shard, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(number[at], pa.int64())], ["shard", "number"])


def _placed(batches: Iterator[pa.RecordBatch], heads: dict[int, int], **how) -> Iterator[pa.RecordBatch]:
    base = np.zeros(max(heads) + 1, np.int64)
    for shard, number in heads.items():
        base[shard] = number
    for batch, shard, number in _running(batches, **how):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard, pa.int32()), pa.array(number - base[shard], pa.int64())], ["doc_id", "size", "text_crc32", "shard", "slot"])


def annotate(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    rows = ordered(docs, id_col, text_col)
    totals = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())  # one per partition
    starts, byte, row = {}, 0, 0
    for part, size, n in totals:
        starts[part] = (byte, row)
        byte, row = byte + size, row + n
    how = {"starts": starts, "target": max(byte, 1) / shards, "shards": shards}
    found = rows.mapInArrow(partial(_heads, **how), "shard int, number long").groupBy("shard").agg(F.min("number").alias("number")).collect()  # one per shard
    heads = {r["shard"]: r["number"] for r in found} or {0: 0}
    placed = rows.mapInArrow(partial(_placed, heads=heads, **how), "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
