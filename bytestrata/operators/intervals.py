"""Interval operators over candidates and findings: (blob_id, offset_, size_, type_, category, confidence, endian).

Most are window functions over (blob_id, offset_): one shuffle by blob and linear work, also where the definition is a
containment join. Ordered folds are a pass over sorted partitions that holds a few rows, so a blob of any number of rows
streams through one task.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings of at least this confidence, with a size, own their range.
OWNER = 60
#: Regions no further apart than this are one.
GAP = 512 * 1024
CONTAINERS = ("filesystem", "container")
ENCLOSING = ("filesystem", "container", "archive")


def total_order() -> list[Column]:
    """Offset up, confidence down, size up, type up, little endian first."""
    return [F.col("offset_").asc(), F.col("confidence").desc(), F.col("size_").asc(), F.col("type_").asc(), (F.col("endian") == "big").asc()]


def ranked(rows: DataFrame) -> DataFrame:
    """INT-1: rows with their place in their blob's total order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("blob_id").orderBy(*total_order())))


def same_offset_winners(rows: DataFrame) -> DataFrame:
    """INT-2: the first row of each offset, with the number of rows that it stands for."""
    at = Window.partitionBy("blob_id", "offset_")
    return rows.withColumn("place", F.row_number().over(at.orderBy(*total_order()[1:]))).withColumn("also", F.count(F.lit(1)).over(at) - 1).where("place = 1").drop("place")


def owned(rows: DataFrame, rescue: Column | None = None) -> DataFrame:
    """INT-3, INT-4, JOI-7: greedy ownership in the total order, one row per kept finding.

    A row at the last kept row's offset, or inside the owner's range, is the loser: it joins the last kept row's, or the
    owner's, also_matched. A kept row of enough confidence with a size becomes the owner, whose end replaces the former
    one. A row for which ``rescue`` holds starts a partition and is never inside.

    One shuffle by blob and a sort; then one pass that holds two kept rows, however many a blob has.
    """
    rescue = F.lit(False) if rescue is None else rescue
    own = rows.select(F.col("blob_id").cast("long").alias("blob_id"), F.col("offset_").cast("long").alias("offset_"), F.col("size_").cast("long").alias("size_"), "type_", "category", F.col("confidence").cast("int").alias("confidence"), "endian", rescue.alias("rescue"))
    in_order = own.repartition("blob_id").sortWithinPartitions("blob_id", *total_order(), "category")
    return in_order.mapInArrow(_own, "blob_id long, offset_ long, size_ long, type_ string, category string, confidence int, endian string, also int")


_KEPT = pa.schema([("blob_id", pa.int64()), ("offset_", pa.int64()), ("size_", pa.int64()), ("type_", pa.string()), ("category", pa.string()), ("confidence", pa.int32()), ("endian", pa.string()), ("also", pa.int32())])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted rows. What is kept goes out with its batch, but for the last kept row and the owner, which may still win."""
    blob, last, end, open_ = None, -1, -1, []
    owner = newest = None  # kept rows, as lists whose last item is the number of losers
    for batch in batches:
        done = open_
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            offset, size = row[1], row[2]
            if row[0] != blob:
                blob, last, end, owner, newest = row[0], -1, -1, None, None
            if newest is not None and offset == last:
                newest[7] += 1
            elif offset < end and not row[7]:
                owner[7] += 1
            else:
                newest, last = [*row[:7], 0], offset
                done.append(newest)
                if row[5] >= OWNER and size > 0:
                    owner, end = newest, offset + size
        open_ = [x for x in (owner, newest if newest is not owner else None) if x is not None]
        yield _kept([x for x in done if x is not owner and x is not newest])
    yield _kept(open_)


def _kept(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KEPT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT, strict=True)], schema=_KEPT)


def sized(rows: DataFrame, length: Column) -> DataFrame:
    """INT-5: an unknown size reaches to the next kept offset, or the blob's end."""
    following = F.lead("offset_").over(Window.partitionBy("blob_id").orderBy(*total_order()))
    return rows.withColumn("size_", F.when(F.col("size_") == 0, F.coalesce(following, length) - F.col("offset_")).otherwise(F.col("size_")))


def islands(rows: DataFrame, gap: int) -> DataFrame:
    """INT-6, INT-7: regions of rows that begin no more than ``gap`` behind the end of those before."""
    w = Window.partitionBy("blob_id").orderBy("offset_", "size_", "type_", "confidence")
    end = F.col("offset_") + F.col("size_")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.when(reach.isNull() | (F.col("offset_") > reach + gap), 1).otherwise(0)).withColumn("__end", end)
    numbered = new.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("blob_id", "__isle").agg(F.min("offset_").alias("offset_"), (F.max("__end") - F.min("offset_")).alias("size_"), F.count(F.lit(1)).alias("merged")).drop("__isle")


def gaps(blobs: DataFrame, rows: DataFrame, least: int, bridge: int = GAP) -> DataFrame:
    """INT-8, SET-2: the ranges of blobs that no sized row and no region of containers covers, of at least ``least`` bytes.

    blobs: blob_id and length. A blob without rows is one range. Regions bridge what lies between containers no further
    apart than ``bridge``. A blob's end is a span of its own, so all gaps lie before some span.
    """
    sized_ = rows.where("size_ > 0")
    spans = sized_.select("blob_id", "offset_", "size_").unionByName(islands(sized_.where(F.col("category").isin(*CONTAINERS)), bridge).select("blob_id", "offset_", "size_"))
    ends = blobs.where("length is not null").select("blob_id", F.col("length").alias("offset_"), F.lit(0).cast("long").alias("size_"))
    w = Window.partitionBy("blob_id").orderBy("offset_", "size_")
    reach = F.coalesce(F.max(F.col("offset_") + F.col("size_")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = spans.unionByName(ends).select("blob_id", reach.cast("long").alias("gap_offset"), (F.col("offset_") - reach).cast("long").alias("gap_size"))
    return before.where(F.col("gap_size") >= F.greatest(F.lit(least), F.lit(1)))


def suppressed(rows: DataFrame) -> DataFrame:
    """JOI-2: rows without those that lie, as a proper part, inside a sized container.

    Whatever encloses a row begins before it and ends no earlier, or begins with it and ends later: two running maxima.
    """
    end = F.when(F.col("category").isin(*ENCLOSING) & (F.col("size_") > 0), F.col("offset_") + F.col("size_"))
    own = F.col("offset_") + F.greatest(F.col("size_"), F.lit(1))
    earlier = F.max(end).over(Window.partitionBy("blob_id").orderBy("offset_").rangeBetween(Window.unboundedPreceding, -1))
    beside = F.max(end).over(Window.partitionBy("blob_id", "offset_"))
    inside = (F.coalesce(earlier, F.lit(-1)) >= own) | (F.coalesce(beside, F.lit(-1)) > own)
    return rows.withColumn("__in", inside).where("not __in").drop("__in")


def parents(rows: DataFrame) -> DataFrame:
    """JOI-3: each row with the smallest strictly larger container around it; ties go to the first in the total order.

    Rows must have ``place``. A sweep: in the order of offsets, the containers that still reach on are kept by size.
    """
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    in_order = rows.repartition("blob_id").sortWithinPartitions("blob_id", "offset_", F.col("size_").desc(), "place")
    return in_order.mapInArrow(_nest, ", ".join([*columns, "parent_place int", "parent_type string"]))


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blob, boxes = None, []  # (size, place, end, type), the smallest first
    for batch in batches:
        places, types = [], []
        for b, offset, size, place, category, type_ in zip(*(batch.column(c).to_pylist() for c in ("blob_id", "offset_", "size_", "place", "category", "type_")), strict=True):
            if b != blob:
                blob, boxes = b, []
            # containers that end before here enclose nothing that follows
            boxes = [x for x in boxes if x[2] >= offset]
            end = offset + size
            found = next((x for x in boxes[bisect_right(boxes, size, key=lambda x: x[0]) :] if x[2] >= end), None)
            places.append(found[1] if found else None)
            types.append(found[3] if found else None)
            if category in CONTAINERS and size > 0:
                insort(boxes, (size, place, end, type_))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int32()), pa.array(types, pa.string())], [*batch.schema.names, "parent_place", "parent_type"])


def first_extents(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """JOI-4: blob_id, place and extent: for each row that lies in one, the extent of the least place that holds its offset.

    extents: blob_id, start, end_ and place. A sweep over both in the order of offsets, which keeps the extents that are open.
    """
    begin = extents.select("blob_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("end_").cast("long").alias("end_"), F.col("place").cast("int").alias("place"))
    ask = rows.select("blob_id", F.col("offset_").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("end_"), F.col("place").cast("int").alias("place"))
    in_order = begin.unionByName(ask).repartition("blob_id").sortWithinPartitions("blob_id", "at", "kind", "place")
    return in_order.mapInArrow(_hold, "blob_id long, place int, extent int")


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blob, open_ = None, []  # (place, end) of extents, a heap: those that have ended go when they come up
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for b, at, kind, end, place in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if b != blob:
                blob, open_ = b, []
            if kind == 0:
                heappush(open_, (place, end))
                continue
            while open_ and open_[0][1] <= at:
                heappop(open_)
            if open_:
                out.append((b, place, open_[0][0]))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["blob_id", "place", "extent"])


def keep_expanded(type_: Column, category: Column) -> Column:
    """FIL-10: what never folds into a summary: private keys, and what holds or runs other things."""
    return (type_ == "private_key") | category.isin("container", "filesystem", "bootloader", "executable")


def swarms(rows: DataFrame, more_than: int = 4) -> DataFrame:
    """INT-10: groups of more than so many rows of one type under one parent, but for those that stay expanded."""
    folded = rows.where(~keep_expanded(F.col("type_"), F.col("category")))
    return folded.groupBy("blob_id", "parent_place", "type_").agg(F.count(F.lit(1)).alias("n"), F.sum("size_").alias("bytes")).where(F.col("n") > more_than)
