"""Aggregations over findings, files and their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: FIL-9: the categories that a directory scan reports by path.
NOTABLE = ("filesystem", "container", "executable", "bootloader", "dtb", "crypto", "encrypted")
#: AGG-3: longer ranges are sampled by this many chunks of this many bytes.
SAMPLE_ABOVE, SAMPLE_CHUNKS, SAMPLE_BYTES = 1 << 20, 16, 1 << 16


def entropy(data: bytes | memoryview | np.ndarray) -> float:
    """AGG-1: Shannon entropy in bits a byte; 0 for no bytes."""
    raw = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    if not len(raw):
        return 0.0
    p = np.bincount(raw, minlength=256) / len(raw)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def max_fraction(data: bytes | memoryview) -> float:
    """AGG-2: the share of the commonest byte; 1 for no bytes."""
    raw = np.frombuffer(data, np.uint8)
    return float(np.bincount(raw).max() / len(raw)) if len(raw) else 1.0


def region_entropy(data: bytes | memoryview) -> float:
    """AGG-3: entropy of a range, sampled if it is long: chunks at equal strides."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= SAMPLE_ABOVE:
        return entropy(raw)
    stride = len(raw) // SAMPLE_CHUNKS
    return entropy(np.concatenate([raw[k * stride : k * stride + SAMPLE_BYTES] for k in range(SAMPLE_CHUNKS)]))


def _byte_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [x.as_py() or b"" for x in batch.column("content")]
        stats = [[f(v) for v in values] for f in (entropy, max_fraction, region_entropy)]
        yield pa.RecordBatch.from_arrays([batch.column("blob_id"), *[pa.array(s, pa.float64()) for s in stats]], ["blob_id", "entropy", "max_fraction", "sampled_entropy"])


def byte_stats(blobs: DataFrame) -> DataFrame:
    """AGG-1 to AGG-4 of each blob's content: one pass, no shuffle, a histogram per blob."""
    return blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content").mapInArrow(_byte_stats, "blob_id long, entropy double, max_fraction double, sampled_entropy double")


def primary_types(blobs: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG-6: each blob's best type, among those at offset 0 if there are any; the first of equal ones.

    blobs: blob_id and length. A blob without rows is unknown, one without a length couldn't be read.
    """
    best = F.min(F.struct((F.col("offset_") != 0).alias("late"), (-F.col("confidence")).alias("down"), "place", "type_"))
    found = rows.groupBy("blob_id").agg(best.alias("b")).select("blob_id", F.col("b.type_").alias("type_"))
    none = F.when(F.col("length").isNull(), "unreadable").otherwise("unknown")
    return blobs.select("blob_id", "length").join(found, "blob_id", "left").select("blob_id", F.coalesce("type_", none).alias("primary_type"))


def by_type(primary: DataFrame) -> DataFrame:
    """AGG-7: blobs per primary type, with their place in the order of falling numbers, then names."""
    counts = primary.groupBy("primary_type").agg(F.count(F.lit(1)).alias("files"))  # a row a type
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("files"), "primary_type")))


def _children(rows: DataFrame, category: str | None = None) -> Column:
    """How many findings, of one category or any, lie in the members of a row's finding."""
    if "members" not in rows.columns:
        return F.lit(0)
    inside = F.flatten(F.transform("members", lambda m: m["children"]))
    return F.coalesce(F.size(F.filter(inside, lambda c: c["category"] == category) if category else inside), F.lit(0))


def totals(blobs: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG-8: one row of counts over all blobs, also those without findings; findings inside members count as findings."""
    zero = F.lit(0).cast("long")
    of_blobs = blobs.select(F.lit(1).cast("long").alias("file_count"), F.coalesce("length", zero).alias("bytes"), zero.alias("finding_count"), zero.alias("crypto_count"))
    of_rows = rows.select(zero.alias("file_count"), zero.alias("bytes"), (_children(rows) + 1).cast("long").alias("finding_count"), (F.col("category") == "crypto").cast("long").alias("crypto_count"))
    return of_blobs.unionByName(of_rows).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("file_count", "bytes", "finding_count", "crypto_count")])


def summary(blobs: DataFrame, rows: DataFrame, sep: str = ", ", none: str = "no known signatures identified") -> DataFrame:
    """AGG-10: a blob's distinct types in the order of their first finding, with their number if it is above one."""
    per = rows.groupBy("blob_id", "type_").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") > 1, F.concat("type_", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("type_"))
    listed = per.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("first", label.alias("label")))).alias("all"))
    return blobs.select("blob_id").join(listed, "blob_id", "left").select("blob_id", F.coalesce(F.array_join(F.transform("all", lambda x: x["label"]), sep), F.lit(none)).alias("summary"))


def tree_assessment(primary: DataFrame, rows: DataFrame, top: int = 5) -> DataFrame:
    """AGG-12: one line about all blobs: their number, the commonest primary types, and the number of keys."""
    counts = primary.groupBy("primary_type").agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("keys"))
    keys = rows.where("category = 'crypto'").agg(F.lit(None).cast("string").alias("primary_type"), F.lit(0).cast("long").alias("files"), F.count(F.lit(1)).alias("keys"))
    known = F.col("primary_type").isNotNull() & ~F.col("primary_type").isin("unknown", "unreadable")
    one = counts.unionByName(keys).agg(F.sum("files").alias("n"), F.sum("keys").alias("keys"), F.array_sort(F.collect_list(F.when(known, F.struct((-F.col("files")).alias("k"), "primary_type", "files")))).alias("all"))
    listed = F.array_join(F.transform(F.slice("all", 1, top), lambda x: F.concat(x["files"].cast("string"), F.lit(" "), x["primary_type"])), ", ")
    line = F.concat(F.col("n").cast("string"), F.lit(" files"), F.when(F.size("all") > 0, F.concat(F.lit(": "), listed)).otherwise(F.lit("")), _keys(F.col("keys")))
    return one.select(line.alias("assessment"))


def _keys(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("; "), n.cast("string"), F.lit(" key/cert"))).otherwise(F.lit(""))


def newest(rows: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """WIN-4: the value of each key's highest version; the higher value wins a tie."""
    return rows.groupBy(key).agg(F.max(F.struct(version, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{version}").alias(version))


def truncated(members: DataFrame, owner: str, order: list[Column], most: int) -> DataFrame:
    """LIM-1: the first members of each owner, marked when there were more."""
    w = Window.partitionBy(owner)
    numbered = members.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("members_truncated", F.count(F.lit(1)).over(w) > most)
    return numbered.where(F.col("__k") <= most).drop("__k")


def _range_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            data = memoryview(row["content"] or b"")
            rows += [{"blob_id": row["blob_id"], "offset_": r["offset_"], "size_": r["size_"], "entropy": region_entropy(data[r["offset_"] : r["offset_"] + r["size_"]])} for r in row["ranges"] if r["size_"] > 0]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("blob_id", pa.int64()), ("offset_", pa.int64()), ("size_", pa.int64()), ("entropy", pa.float64())]))


def range_entropy(blobs: DataFrame, ranges: DataFrame) -> DataFrame:
    """AGG-5: entropy of each sized range (blob_id, offset_, size_) of the blobs: one shuffle by blob, a pass over each."""
    per = ranges.select(F.col("blob_id").cast("long").alias("blob_id"), F.struct("offset_", "size_").alias("r")).groupBy("blob_id").agg(F.collect_set("r").alias("ranges"))
    rows = blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content").join(per, "blob_id")
    return rows.mapInArrow(_range_entropy, "blob_id long, offset_ long, size_ long, entropy double")


#: AGG-11: from this entropy on a range counts as compressed or encrypted.
DENSE = 7.2
#: Unidentified ranges of at least so many bytes are named for their entropy.
DENSE_BYTES = 4096


def assessments(blobs: DataFrame, rows: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """AGG-11: a line about each blob: its types in order, what entropy says of the rest, and how many keys it holds.

    blobs: blob_id and length, and with regions the whole blob's entropy. regions: the unidentified ranges, (blob_id, size_,
    entropy), where entropies are asked for.
    """
    types = rows.groupBy("blob_id", "type_").agg(F.min("place").alias("first"), F.sum("size_").alias("bytes"), F.sum((F.col("category") == "crypto").cast("int") + _children(rows, "crypto")).cast("int").alias("keys"))
    per = types.groupBy("blob_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "type_"))), lambda x: x["type_"]), " + ").alias("types"), F.sum("bytes").alias("covered"), F.sum("keys").cast("int").alias("keys"))
    joined = blobs.join(per, "blob_id", "left")
    if regions is None:
        line = F.coalesce("types", F.lit("no known structures identified"))
    else:
        dense = regions.where((F.col("size_") >= DENSE_BYTES) & (F.col("entropy") >= DENSE)).select("blob_id").distinct().withColumn("dense", F.lit(True))
        joined = joined.join(dense, "blob_id", "left")
        likely = F.when(F.col("entropy") >= DENSE, F.lit(" - likely encrypted or compressed")).otherwise(F.lit(""))
        nothing = F.concat(F.lit("no known structures; whole-file entropy "), F.format_string("%.1f", F.when(F.col("entropy") * 4 % 1 == 0, F.bround("entropy", 1)).otherwise(F.col("entropy"))), likely)  # exact halves go to the even digit
        rest = F.when(F.col("dense") & (F.col("covered") < F.col("length")), F.lit("; high-entropy unidentified region(s) - possible encryption")).otherwise(F.lit(""))
        line = F.coalesce(F.concat("types", rest), nothing)
    return joined.select("blob_id", F.concat(line, _keys(F.coalesce("keys", F.lit(0)))).alias("assessment"))
