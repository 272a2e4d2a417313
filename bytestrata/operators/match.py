"""Pattern matching over blobs as relations: (blob_id, pattern, start)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchored(blobs: DataFrame, pattern: bytes, at: int = 0) -> Column:
    """MAT-4: whether a blob has the pattern at one place: a comparison of bytes, no scan."""
    return F.substring("content", at + 1, len(pattern)) == F.unhex(F.lit(pattern.hex()))


def _hits(batches: Iterator[pa.RecordBatch], patterns: list[bytes]) -> Iterator[pa.RecordBatch]:
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p.decode("latin-1"), p)
    automaton.make_automaton()
    for batch in batches:
        ids, found, starts = [], [], []
        for blob, content in zip(batch.column("blob_id").to_pylist(), batch.column("content"), strict=True):
            for last, p in automaton.iter((content.as_py() or b"").decode("latin-1")):
                ids.append(blob)
                found.append(p)
                starts.append(last + 1 - len(p))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(starts, pa.int64())], ["blob_id", "pattern", "start"])


def hits(blobs: DataFrame, patterns: list[bytes]) -> DataFrame:
    """MAT-2: all overlapping matches of all patterns, one pass over each blob."""
    return blobs.select(F.col("blob_id").cast("long").alias("blob_id"), "content").mapInArrow(partial(_hits, patterns=patterns), "blob_id long, pattern binary, start long")
