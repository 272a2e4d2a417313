"""Identification of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import identify as ident

#: The schema of Spark's binary file source, which a stream must be told.
FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of blobs: each new file once, so many a batch at most."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("blob_id"), "path", "modificationTime", "content")


def identified(blobs: DataFrame, documents: list[str]) -> DataFrame:
    """The findings of a stream of blobs: stateless, as a blob's findings depend on that blob alone."""
    return ident.identify(blobs, documents)


def write(findings: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append findings to a folder of Parquet files, exactly once a file."""
    out = findings.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(table)
