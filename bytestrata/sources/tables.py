"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which a table of few files is dealt over the cores.
SMALL = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; a small one in fewer files than there are cores is dealt over them, as one row group is one task."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if 1 << 20 < size < SMALL * cores and len(rows.inputFiles()) < cores else rows
