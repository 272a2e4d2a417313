"""Connected components of an edge list by alternating small-star and large-star rounds.

Nothing is gathered on the driver but whether a round is the last. Minima are partial aggregations, so a node with very many
neighbours is no bottleneck there, and what joins them back are plain equi-joins, whose skewed partitions Spark splits.
Each round's edges are written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("ends")).where("up > 1 or (up = 1 and ends > 1)").limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for each node of edges u > v that isn't its component's root."""
    now = cut_lineage(edges.select("u", "v").distinct())
    while not _is_stars(now):
        # small star: a node's smaller neighbours and itself hang on the least of them
        joined = now.join(_least(now), F.col("u") == F.col("n"))
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        small = cut_lineage(small)
        # large star: a node's larger neighbours hang on the least of its neighbours and itself
        large = small.join(_least(small), F.col("v") == F.col("n"), "left").select("u", F.coalesce("least", "v").alias("v")).distinct()
        now = cut_lineage(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
