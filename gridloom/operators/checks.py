"""Consistency checks: queries with a row for each violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_components(vox: DataFrame, label: str, most_blocks: int) -> DataFrame:
    """Labels in more blocks than one may span."""
    found = vox.groupBy(F.col(label).alias("label")).agg(F.count_distinct("block_id").alias("n_blocks"))
    return found.where(F.col("n_blocks") > most_blocks)


def check_sub_graphs(vox: DataFrame, label: str, nodes: DataFrame) -> DataFrame:
    """Blocks whose stored nodes ``(block_id, node)`` aren't the labels of their voxels."""
    there = vox.select("block_id", F.col(label).alias("node")).distinct()
    stored = nodes.select("block_id", "node").distinct()
    return there.exceptAll(stored).unionByName(stored.exceptAll(there)).select("block_id").distinct()
