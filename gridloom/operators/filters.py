"""Filters, semi joins and anti joins on labels, blocks and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import compare
from gridloom.operators.voxelwise import with_ends


def clear_lifted_edges(lifted: DataFrame, labels: DataFrame) -> DataFrame:
    """Lifted edges of which both ends have the same label."""
    return with_ends(lifted, labels).where("lu = lv").drop("lu", "lv")


def blocks_from_mask(vox: DataFrame, mask: str) -> DataFrame:
    """Ids of blocks with a voxel in the mask."""
    return vox.groupBy("block_id").agg(F.bool_or(mask).alias("any")).where("any").select("block_id")


def id_filter(nodes: DataFrame, labels: list[int]) -> DataFrame:
    """Nodes that have one of the labels."""
    return nodes.where(F.col("label").isin(list(labels))).select("node")


def filter_blocks(vox: DataFrame, label: str, discard: DataFrame) -> DataFrame:
    """Labels in ``discard(id)`` become 0."""
    gone = discard.select(F.col("id").alias(label), F.lit(True).alias("_gone")).distinct()
    return vox.join(gone, label, "left").withColumn(label, F.when(F.col("_gone"), 0).otherwise(F.col(label))).drop("_gone")


def apply_threshold(features: DataFrame, feature: str, level: float, mode: str = "less") -> DataFrame:
    """Ids whose feature compares with the level."""
    return features.where(compare(F.col(feature), level, mode)).select("id")
