"""Distinct labels, consecutive labels, and inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniques(vox: DataFrame, label: str, counts: bool = False) -> DataFrame:
    """Distinct labels, with their counts if asked for."""
    own = vox.select(F.col(label).alias("label"))
    return own.groupBy("label").agg(F.count("*").alias("count")) if counts else own.distinct()


def find_labeling(vox: DataFrame, label: str = "label", start: int | None = None) -> DataFrame:
    """``(label, new_label)``: labels in order, from 0 if 0 is one of them, else from 1 (or from ``start``).

    Labels are range partitioned and sorted; a partition's numbers begin where the ones before it end, which takes a
    table of one row a partition and no sort of all labels in one task.
    """
    spark = vox.sparkSession
    labels = vox.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = labels.repartitionByRange(parts, "label").withColumn("_p", F.spark_partition_id())
    from gridloom.plans.scratch import Scratch

    placed = Scratch(spark, "labels").save(placed, "placed")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("label").alias("low"))
    begins = F.broadcast(sizes.selectExpr("_p", "coalesce(sum(n) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin", "min(low) OVER () AS low"))
    first = F.when(F.col("low") == 0, 0).otherwise(1) if start is None else F.lit(start)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("_p").orderBy("label"))
    return placed.join(begins, "_p").select("label", (F.col("begin") + rank - 1 + first).cast("long").alias("new_label"))


def merge_uniques(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("label")
    for p in parts[1:]:
        out = out.unionByName(p.select("label"))
    return out.distinct()


def block_labels(vox: DataFrame, label: str) -> DataFrame:
    """``(block_id, labels)``: the distinct labels of each block, sorted."""
    return vox.groupBy("block_id").agg(F.array_sort(F.collect_set(label)).alias("labels"))


def label_blocks(vox: DataFrame, label: str) -> DataFrame:
    """``(label, blocks)``: the blocks in which each label occurs, sorted."""
    return vox.groupBy(F.col(label).alias("label")).agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))


def label_block_ranges(vox: DataFrame, label: str, span: int = 4096) -> DataFrame:
    """``(label, part, blocks)``: the same, one row for each range of ``span`` block ids in which the label occurs.

    A label that is in most blocks, as background is, has rows of at most ``span`` ids, made in as many tasks.
    """
    return vox.groupBy(F.col(label).alias("label"), F.floor(F.col("block_id") / span).alias("part")).agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))


def fragment_segment_assignment(assignments: DataFrame, offset: int = 0) -> DataFrame:
    """``(node, segment)`` for fragments whose segment has more than one fragment; segments get ids after ``offset``."""
    many = assignments.where("label <> 0").groupBy("label").count().where("count > 1").select("label")
    return assignments.join(many, "label", "left_semi").select("node", (F.col("label") + offset).alias("segment"))
