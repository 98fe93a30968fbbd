"""Joins of volumes: overlaps of labels, faces of blocks, stitching and distances."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import AXES, lower_pairs
from gridloom.operators.components import connected_components


def block_overlaps(vox: DataFrame, a: str, b: str, ignore_label: int | None = None) -> DataFrame:
    """``(block_id, a, b, count)`` of two labels of one voxel table."""
    if ignore_label is not None:
        vox = vox.where(F.col(b) != ignore_label)
    return vox.groupBy("block_id", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("count"))


def overlaps(vox: DataFrame, a: str, b: str, ignore_label: int | None = None) -> DataFrame:
    """``(a, b, count)`` over all blocks."""
    if ignore_label is not None:
        vox = vox.where(F.col(b) != ignore_label)
    return vox.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("count"))


def max_overlap(found: DataFrame, maximum: int | None = None) -> DataFrame:
    """``(a, b)``: each label's most frequent partner, the smaller of equals; with a maximum dense from 0, missing is 0."""
    best = found.groupBy("a").agg(F.max_by("b", F.struct(F.col("count"), -F.col("b"))).alias("b"))
    if maximum is None:
        return best
    return found.sparkSession.range(maximum + 1).withColumnRenamed("id", "a").join(best, "a", "left").fillna(0)


def label_lists(found: DataFrame) -> DataFrame:
    """``(a, labels)``: each label's partners with their counts as a map."""
    return found.groupBy("a").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "count")))).alias("labels"))


def thresholded_labels(found: DataFrame, threshold: float, ignore_label: int = 0) -> DataFrame:
    """The best partner but the ignore label if its share of the label is over the threshold, else the ignore label."""
    w = Window.partitionBy("a")
    share = found.withColumn("share", F.col("count") / F.sum("count").over(w))
    best = share.groupBy("a").agg(F.max_by("b", F.when(F.col("b") != ignore_label, F.struct(F.col("share"), -F.col("b")))).alias("b"), F.max(F.when(F.col("b") != ignore_label, F.col("share"))).alias("share"))
    return best.select("a", F.when(F.col("share") > threshold, F.col("b")).otherwise(ignore_label).alias("b"))


def face_pairs(vox: DataFrame, label: str) -> DataFrame:
    """Distinct pairs of labels, neither 0, that touch over a block's lower face."""
    pairs = lower_pairs(vox, [label, "block_id"]).where(f"block_id_a <> block_id_b AND {label}_a <> 0 AND {label}_b <> 0")
    return pairs.select(F.col(f"{label}_a").alias("a"), F.col(f"{label}_b").alias("b")).distinct()


def stitch_edges(vox: DataFrame, label: str, edges: DataFrame) -> DataFrame:
    """Edges with ``stitch``: whether a pair of their voxels lies in different blocks."""
    pairs = lower_pairs(vox, [label, "block_id"]).where(f"{label}_a <> {label}_b")
    crossing = pairs.groupBy(F.least(f"{label}_a", f"{label}_b").alias("u"), F.greatest(f"{label}_a", f"{label}_b").alias("v")).agg(F.bool_or(F.col("block_id_a") != F.col("block_id_b")).alias("stitch"))
    return edges.join(crossing, ["u", "v"], "left").fillna(False, ["stitch"])


def stitch_assignments(spark, edges: DataFrame, size_threshold: int = 0, serialize_edges: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Stitch edges larger than the threshold: the edges, or the components numbered from 1 of all ``nodes(node)``.

    Without ``nodes`` these are the ends of all edges; a node on no edge to be merged is a component of its own.
    """
    merge = edges.where(F.col("stitch") & (F.col("size") > size_threshold))
    if serialize_edges:
        return merge
    if nodes is None:
        nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    found = connected_components(spark, merge.select("u", "v"))
    every = nodes.select("node").distinct().join(found, "node", "left")
    return numbered(every.select("node", F.coalesce("component", "node").alias("component")), "component")


def numbered(table: DataFrame, label: str) -> DataFrame:
    """``(node, label)`` with consecutive labels from 1, in the order of ``label``."""
    from gridloom.operators.relabel import find_labeling

    table = table.select("node", F.col(label).alias("label"))
    return table.join(find_labeling(table, start=1), "label").select("node", F.col("new_label").alias("label"))


def stitch_faces(found: DataFrame, threshold: float, ignore_label: int | None = None) -> DataFrame:
    """Pairs that are each other's best partner, with a mean share over the threshold, in ``(a, b, count)`` of two blocks."""
    if ignore_label is not None:
        found = found.where((F.col("a") != ignore_label) & (F.col("b") != ignore_label))
    sums = found.withColumns({"fa": F.col("count") / F.sum("count").over(Window.partitionBy("a")), "fb": F.col("count") / F.sum("count").over(Window.partitionBy("b"))})
    ranked = sums.withColumns({"ra": F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), "b")), "rb": F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))})
    return ranked.where((F.col("ra") == 1) & (F.col("rb") == 1) & ((F.col("fa") + F.col("fb")) / 2 > threshold)).select("a", "b")


def object_distances(vox: DataFrame, label: str, max_distance: float, resolution=(1.0, 1.0, 1.0), max_size: int | None = None) -> DataFrame:
    """``(a, b, distance)`` of objects (not 0) less than ``max_distance`` apart, between their nearest voxels.

    Only voxels with a neighbour outside their object are compared, by an equi join of cells of that distance.
    """
    objects = vox.where(F.col(label) != 0).select(*AXES, F.col(label).alias("id"))
    if max_size is not None:
        large = objects.groupBy("id").count().where(F.col("count") > max_size).select("id")
        objects = objects.join(large, "id", "left_anti")
    pairs = lower_pairs(vox.select(*AXES, F.col(label).alias("id")), ["id"]).where("id_a <> id_b")
    axis = [F.when(F.col("axis") == k, 1).otherwise(0) for k in range(3)]
    edge = pairs.select(*AXES).unionByName(pairs.select(*[(F.col(c) + axis[k]).cast("long").alias(c) for k, c in enumerate(AXES)])).distinct()
    surface = objects.join(edge, list(AXES), "left_semi")
    steps = [max(1, ceil(max_distance / r)) for r in resolution]
    cell = [F.floor(F.col(c) / s).cast("long") for c, s in zip(AXES, steps)]
    here = surface.select("id", *AXES, *[k.alias(f"k{c}") for k, c in zip(cell, AXES)])
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    there = here
    for c in AXES:
        there = there.withColumn("_d", F.explode(near)).withColumn(f"k{c}", F.col(f"k{c}") + F.col("_d")).drop("_d")
    there = there.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in AXES], *[f"k{c}" for c in AXES])
    square = sum((((F.col(c) - F.col(f"{c}2")) * float(r)) ** 2 for c, r in zip(AXES, resolution)), F.lit(0.0))
    met = here.withColumnRenamed("id", "a").join(there, [f"k{c}" for c in AXES]).where("a < b").select("a", "b", F.sqrt(square).alias("distance"))
    return met.where(F.col("distance") < max_distance).groupBy("a", "b").agg(F.min("distance").alias("distance"))
