"""Region graphs: construction, components, contraction, lifted neighbourhoods and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.model import lower_pairs
from gridloom.operators.aggregates import edge_pairs
from gridloom.operators.components import connected_components
from gridloom.operators.overlaps import numbered
from gridloom.operators.voxelwise import with_ends
from gridloom.plans.scratch import Scratch


def region_graph(vox: DataFrame, label: str, ignore_label: bool = True) -> DataFrame:
    """Distinct ``(u, v)`` of labels that touch, u < v."""
    return edge_pairs(vox, label, ignore_label=ignore_label).select("u", "v").distinct()


def sub_graphs(vox: DataFrame, label: str, ignore_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(block_id, node)`` and ``(block_id, u, v)``: a block's graph, with one voxel of the next blocks."""
    keep = F.col(label) != 0 if ignore_label else F.lit(True)
    nodes = vox.where(keep).select("block_id", F.col(label).alias("node")).distinct()
    pairs = lower_pairs(vox, [label, "block_id"]).where(f"{label}_a <> {label}_b")
    if ignore_label:
        pairs = pairs.where(f"{label}_a <> 0 AND {label}_b <> 0")
    edges = pairs.select(F.col("block_id_a").alias("block_id"), F.least(f"{label}_a", f"{label}_b").alias("u"), F.greatest(f"{label}_a", f"{label}_b").alias("v")).distinct()
    return nodes, edges


def merge_sub_graphs(edges: DataFrame, grid: tuple[int, int, int] | None = None, scale: int = 0) -> DataFrame:
    """Edges of the whole graph, or with a grid those of its blocks joined two by two, ``scale`` times."""
    if grid is None:
        return edges.select("u", "v").distinct()
    k = 1 << scale
    coarse = [-(-g // k) for g in grid]
    z, y, x = F.floor(F.col("block_id") / (grid[1] * grid[2])), F.floor(F.col("block_id") / grid[2]) % grid[1], F.col("block_id") % grid[2]
    block = (F.floor(z / k) * coarse[1] + F.floor(y / k)) * coarse[2] + F.floor(x / k)
    return edges.select(block.cast("long").alias("block_id"), "u", "v").distinct()


def edge_ids(edges: DataFrame) -> DataFrame:
    """``(edge_id, u, v)``: edges numbered from 0 in order of (u, v), by range partitions as labels are."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = edges.select("u", "v").distinct().repartitionByRange(parts, "u", "v").withColumn("_p", F.spark_partition_id())
    placed = Scratch(spark, "edges").save(placed, "placed")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"))
    begins = F.broadcast(sizes.selectExpr("_p", "coalesce(sum(n) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("u", "v"))
    return placed.join(begins, "_p").select((F.col("begin") + rank - 1).cast("long").alias("edge_id"), "u", "v")


def map_edge_ids(block_edges: DataFrame, ids: DataFrame) -> DataFrame:
    return block_edges.join(ids, ["u", "v"]).select("block_id", "edge_id", "u", "v")


def label_components(spark: SparkSession, nodes: DataFrame, edges: DataFrame, ignore_label: bool = True) -> DataFrame:
    """Components of ``nodes(node, label)`` along edges between equal labels, numbered from 1; 0 stays with ``ignore_label``."""
    same = with_ends(edges, nodes).where("lu = lv")
    alone = nodes
    if ignore_label:
        same, alone = same.where("lu <> 0"), nodes.where("label <> 0")
    found = connected_components(spark, same.select("u", "v"))
    every = alone.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    out = numbered(every, "component")
    if ignore_label:
        out = out.unionByName(nodes.where("label = 0").select("node", F.lit(0).cast("long").alias("label")))
    return out


def voxel_components(spark: SparkSession, vox: DataFrame, label: str, id: str = "voxel") -> DataFrame:
    """``vox`` with ``component``: components of equal labels but 0 over faces, as the smallest voxel id; 0 has 0.

    ``id`` is a column of unique voxel ids. Voxels are first joined along x into runs by a window, so that the graph
    has a node for each run, not for each voxel.
    """
    row = Window.partitionBy("z", "y").orderBy("x")
    begins = (F.lag(label).over(row).isNull() | (F.lag(label).over(row) != F.col(label)) | (F.lag("x").over(row) != F.col("x") - 1)).cast("int")
    runs = vox.where(F.col(label) != 0).withColumn("_b", begins).withColumn("_k", F.sum("_b").over(row)).withColumn("_run", F.min(id).over(Window.partitionBy("z", "y", "_k")))
    runs = Scratch(spark, "runs").save(runs.drop("_b", "_k"), "runs")
    pairs = lower_pairs(runs, [label, "_run"]).where(f"axis <> 2 AND {label}_a = {label}_b")
    links = pairs.select(F.col("_run_a").alias("u"), F.col("_run_b").alias("v")).distinct()
    found = connected_components(spark, links).withColumnRenamed("node", "_run")
    inside = runs.join(found.hint("merge"), "_run", "left").withColumn("component", F.coalesce("component", "_run")).drop("_run")
    return inside.unionByName(vox.where(F.col(label) == 0).withColumn("component", F.lit(0).cast("long")))


def merge_assignments(spark: SparkSession, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(node, label)``: labels joined by pairs ``(a, b)``, numbered from 1; 0 stays 0."""
    found = connected_components(spark, pairs, "a", "b")
    every = labels.where("label <> 0").select(F.col("label").alias("node")).distinct().join(found, "node", "left")
    out = numbered(every.select("node", F.coalesce("component", "node").alias("component")), "component")
    return out.unionByName(labels.where("label = 0").limit(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("label")))


def two_pass_assignments(spark: SparkSession, seeds: DataFrame, relabel: DataFrame, labels: DataFrame) -> DataFrame:
    """Seed assignments ``(a, b)`` of the second pass, mapped by ``relabel(label, new_label)``, as components."""
    one = lambda c: relabel.select(F.col("label").alias(c), F.col("new_label").alias(f"_{c}"))
    mapped = seeds.join(one("a"), "a").join(one("b"), "b").where("_a <> 0 AND _b <> 0").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return merge_assignments(spark, labels, mapped)


def contract(edges: DataFrame, labeling: DataFrame, cost: str = "cost", method: str = "sum") -> DataFrame:
    """``(u, v, cost)`` between the new nodes of ``labeling(node, label)``; inner edges vanish."""
    from gridloom.functions.expr import reducer

    inside = with_ends(edges, labeling).where("lu <> lv")
    return inside.groupBy(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).agg(reducer(method)(cost).alias(cost))


def reduce_problem(spark: SparkSession, nodes: DataFrame, edges: DataFrame, cut: DataFrame, method: str = "sum", lifted: DataFrame | None = None):
    """Merge over edges that aren't cut: ``(labeling, new edges, new lifted edges or None)``, labels consecutive."""
    merge = edges.join(cut.select("u", "v"), ["u", "v"], "left_anti")
    found = connected_components(spark, merge.select("u", "v"))
    every = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labeling = Scratch(spark, "labeling").save(numbered(every, "component"), "labeling")
    return labeling, contract(edges, labeling, method=method), contract(lifted, labeling, method=method) if lifted is not None else None


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """The labeling ``then`` of the labels of ``first``, on the nodes of ``first``."""
    second = then.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return first.join(second, "label").select("node", F.col("_new").alias("label"))


def lifted_neighborhood(edges: DataFrame, labels: DataFrame, depth: int = 4, mode: str = "all", ignore: int = 0) -> DataFrame:
    """Distinct pairs of labelled nodes 2 to ``depth`` steps apart, by mode all, same or different label."""
    if mode not in ("all", "same", "different"):
        raise ValueError(f"mode {mode!r}")
    spark = edges.sparkSession
    scratch = Scratch(spark, "lifted")
    both = scratch.save(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    seen, front = both, both
    for k in range(2, depth + 1):
        step = front.select("u", F.col("v").alias("m")).join(both.select(F.col("u").alias("m"), "v"), "m").where("u <> v").select("u", "v").distinct()
        front = scratch.save(step.join(seen, ["u", "v"], "left_anti"), f"front{k}")
        seen = seen.unionByName(front)
    far = seen.where("u < v").join(edges.select("u", "v"), ["u", "v"], "left_anti")
    marked = labels.where(F.col("label") != ignore)
    out = far.join(marked.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(marked.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    if mode != "all":
        out = out.where("lu = lv" if mode == "same" else "lu <> lv")
    return out.select("u", "v")


def merge_lifted(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_assignments(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, label)``: segments with one neighbouring segment take its label; of two that only have each other the
    larger label yields."""
    contracted = with_ends(edges, labels).where("lu <> lv AND lu <> 0 AND lv <> 0").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
    both = contracted.unionByName(contracted.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lonely = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("to")).where("n = 1").select("u", "to")
    back = lonely.select(F.col("u").alias("to"), F.lit(True).alias("_lonely"))
    moved = lonely.join(back, "to", "left").where("_lonely IS NULL OR u > to").select(F.col("u").alias("label"), "to")
    return labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """Each node's neighbours with edge ids, sorted: ``(node, neighbours)``, as carving tools store a graph."""
    both = edges.select(F.col("u").alias("node"), F.struct(F.col("v").alias("node"), "edge_id").alias("n")).unionByName(edges.select(F.col("v").alias("node"), F.struct(F.col("u").alias("node"), "edge_id").alias("n")))
    return both.groupBy("node").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


