"""Graph partitioning: solvers on blocks of the graph, contraction from scale to scale, and the global rest in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expr import log_odds
from gridloom.operators import contraction, kernels
from gridloom.operators.contraction import LARGEST
from gridloom.operators.graph import compose, reduce_problem
from gridloom.plans.scratch import Scratch


def _solve(n, edges, costs, solver, lifted=None, lifted_costs=None):
    if solver not in kernels.SOLVERS:
        raise ValueError(f"no solver {solver!r}; there are {', '.join(kernels.SOLVERS)}")
    if lifted is not None and len(lifted):
        solve = kernels.greedy_additive if solver == "greedy-additive" else kernels.kernighan_lin
        return solve(n, edges, costs, lifted=lifted, lifted_costs=lifted_costs)
    return kernels.SOLVERS[solver](n, edges, costs)


def solve_subproblems(nodes: DataFrame, edges: DataFrame, solver: str = "kernighan-lin", lifted: DataFrame | None = None, ignore_label: bool = True) -> DataFrame:
    """Cut edges ``(u, v)``: of each block's graph those the solver cuts, and all edges that leave the block.

    ``nodes(block_id, node)``; a node in several blocks belongs to the smallest. An edge is of the block that holds
    both ends, found by two joins; a block's problem is one task, of the size of a block.
    """
    own = nodes.where("node <> 0") if ignore_label else nodes
    # both ends look it up, and lifted edges again
    home = Scratch(nodes.sparkSession, "subproblems").save(own.groupBy("node").agg(F.min("block_id").alias("block_id")), "home")
    at = lambda e, end, name: e.join(home.select(F.col("node").alias(end), F.col("block_id").alias(name)), end)
    placed = at(at(edges.select("u", "v", "cost"), "u", "bu"), "v", "bv")
    outer = placed.where("bu <> bv").select("u", "v")
    inner = placed.where("bu = bv").select(F.col("bu").alias("block_id"), "u", "v", "cost", F.lit(False).alias("lifted"))
    if lifted is not None:
        far = at(at(lifted.select("u", "v", "cost"), "u", "bu"), "v", "bv").where("bu = bv")
        inner = inner.unionByName(far.select(F.col("bu").alias("block_id"), "u", "v", "cost", F.lit(True).alias("lifted")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lifted", "u", "v"])
        uv = frame[["u", "v"]].to_numpy()
        ids, local = np.unique(uv, return_inverse=True)
        local, far = local.reshape(uv.shape), frame["lifted"].to_numpy()
        cost = frame["cost"].to_numpy()
        found = _solve(len(ids), local[~far], cost[~far], solver, local[far], cost[far])
        cut = (found[local[:, 0]] != found[local[:, 1]]) & ~far
        return frame.loc[cut, ["u", "v"]]

    return outer.unionByName(inner.groupBy("block_id").applyInPandas(run, "u long, v long"))


def solve_global(spark: SparkSession, nodes: DataFrame, edges: DataFrame, solver: str = "decomposition", lifted: DataFrame | None = None, ignore_label: bool = True, largest: int = LARGEST) -> DataFrame:
    """``(node, label)`` of the whole (reduced) problem, labels from 1, node 0 protected.

    Contracted in rounds until ``largest`` edges are left, which the solver gets (see ``contraction.multicut``).
    """
    if solver not in kernels.SOLVERS:
        raise ValueError(f"no solver {solver!r}; there are {', '.join(kernels.SOLVERS)}")
    every = edges.select("u", "v", "cost", F.lit(True).alias("local"))
    if lifted is not None:
        every = every.unionByName(lifted.select("u", "v", "cost", F.lit(False).alias("local")))
    every = every.where("u <> 0 AND v <> 0 AND u <> v" if ignore_label else "u <> v")
    joint = every.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("cost").alias("cost"), F.bool_or("local").alias("local"))
    return _labelled(nodes, contraction.multicut(spark, joint, solver, largest), ignore_label)


def _labelled(nodes: DataFrame, solved: DataFrame, ignore_label: bool = False) -> DataFrame:
    """``(node, label)`` of all nodes, clusters numbered from 1 by their smallest node."""
    from gridloom.operators.overlaps import numbered

    every = nodes.select("node").distinct()
    every = every.where("node <> 0") if ignore_label else every
    out = numbered(every.join(solved, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "root")
    zero = nodes.where("node = 0").select("node", F.lit(0).cast("long").alias("label")).distinct()
    return out.unionByName(zero) if ignore_label else out


def multicut(spark: SparkSession, nodes: DataFrame, edges: DataFrame, grid: tuple[int, int, int], scales: int = 1, solver: str = "kernighan-lin", final: str = "decomposition", lifted: DataFrame | None = None) -> DataFrame:
    """Hierarchical: solve blocks, contract, double the blocks, and at last solve what is left: ``(node, label)``.

    Nodes and edges are written once, as each scale reads them several times and they may come from all voxels.
    """
    scratch = Scratch(spark, "multicut")
    nodes, edges = scratch.save(nodes.select("block_id", "node"), "nodes"), scratch.save(edges.select("u", "v", "cost"), "edges")
    lifted = scratch.save(lifted.select("u", "v", "cost"), "lifted") if lifted is not None else None
    labeling = None
    for scale in range(scales):
        cut = solve_subproblems(nodes, edges, solver, lifted)
        whole = nodes.select("node").distinct()
        own, edges, lifted = reduce_problem(spark, whole.where("node <> 0"), edges.where("u <> 0 AND v <> 0"), cut, lifted=lifted)
        edges = scratch.save(edges, f"edges{scale}")
        lifted = scratch.save(lifted, f"lifted{scale}") if lifted is not None else None
        k = 1 << (scale + 1)
        coarse = [-(-g // k) for g in grid]
        up = [-(-g // (k // 2)) for g in grid]
        z, y, x = F.floor(F.col("block_id") / (up[1] * up[2])), F.floor(F.col("block_id") / up[2]) % up[1], F.col("block_id") % up[2]
        block = ((F.floor(z / 2) * coarse[1] + F.floor(y / 2)) * coarse[2] + F.floor(x / 2)).cast("long")
        nodes = scratch.save(nodes.where("node <> 0").join(own, "node").select(block.alias("block_id"), F.col("label").alias("node")).distinct(), f"nodes{scale}")
        labeling = scratch.save(own if labeling is None else compose(labeling, own), f"labeling{scale}")
    last = solve_global(spark, nodes.select("node").distinct(), edges, final, lifted)
    return last if labeling is None else compose(labeling, last)


def sub_solutions(cut: DataFrame, nodes: DataFrame, edges: DataFrame, spark: SparkSession) -> DataFrame:
    """``(block_id, node, label)``: the parts of each block's solution, numbered from 1 in order of blocks."""
    from gridloom.operators.components import connected_components
    from gridloom.operators.relabel import find_labeling

    merge = edges.select("u", "v").join(cut, ["u", "v"], "left_anti")
    found = connected_components(spark, merge)
    own = nodes.where("node <> 0").join(found, "node", "left").select("block_id", "node", F.coalesce("component", "node").alias("root"))
    own = own.withColumn("label", F.struct("block_id", "root"))
    # numbered by range partitions, so neither one task nor the driver holds a row for each block
    return own.join(find_labeling(own, start=1), "label").select("block_id", "node", F.col("new_label").alias("label"))


def stitching_multicut(spark: SparkSession, nodes: DataFrame, edges: DataFrame, beta1: float = 0.5, beta2: float = 0.75, solver: str = "kernighan-lin") -> DataFrame:
    """Multicut with costs of ``(u, v, mean, size, stitch)``: a weaker bias on stitch edges, weighted by size."""
    most = F.broadcast(edges.agg(F.max("size").alias("_most")))
    cost = F.when(F.col("stitch"), log_odds(F.col("mean"), beta1)).otherwise(log_odds(F.col("mean"), beta2)) * F.col("size") / F.col("_most")
    return solve_global(spark, nodes, edges.crossJoin(most).withColumn("cost", cost), solver)


def agglomerative_clustering(spark: SparkSession, nodes: DataFrame, edges: DataFrame, threshold: float, largest: int = LARGEST) -> DataFrame:
    """Average linkage over ``(u, v, mean, size)`` to the threshold, ``(node, label)`` from 1 (see ``contraction.average_linkage``)."""
    return _labelled(nodes, contraction.average_linkage(spark, edges, threshold, largest))


def graph_watershed_assignments(spark: SparkSession, edges: DataFrame, labels: DataFrame, discard: DataFrame, weight: str = "mean", from_costs: bool = False, relabel: bool = False, largest: int = LARGEST) -> DataFrame:
    """Nodes of discarded segments go to the segment that reaches them over the lightest edges; 0 is a seed of its own.

    They are the trees of the minimum spanning forest rooted at the nodes that stay (see ``contraction.spanning_forest``).
    """
    from gridloom.operators.overlaps import numbered

    gone = discard.select(F.col("id").alias("label"), F.lit(True).alias("_gone")).distinct()
    own = F.when(F.col("_gone"), 0).otherwise(F.when(F.col("label") == 0, -1).otherwise(F.col("label"))).cast("long").alias("seed")
    seeds = Scratch(spark, "seeds").save(labels.join(gone, "label", "left").select("node", own), "seeds")
    w = F.col(weight)
    if from_costs:
        bounds = F.broadcast(edges.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi")))
        edges = edges.crossJoin(bounds).withColumn(weight, 1 - (w - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
    one = lambda end, name: seeds.select(F.col("node").alias(end), F.col("seed").alias(name))
    # edges between two seeded nodes never move a node, so only those with a free end matter
    free = edges.select("u", "v", F.col(weight).alias("w")).join(one("u", "su"), "u").join(one("v", "sv"), "v").where("su = 0 OR sv = 0")
    reached = contraction.spanning_forest(spark, free, seeds.where("seed <> 0"), largest).withColumnRenamed("seed", "found")
    out = seeds.join(reached, "node", "left").select("node", F.greatest(F.when(F.col("seed") == 0, F.coalesce("found", F.lit(0))).otherwise(F.col("seed")), F.lit(0)).cast("long").alias("label"))
    if not relabel:
        return out
    return numbered(out.where("label <> 0"), "label").unionByName(out.where("label = 0"))
