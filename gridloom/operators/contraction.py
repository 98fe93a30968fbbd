"""Rounds of contraction: clusters of graphs that no single task could hold.

In each round every edge that is the best of both its ends merges them. All such edges are found by one aggregation over
nodes and one over edges, and no two of them meet, so a round is exact whatever the order. Where the rule allows it, nodes
whose best edge leads to such a pair follow, so that a large cluster doesn't grow by one node a round. Edges between
merged nodes add up. Each round's edges are written to the shared folder; a lost executor costs one round.

A remainder of up to ``largest`` edges may be left to a kernel in one task; beyond that there are only rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import kernels
from gridloom.operators.components import connected_components
from gridloom.plans.scratch import Scratch

#: Edges that one task may get.
LARGEST = 20_000


@dataclass
class Rule:
    """How edges compare (higher is better), which may merge, and how the columns of parallel ones are aggregated."""

    strength: Column
    merges: Column
    joint: dict[str, Callable[[str], Column]]
    #: Edges whose ends don't follow one pair together; none: only pairs merge, so that a cluster's smallest node keeps.
    apart: Column | None = None


def contract_rounds(spark: SparkSession, edges: DataFrame, rule: Rule, largest: int = LARGEST, rounds: int = 1000) -> tuple[DataFrame, DataFrame, int]:
    """``(merges, rest, rounds run)``: ``merges(gone, keep)`` is a forest of clusters, ``rest`` the edges between clusters.

    ``edges(u, v, …)`` with u < v, one row a pair; equally strong edges go by (u, v). It ends when no edge may merge, or
    ``largest`` edges are left.
    """
    scratch = Scratch(spark, "contraction")
    table = scratch.save(edges, "edges0")
    merged = None
    for turn in range(1, rounds + 1):
        size = table.agg(F.count("*").alias("n"), F.count_if(rule.merges).alias("m")).first()
        if size.m == 0 or size.n <= largest:
            break
        order = F.struct(rule.strength.alias("s"), (-F.col("u")).alias("u"), (-F.col("v")).alias("v")).alias("best")
        able = table.where(rule.merges)
        ends = able.select(F.col("u").alias("node"), order).unionByName(able.select(F.col("v").alias("node"), order))
        best = ends.groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.s").alias("s"), (-F.col("best.u")).alias("keep"), (-F.col("best.v")).alias("gone"))
        if rule.apart is not None:
            best = scratch.save(best, f"best{turn}")
        pairs = best.groupBy("keep", "gone").count().where("count = 2").select("gone", "keep")
        if rule.apart is not None:
            pairs = scratch.save(pairs, f"pairs{turn}")
            pairs = pairs.unionByName(_followers(table.where(rule.apart), best, pairs))
        pairs = scratch.save(pairs, f"merges{turn}")
        merged = pairs if merged is None else merged.unionByName(pairs)
        to = lambda end, name: pairs.select(F.col("gone").alias(end), F.col("keep").alias(name))  # noqa: B023, E731
        moved = table.join(to("u", "_u"), "u", "left").join(to("v", "_v"), "v", "left").withColumns({"_u": F.coalesce("_u", "u"), "_v": F.coalesce("_v", "v")}).where("_u <> _v")
        grouped = moved.groupBy(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).agg(*[f(c).alias(c) for c, f in rule.joint.items()])
        table = scratch.save(grouped, f"edges{turn}")
        scratch.drop(f"edges{turn - 1}", *([f"best{turn}", f"pairs{turn}"] if rule.apart is not None else []))
    else:
        raise RuntimeError(f"not contracted after {rounds} rounds")
    if merged is None:
        merged = spark.createDataFrame([], "gone long, keep long")
    return merged, table, turn - 1


def _followers(apart: DataFrame, best: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(gone, keep)`` of nodes whose best edge leads to one of a pair that merges, so that it merges with all of them at
    once. Of two of one pair's that edges ``apart(u, v)`` part, the one with the weaker edge waits; so does one parted from
    the pair's other end."""
    ends = pairs.select(F.col("gone").alias("node"), "keep").unionByName(pairs.select(F.col("keep").alias("node"), "keep"))
    other = F.when(F.col("node") == F.col("gone"), F.col("_k")).otherwise(F.col("gone"))
    near = best.select("node", "s", "gone", F.col("keep").alias("_k")).select("node", "s", other.alias("to"))
    comes = near.join(ends.select(F.col("node").alias("to"), "keep"), "to").join(ends.select("node"), "node", "left_anti").select("node", "keep", "s")
    members = comes.unionByName(ends.select("node", "keep", F.lit(float("inf")).alias("s")))
    side = lambda end, k, s: members.select(F.col("node").alias(end), F.col("keep").alias(k), F.col("s").alias(s))
    parted = apart.select("u", "v").join(side("u", "ku", "su"), "u").join(side("v", "kv", "sv"), "v").where("ku = kv")
    waits = parted.select(F.when((F.col("su") < F.col("sv")), F.col("u")).otherwise(F.col("v")).alias("node")).distinct()
    return comes.join(waits, "node", "left_anti").select(F.col("node").alias("gone"), "keep")


def _in_one_task(edges: DataFrame, solve) -> DataFrame:
    """``(gone, keep)`` of what a kernel makes of a table within the bound; ``solve(ends, frame)`` labels local nodes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["u", "v"])
        ids, local = np.unique(frame[["u", "v"]].to_numpy(), return_inverse=True)
        found = solve(local.reshape(-1, 2), frame)
        first = np.full(found.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, found, ids)
        root = first[found]
        return pd.DataFrame({"gone": ids[root != ids], "keep": root[root != ids]})

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "gone long, keep long")


def _clusters(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes that merges touch."""
    return connected_components(spark, merges, "gone", "keep").withColumnRenamed("component", "root")


def multicut(spark: SparkSession, edges: DataFrame, solver: str = "kernighan-lin", largest: int = LARGEST) -> DataFrame:
    """``(node, root)`` of the nodes that merge, for ``edges(u, v, cost, local)``, one row a pair with u < v.

    Attractive edges that are best for both their ends merge, with nodes that have their best edge there and no repulsive
    one; parallel edges' costs add up. Edges that aren't local (lifted ones) add cost but never merge alone. A remainder within ``largest`` is solved by the named kernel.
    """
    cost = F.col("cost")
    rule = Rule(cost, F.col("local") & (cost > 0), {"cost": F.sum, "local": F.bool_or}, cost < 0)
    merges, rest, _ = contract_rounds(spark, edges.select("u", "v", "cost", "local"), rule, largest)

    def solve(ends: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        far, cost = ~frame["local"].to_numpy(bool), frame["cost"].to_numpy(float)
        n = int(ends.max()) + 1
        if far.any():
            kernel = kernels.greedy_additive if solver == "greedy-additive" else kernels.kernighan_lin
            return kernel(n, ends[~far], cost[~far], lifted=ends[far], lifted_costs=cost[far])
        return kernels.SOLVERS[solver](n, ends, cost)

    if largest and rest.where(rule.merges).limit(1).count():
        merges = merges.unionByName(_in_one_task(rest, solve))
    return _clusters(spark, merges)


def average_linkage(spark: SparkSession, edges: DataFrame, threshold: float, largest: int = LARGEST) -> DataFrame:
    """``(node, root)`` of the nodes that merge, for ``edges(u, v, mean, size)``.

    Pairs that are each other's nearest merge. The mean to a merged pair is never below both means to its parts, so the
    result is that of merging the nearest pair of all one by one, if no two means are equal; equal ones go by the smaller
    (u, v), a cluster counting as its smallest node.
    """
    own = edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(F.col("mean") * F.col("size")).alias("total"), F.sum(F.col("size").cast("double")).alias("size"))
    mean = F.col("total") / F.col("size")
    merges, rest, _ = contract_rounds(spark, own, Rule(-mean, mean < threshold, {"total": F.sum, "size": F.sum}), largest)

    def solve(ends: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        size = frame["size"].to_numpy(float)
        return kernels.average_linkage(int(ends.max()) + 1, ends, frame["total"].to_numpy(float) / size, size, threshold=threshold)

    if largest and rest.where(mean < threshold).limit(1).count():
        merges = merges.unionByName(_in_one_task(rest, solve))
    return _clusters(spark, merges)


def spanning_forest(spark: SparkSession, edges: DataFrame, seeds: DataFrame, largest: int = LARGEST, rounds: int = 60) -> DataFrame:
    """``(node, seed)`` of the nodes that a seed reaches, in the minimum spanning forest rooted at the seeds.

    ``edges(u, v, w)`` have an end without a seed at least, ``seeds(node, seed)`` are labels but 0 of the others. In each
    round every part without a seed takes its lightest edge out (equal weights by u, v), which is in the forest for
    certain; parts along those edges become one, of which one holds a seed at the most. That halves the parts without a
    seed. A remainder within ``largest`` is finished by the same rule edge by edge.
    """
    scratch = Scratch(spark, "forest")
    # a, b: the parts at both ends; sa, sb: their seeds or null
    at = lambda end, name: seeds.select(F.col("node").alias(end), F.col("seed").alias(name))
    start = edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    table = scratch.save(start.join(at("a", "sa"), "a", "left").join(at("b", "sb"), "b", "left").where("a <> b AND (sa IS NULL OR sb IS NULL)"), "edges0")
    parts = None  # (node, part) of the nodes whose part isn't themselves
    rooted = seeds  # (node, seed) by part
    for turn in range(1, rounds + 1):
        if table.count() <= largest:
            break
        edge = F.struct("w", "u", "v").alias("e")
        free = table.where("sa IS NULL").select(F.col("a").alias("part"), F.struct(edge, F.col("b").alias("to")).alias("x"))
        free = free.unionByName(table.where("sb IS NULL").select(F.col("b").alias("part"), F.struct(edge, F.col("a").alias("to")).alias("x")))
        picks = scratch.save(free.groupBy("part").agg(F.min("x").alias("x")).select("part", F.col("x.to").alias("to")), f"picks{turn}")
        joint = scratch.save(connected_components(spark, picks, "part", "to").select(F.col("node").alias("part"), F.col("component").alias("new")), f"joint{turn}")
        moved = joint.join(rooted.select(F.col("node").alias("part"), "seed"), "part", "left").groupBy("new").agg(F.max("seed").alias("seed")).where("seed IS NOT NULL")
        rooted = scratch.save(rooted.join(joint.select(F.col("part").alias("node")), "node", "left_anti").select("node", "seed").unionByName(moved.select(F.col("new").alias("node"), "seed")), f"rooted{turn}")
        parts = joint.select(F.col("part").alias("node"), F.col("new").alias("part")) if parts is None else _moved_parts(parts, joint)
        parts = scratch.save(parts, f"parts{turn}")
        own = rooted.select(F.col("node").alias("part"), F.col("seed").alias("s"))
        for end, s in (("a", "sa"), ("b", "sb")):
            table = table.drop(s).join(joint.select(F.col("part").alias(end), "new"), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
            table = table.join(own.select(F.col("part").alias(end), F.col("s").alias(s)), end, "left")
        table = table.where("a <> b AND (sa IS NULL OR sb IS NULL)")
        # of parallel edges only the lightest can be taken
        lightest = F.min(F.struct("w", "u", "v")).alias("e")
        table = table.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("sa")).otherwise(F.col("sb")).alias("sa"), F.when(F.col("a") < F.col("b"), F.col("sb")).otherwise(F.col("sa")).alias("sb")).agg(lightest)
        table = scratch.save(table.select("e.u", "e.v", "e.w", "a", "b", "sa", "sb"), f"edges{turn}")
    else:
        raise RuntimeError(f"no forest after {rounds} rounds")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "u", "v"])
        ends = frame[["a", "b"]].to_numpy()
        ids, local = np.unique(ends, return_inverse=True)
        local = local.reshape(ends.shape)
        # seeds by number, so that any label will do
        label = np.zeros(len(ids), np.int64)
        known = pd.concat([frame["sa"], frame["sb"]], ignore_index=True)
        codes, uniques = pd.factorize(known)
        for k, c in ((0, codes[: len(frame)]), (1, codes[len(frame) :])):
            label[local[c >= 0, k]] = c[c >= 0] + 1
        found = kernels.graph_watershed(len(ids), local, np.arange(len(frame), dtype=float), label)
        new = (label == 0) & (found > 0)
        return pd.DataFrame({"node": ids[new], "seed": uniques.to_numpy().astype(np.int64)[found[new] - 1]})

    last = table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "node long, seed long") if largest else None
    roots = rooted if last is None else scratch.save(rooted.unionByName(last), "roots")
    if parts is None:
        return roots
    within = parts.join(roots.select(F.col("node").alias("part"), "seed"), "part").select("node", "seed")
    return within.unionByName(roots.join(within.select("node"), "node", "left_anti"))


def _moved_parts(parts: DataFrame, joint: DataFrame) -> DataFrame:
    """Each node's part after parts became one, with the nodes that were their own part until now."""
    new = joint.select("part", "new")
    before = parts.join(new, "part", "left").select("node", F.coalesce("new", "part").alias("part"))
    first = joint.join(parts.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("new").alias("part"))
    return before.unionByName(first)
