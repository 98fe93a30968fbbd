"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two shuffles on the node key, after which each partition brings its own edges to stars, so that a
graph that fits one partition needs no further round. Links are never gathered in one task or on the driver, and each
round's edge table is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.scratch import Scratch

#: Edges that a task takes up before it brings them to a forest.
CHUNK = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For items 0..size-1 linked by (a, b): the smallest item of each one's component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def local_stars(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with each partition's edges replaced by stars of its components: no more than its nodes."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def settle():
            nonlocal a, b
            ends = np.concatenate([np.stack([a, b])] + [np.stack(w) for w in waiting], axis=1)
            waiting.clear()
            ids, at = np.unique(ends, return_inverse=True)
            at = at.reshape(ends.shape)
            root = ids[least_labels(at[0], at[1], len(ids))]
            a, b = ids[root != ids], root[root != ids]

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(w[0]) for w in waiting) >= CHUNK:
                settle()
        settle()
        for at in range(0, len(a), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + CHUNK]), pa.array(b[at : at + CHUNK])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s"),
    ).first()
    return tuple(row)


def connected_components(spark: SparkSession, edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge, component = smallest node id reachable.

    Null endpoints and self links are ignored (a node that occurs only in a self link is returned as its
    own component); repeated and reversed links count once; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "components")
    # written once: whatever makes the edges runs a single time
    ends = scratch.save(edges.select(F.col(u).cast("long").alias("x"), F.col(v).cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL"), "ends")
    nodes_alone = ends.where("x = y").select(F.col("x").alias("node")).distinct()
    table = scratch.save(local_stars(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))), "e0")
    seen, name = _signature(table), "e0"
    for turn in range(1, max_rounds + 1):
        if seen[0] == 0:
            break
        # large star: the larger neighbours of a node link to the smallest of its neighbourhood
        both = table.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(table.select(F.col("b").alias("p"), F.col("a").alias("q")))
        low = both.groupBy("p").agg(F.least(F.min("q"), F.first("p")).alias("m"))
        star = both.where("q > p").join(low, "p").select(F.col("q").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        pulled = star.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        table = scratch.save(local_stars(pulled.unionByName(least.select("a", F.col("m").alias("b"))).distinct()), f"e{turn}")
        now = _signature(table)
        scratch.drop(name)
        name = f"e{turn}"
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components not settled after {max_rounds} rounds")
    roots = table.select(F.col("b").alias("node")).distinct()
    members = table.select(F.col("a").alias("node"), F.col("b").alias("component"))
    known = members.unionByName(roots.select("node", F.col("node").alias("component")))
    return known.unionByName(nodes_alone.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
