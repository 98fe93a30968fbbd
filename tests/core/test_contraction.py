"""Rounds of contraction against the kernels that work edge by edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import contraction, kernels, solvers


def graph(seed, n=60, degree=3.0, values=lambda rng, n: rng.normal(0.3, 1, n)):
    rng = np.random.default_rng(seed)
    ends = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < degree / n or b == a + 1 and rng.random() < 0.9}
    edges = np.array(sorted(ends))
    return edges, values(rng, len(edges))


def roots(rows, n):
    out = np.arange(n)
    for r in rows:
        out[r.node] = r.root
    return out


def same(a, b):
    return len({*zip(a.tolist(), b.tolist())}) == len(set(a.tolist())) == len(set(b.tolist()))


def rows_of(spark, edges, **columns):
    names = list(columns)
    return spark.createDataFrame([(int(u), int(v), *(columns[c][k].item() for c in names)) for k, (u, v) in enumerate(edges)], ["u", "v", *names])


def test_multicut_in_rounds_comes_near_the_greedy_kernel(spark):
    edges, costs = graph(1, 80, values=lambda rng, n: rng.normal(0.1, 1, n))
    own = rows_of(spark, edges, cost=costs).withColumn("local", F.lit(True))
    greedy = kernels.multicut_energy(edges, costs, kernels.greedy_additive(80, edges, costs))
    found = roots(contraction.multicut(spark, own, largest=0).collect(), 80)
    assert kernels.multicut_energy(edges, costs, found) <= greedy + 0.05 * abs(greedy)
    # clusters hang together, and no attractive edge is left between two
    inner = edges[found[edges[:, 0]] == found[edges[:, 1]]]
    assert same(np.unique(found, return_inverse=True)[1], _parts(inner, 80))
    between = {}
    for (u, v), c in zip(found[edges].tolist(), costs.tolist()):
        if u != v:
            between[min(u, v), max(u, v)] = between.get((min(u, v), max(u, v)), 0) + c
    assert max(between.values()) <= 1e-9


def _parts(edges, n):
    union = kernels.UnionFind(n)
    for a, b in edges.tolist():
        union.merge(a, b)
    return union.labels()


def test_a_hub_with_many_followers_takes_few_rounds(spark):
    n = 400
    edges = np.array([(0, k) for k in range(1, n)])
    own = rows_of(spark, edges, cost=1 + np.arange(n - 1) / n).withColumn("local", F.lit(True))
    rule = contraction.Rule(F.col("cost"), F.col("local") & (F.col("cost") > 0), {"cost": F.sum, "local": F.bool_or}, F.col("cost") < 0)
    merges, rest, rounds = contraction.contract_rounds(spark, own, rule, 0)
    assert rounds <= 2 and rest.count() == 0 and merges.count() == n - 1


def test_followers_that_repel_each_other_dont_come_together(spark):
    edges = np.array([(0, 1), (0, 2), (0, 3), (2, 3), (1, 2)])
    costs = np.array([9.0, 3.0, 2.0, -5.0, 0.5])
    own = rows_of(spark, edges, cost=costs).withColumn("local", F.lit(True))
    assert roots(contraction.multicut(spark, own, largest=0).collect(), 4).tolist() == [0, 0, 0, 3]


def test_lifted_edges_count_but_do_not_merge_alone(spark):
    rows = [(1, 2, 1.0, True), (2, 3, 1.0, True), (1, 3, -5.0, False), (7, 8, 9.0, False)]
    own = spark.createDataFrame(rows, "u long, v long, cost double, local boolean")
    for largest in (0, 100):
        found = roots(contraction.multicut(spark, own, largest=largest).collect(), 9)
        assert len({found[1], found[2], found[3]}) == 2 and found[7] != found[8]


@pytest.mark.parametrize("largest", [0])
def test_average_linkage_in_rounds_is_exact(spark, largest):
    edges, means = graph(largest + 3, 60, 4.0, lambda rng, n: rng.random(n))
    sizes = np.random.default_rng(5).integers(1, 9, len(edges)).astype(float)
    found = contraction.average_linkage(spark, rows_of(spark, edges, mean=means, size=sizes), 0.45, largest).collect()
    assert same(roots(found, 60), kernels.average_linkage(60, edges, means, sizes, threshold=0.45))


def test_average_linkage_ties(spark):
    edges = np.array([(1, 2), (2, 3), (3, 4)])
    found = contraction.average_linkage(spark, rows_of(spark, edges, mean=np.full(3, 0.2), size=np.ones(3)), 0.5, 0).collect()
    assert roots(found, 5).tolist() == [0, 1, 1, 1, 1]
    assert contraction.average_linkage(spark, rows_of(spark, edges, mean=np.full(3, 0.2), size=np.ones(3)), 0.2, 0).count() == 0


@pytest.mark.parametrize(("seed", "largest"), [(1, 0), (3, 25)])
def test_spanning_forest_is_exact_also_with_ties(spark, seed, largest):
    edges, weights = graph(seed, 90, 2.0, lambda rng, n: rng.integers(0, 8, n).astype(float))
    rng = np.random.default_rng(seed)
    labels = np.where(rng.random(90) < 0.2, rng.choice([-1, 3, 5, 8], 90), 0)
    want = kernels.graph_watershed(90, edges, weights, labels)
    free = rows_of(spark, edges[(labels[edges] == 0).any(axis=1)], w=weights[(labels[edges] == 0).any(axis=1)])
    seeds = spark.createDataFrame([(k, int(s)) for k, s in enumerate(labels) if s], "node long, seed long")
    got = np.zeros(90, int)
    for r in contraction.spanning_forest(spark, free, seeds, largest).collect():
        assert got[r.node] == 0
        got[r.node] = r.seed
    assert got.tolist() == np.where(labels != 0, labels, want).tolist()


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "u long, v long, cost double, local boolean")
    assert contraction.multicut(spark, none).count() == 0
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert sorted(tuple(r) for r in solvers.solve_global(spark, nodes, none).collect()) == [(1, 1), (2, 2)]
    assert sorted(tuple(r) for r in solvers.agglomerative_clustering(spark, nodes, spark.createDataFrame([], "u long, v long, mean double, size double"), 0.5).collect()) == [(1, 1), (2, 2)]


def test_unknown_solvers_are_refused(spark):
    with pytest.raises(ValueError):
        solvers.solve_global(spark, spark.range(1).toDF("node"), spark.createDataFrame([(1, 2, 0.5)], "u long, v long, cost double"), "nothing")


def test_edges_and_nodes_are_made_once(spark):
    """What edges and nodes come from (all voxels) is run a single time for costs and for a multicut."""
    from gridloom.operators import voxelwise

    seen = {name: spark.sparkContext.accumulator(0) for name in ("features", "edges", "nodes")}

    def counted(df, name):
        def run(batches):
            for frame in batches:
                seen[name].add(len(frame))
                yield frame

        return df.mapInPandas(run, df.schema)

    edges = spark.range(60).selectExpr("id + 1 AS u", "id + 2 AS v", "IF(id % 3 = 0, 0.9, 0.2) AS p", "1 + id % 4 AS size")
    costs = voxelwise.probs_to_costs(counted(edges, "features"), size="size")
    assert costs.count() == 60 and costs.agg(F.count_distinct("cost")).first()[0] == 8
    assert seen["features"].value == 60
    nodes = spark.range(61).selectExpr("id DIV 20 AS block_id", "id + 1 AS node")
    found = solvers.multicut(spark, counted(nodes, "nodes"), counted(costs.select("u", "v", "cost"), "edges"), (1, 1, 4), scales=2)
    # a chain is cut at its repulsive edges
    assert len({r.label for r in found.collect()}) == 21
    assert (seen["edges"].value, seen["nodes"].value) == (60, 61)
