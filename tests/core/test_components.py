import random

from gridloom.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is None or v is None:
            continue
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    noise = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    edges = chain + star + noise + [(5, 5), (None, 3), (8, 9), (9, 8), (8, 9)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(spark, df).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0
