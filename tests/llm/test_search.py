import numpy as np

from gridloom.llm import vector_search as vs


def brute(rows, ask, top=20):
    ok = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v and len(v) == 32 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for k, v in ok:
        if ask(k):
            every = sorted({(-float(np.einsum("j,j->", v, w)), j) for j, w in ok if j != k})
            out[k] = every[:top]
    return out


def make(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 32))
    rows = [(i, (centre[rng.integers(12)] + rng.normal(size=32) * 0.7).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(60)]
    rows += [(9000, None), (9020, [0.0] * 32), (9040, [None] + [1.0] * 31), (None, rows[0][1]), (9060, [float("inf")] * 32), (9080, [1.0])]
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as query")
    got = {}
    for r in vs.search(spark, df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, lambda k: k % 20 == 0)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        order = [(-s, i) for _, i, s in found]
        assert order == sorted(order)
        exact = {i: -s for s, i in want[q]}
        hits += len(exact.keys() & {i for _, i, _ in found})
        for _, i, s in found:
            if i in exact:
                assert abs(exact[i] - s) < 1e-12
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_and_order(spark):
    check(spark, make())


def test_few_rows_return_all(spark):
    rows = [(20 * i, [float(i + 1)] + [0.5] * 31) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert vs.search(spark, df, df).count() == 5 * 4
    assert vs.search(spark, df.limit(0), df.limit(0)).count() == 0


def test_hot_vector_ties(spark):
    rows = [(i, [1.0, 2.0] + [0.0] * 30) for i in range(300)] + [(1000 + i, [0.5, float(i)] + [0.0] * 30) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vs.search(spark, df, df.where("vec_id = 5")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(22) if i != 5][:20]


def recall(spark, vectors, every=20):
    """The share of the true neighbours found; each query must get as many as there are."""
    vectors = vectors.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in vs.search(spark, df, df.where(f"vec_id % {every} = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked, most, hits = np.arange(0, len(vectors), every), min(20, len(vectors) - 1), 0
    score = vectors[asked].astype(float) @ vectors.astype(float).T
    assert sorted(got) == asked.tolist()
    for q, row in zip(asked.tolist(), score):
        row[q] = -np.inf
        assert len(got[q]) == most
        hits += len(got[q] & set(np.argsort(-row, kind="stable")[:most].tolist()))
    return hits / (most * len(asked))


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_no_query_is_short(spark):
    rng = np.random.default_rng(3)
    assert recall(spark, unit(rng.normal(size=(12, 32))), 1) == 1
    groups = np.repeat(rng.normal(size=(3, 32)), 14, axis=0)
    assert recall(spark, unit(groups + 0.05 * rng.normal(size=groups.shape)), 1) == 1


def test_tight_groups_and_outliers(spark):
    rng = np.random.default_rng(4)
    groups = np.repeat(rng.normal(size=(30, 32)), 600, axis=0)
    every = unit(np.concatenate([groups + 0.05 * rng.normal(size=groups.shape), rng.normal(size=(400, 32))]))
    share = recall(spark, every[rng.permutation(len(every))])
    print("recall on grouped vectors", share)
    assert share >= 0.95


def test_repeated_id_among_the_nearest(spark):
    rng = np.random.default_rng(6)
    rows = [(7, [1.0, 0.001 * k] + [0.0] * 30) for k in range(60)] + [(100 + i, rng.normal(size=32).tolist()) for i in range(40)] + [(205, [1.0, 0.02] + [0.0] * 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert vs.search(spark, df, df.where("vec_id = 205")).count() == 20


def test_queries_of_another_length_take_no_part(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(100 + 20 * i, [1.0, 2.0, 3.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vs.search(spark, df, df.where("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {0, 20} and len(got) == 40
    assert vs.search(spark, df, df.where("vec_id >= 100")).count() == 0


def test_one_row_more_does_not_change_how_much_is_read(spark):
    # by a row that is nobody's neighbour; no table is read whole for being small
    rng = np.random.default_rng(8)
    every = unit(rng.normal(size=(2048, 32)))
    one = recall(spark, every)
    assert one >= 0.9
    assert abs(recall(spark, np.concatenate([every, every[:1] * 1e-3])) - one) < 0.03


def test_recall_of_the_query_on_larger_tables(spark):
    rng = np.random.default_rng(8)
    assert recall(spark, unit(rng.normal(size=(8192, 32)))) >= 0.9
    # lengths that differ by a factor of ten
    assert recall(spark, rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)) * 0.5)) >= 0.9


def read_and_found(x, top=20, queries=60):
    """Vectors that a query reads, centroids included, as a share of all, and the share of its neighbours among them."""
    drawn = np.random.default_rng(2).permutation(len(x))[: vs.SAMPLE]
    index = vs.Index(x[drawn], len(x), top)
    stands = np.zeros((len(x), len(index.graph.centroids)), bool)
    home = np.zeros(len(index.graph.centroids))
    for at in range(0, len(x), 2048):
        i, j, first = index.lists_of(x[at : at + 2048])
        stands[at + i, j] = True
        home += np.bincount(j[first], minlength=len(home))
    read, hits = [], []
    for q in range(0, len(x), len(x) // queries):
        _, j = index.opened(x[q : q + 1], home, vs.AMPLE * top + 1)
        score = x @ x[q]
        score[q] = -np.inf
        read.append((stands[:, j].sum() + len(home)) / len(x))
        hits.append(stands[np.argpartition(-score, top)[:top]][:, j].any(axis=1).mean())
    return float(np.mean(read)), float(np.mean(hits)), stands.sum() / len(x)


def test_half_of_vectors_without_structure_stay_unread():
    read, found, copies = read_and_found(np.random.default_rng(1).normal(size=(50_000, 64)))
    assert read < 0.5 and found >= 0.9 and copies < 1.1


def test_few_of_grouped_vectors_are_read():
    rng = np.random.default_rng(4)
    groups = np.repeat(rng.normal(size=(30, 32)), 600, axis=0)
    read, found, _ = read_and_found(unit(np.concatenate([groups + 0.05 * rng.normal(size=groups.shape), rng.normal(size=(400, 32))])))
    assert read < 0.1 and found >= 0.95


def test_walks_over_the_graph_find_the_nearest_centroids():
    rng = np.random.default_rng(9)
    x = vs.directions(rng.normal(size=(3000, 16)))
    graph = vs.CentroidGraph(vs.balanced_centroids(x, 300))
    (i, j), _ = graph.search(x[:200], 0.1)
    far = graph.square - 2 * x[:200] @ graph.centroids.T + 1
    want = far <= (graph.base(far) * 1.1)[:, None] ** 2
    got = np.zeros_like(want)
    got[i, j] = True
    assert (got & want).sum() >= 0.99 * want.sum() and (got & ~want).sum() <= 0.01 * want.sum()
