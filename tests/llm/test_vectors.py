import numpy as np
import pytest

from gridloom.llm import neardup_vectors as nv


def brute(rows, threshold=0.9):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold - 1e-12
    root = list(range(len(ok)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ok)):
        for b in np.flatnonzero(near[a]):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
    out, least = [], {}
    for a in range(len(ok)):
        least[find(a)] = min(rows[ok[a]][0], least.get(find(a), 1 << 60))
    for i, (k, _) in enumerate(rows):
        if i in ok:
            a = ok.index(i)
            out.append((k, int(near[a].sum()) - 1, least[find(a)], k == least[find(a)]))
        else:
            out.append((k, 0, k, k is not None))
    return sorted(out, key=str)


def rows_with_groups(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows) * 7 % 1009, (base + rng.normal(size=16) * 0.15).astype(np.float32).tolist()))
    rows += [(5000 + i, rows[3][1]) for i in range(30)]
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [None] + [1.0] * 15), (6003, [float("nan")] * 16), (6004, [1.0]), (6005, []), (None, rows[0][1])]
    return rows


def test_matches_brute_force(spark):
    rows = rows_with_groups()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "'x' as copies")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(spark, df).collect()), key=str)
    assert got == brute(rows)


def test_tiles_and_runs_change_nothing(spark, monkeypatch):
    rows = rows_with_groups(1)
    monkeypatch.setattr(nv, "TILE", 3)
    monkeypatch.setattr(nv, "RUN", 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(spark, df, tables=4).collect()), key=str)
    want = brute(rows)
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want)
    assert all(a[1] <= b[1] for a, b in zip(got, want))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nv.near_duplicates(spark, df).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(1500, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    hasher = nv.CrossPolytope(64)
    x, y = hasher.buckets(a), hasher.buckets(b)
    assert np.stack([nv._meet(x[:, t], y[:, t]) for t in range(nv.TABLES)], 1).any(1).mean() > 0.995
    hasher = nv.CrossPolytope(64, nv.MANY_TABLES, nv.MANY_HASHES, nv.MANY_PROBES)
    x, y = hasher.buckets(a), hasher.buckets(b)
    assert np.stack([nv._meet(x[:, t], y[:, t]) for t in range(nv.MANY_TABLES)], 1).any(1).mean() > 0.995


def test_groups_large_and_small_and_more_hashes(spark, monkeypatch):
    rows = rows_with_groups(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = lambda **t: sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(spark, df, **t).collect()), key=str)
    monkeypatch.setattr(nv, "MANY", 10)
    assert got() == want
    monkeypatch.setattr(nv, "MANY", 1 << 30)
    monkeypatch.setattr(nv, "FEW", 2)
    monkeypatch.setattr(nv, "CHUNK", 50)
    assert got() == want


def test_an_id_with_a_usable_and_an_unusable_vector(spark):
    rows = [(1, [1.0, 2.0]), (1, None), (1, [0.0, 0.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(spark, df).collect())
    assert got == [(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_pairs_found_do_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    # in 1024 components both numbers of hashes miss a few pairs, and not the same ones
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 120, 1024))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1)[:, None]

    def met(tables, hashes, probes):
        hasher = nv.CrossPolytope(1024, tables, hashes, probes)
        x, y = hasher.buckets(a), hasher.buckets(b)
        return np.stack([nv._meet(x[:, t], y[:, t]) for t in range(tables)], 1).any(1)

    differ = np.flatnonzero(met(nv.TABLES, nv.HASHES, nv.PROBES) != met(nv.MANY_TABLES, nv.MANY_HASHES, nv.MANY_PROBES))
    assert len(differ)
    pairs = [*differ.tolist(), *(k for k in range(5) if k not in differ)]
    df = spark.createDataFrame([(2 * k + side, x[k].tolist()) for k in pairs for side, x in enumerate((a, b))], "vec_id long, embedding array<double>")
    got = lambda: sorted(tuple(r) for r in nv.near_duplicates(spark, df).collect())
    few = got()
    monkeypatch.setattr(nv, "MANY", 1)
    with pytest.warns(UserWarning, match="buckets"):
        many = got()
    assert many == few


def test_pairs_at_the_threshold_do_not_depend_on_the_size_of_their_group(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    x = np.concatenate([a, 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]])
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    group = {"id": np.arange(600), "own": np.repeat([0, 1], 300), "stands": np.ones(600, int)}
    # each a is compared with each b, as the tile comes after what it is compared with
    group["id"][300:], group["id"][:300] = np.arange(300), np.arange(300, 600)

    def found(few):
        monkeypatch.setattr(nv, "FEW", few)
        return {pair for i, j in nv._candidates(group, np.array([0]), x, 0.9) for pair in zip(i.tolist(), j.tolist())}

    small = found(1 << 30)
    assert 0 < len(small) < 300 and found(1) == small
