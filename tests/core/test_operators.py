import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.model import AXES, Blocking
from gridloom.operators import aggregates as agg
from gridloom.operators import graph, kernels, models, objects, overlaps, relabel, resample, segmentation, solvers, stencils, voxelwise
from gridloom.plans import workflows
from gridloom.sources import volumes


def volume(spark, data, name="v"):
    z, y, x = np.indices(data.shape).reshape(3, -1)
    kind = "double" if data.dtype.kind == "f" else "long"
    rows = list(zip(z.tolist(), y.tolist(), x.tolist(), data.ravel().tolist()))
    return spark.createDataFrame(rows, f"z long, y long, x long, {name} {kind}")


def dense(df, name, shape):
    out = np.zeros(shape, object)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[name]
    return out


def same_partition(a, b):
    pairs = set(zip(a.ravel().tolist(), b.ravel().tolist()))
    return len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


BLOCKING = Blocking((4, 10, 12), (2, 5, 6))


def test_blocks_cover_and_clip():
    b = Blocking((1023, 2049, 355), (65, 93, 24))
    ids = b.blocks_in((104, 1039, 27), (911, 1855, 134))
    seen = np.zeros((1023 // 13 + 1, 2049 // 31 + 1, 355 // 8 + 1), bool)
    low = np.min([b.box(i)[0] for i in ids], axis=0)
    high = np.max([b.box(i)[1] for i in ids], axis=0)
    assert (low <= (104, 1039, 27)).all() and (high >= (911, 1855, 134)).all() and len(ids) == len(set(ids))
    assert sum(np.prod(np.subtract(*b.box(i)[::-1])) for i in range(b.count)) == 1023 * 2049 * 355
    white, black = b.colours()
    assert sorted(white + black) == list(range(b.count)) and b.blocks_in(only=[3, 10**9]) == [3]
    del seen


def test_toy_components(spark):
    nodes = spark.createDataFrame([(i, int(c)) for i, c in enumerate("1112221122")], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long")
    got = {r.node: r.label for r in graph.label_components(spark, nodes, edges).collect()}
    assert "".join(str(got[i]) for i in range(10)) == "1112223344"


@pytest.mark.parametrize("block", [(2, 5, 6), (4, 10, 12), (3, 4, 5)])
def test_components_don_t_depend_on_blocks(spark, block):
    data = (np.random.default_rng(5).random((4, 10, 12)) < 0.55).astype(float)
    vox = volume(spark, data).withColumn("block_id", Blocking(data.shape, block).block_id())
    found = dense(segmentation.connected_components(spark, vox, "v", Blocking(data.shape, block), threshold=0.5), "component", data.shape)
    assert same_partition(found.astype(int), kernels.components(data > 0.5))
    labels = np.random.default_rng(6).integers(0, 3, data.shape)
    vox = volume(spark, labels, "l")
    found = dense(segmentation.connected_components(spark, vox, "l", Blocking(data.shape, block)), "component", data.shape)
    assert same_partition(found.astype(int), kernels.components(labels))


def test_voxel_components_by_runs(spark):
    labels = np.random.default_rng(7).integers(0, 3, (3, 8, 9))
    vox = volume(spark, labels, "l").withColumn("voxel", F.col("z") * 72 + F.col("y") * 9 + F.col("x") + 1)
    found = dense(graph.voxel_components(spark, vox, "l"), "component", labels.shape).astype(int)
    assert same_partition(found, kernels.components(labels))


def test_watersheds_are_connected(spark):
    data = kernels.gaussian(np.random.default_rng(8).random(BLOCKING.shape), 1.0)
    vox = volume(spark, data).withColumn("m", F.col("y") > 0)
    for f in (segmentation.watershed, segmentation.two_pass_watershed):
        label = dense(f(vox, "v", BLOCKING, mask="m", halo=(1, 2, 2), size_filter=3, in_2d=False), "ws", data.shape).astype(int)
        assert (label[:, 0] == 0).all() and (label[:, 1:] > 0).all()


def test_mutex_watershed_workflow(spark):
    rng = np.random.default_rng(9)
    rows = [(c, z, y, x, float(0.05 if c < 3 and x == 6 and c == 2 else rng.uniform(0.8, 1) if c < 3 else rng.uniform(0.8, 1))) for c in range(4) for z in range(2) for y in range(6) for x in range(12)]
    aff = spark.createDataFrame(rows, "c long, z long, y long, x long, v double")
    offsets = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -4, 0)]
    for two_pass in (False, True):
        got = workflows.mutex_watershed_workflow(spark, aff, offsets, Blocking((2, 6, 12), (2, 3, 6)), two_pass, size_filter=0)
        label = dense(got, "ws", (2, 6, 12)).astype(int)
        assert (label > 0).all() and label.max() <= 8


def test_copy_modes_and_errors(spark):
    data = np.arange(24).reshape(2, 3, 4)
    vox = volume(spark, data).withColumn("block_id", Blocking(data.shape, (1, 3, 4)).block_id())
    cut = voxelwise.copy_volume(vox, "v", begin=(1, 0, 1), end=(2, 2, 3), fit_to_roi=True)
    assert (dense(cut, "v", (1, 2, 2)).astype(int) == data[1:2, :2, 1:3]).all()
    assert voxelwise.copy_volume(vox.withColumn("v", F.when(F.col("z") == 0, 0).otherwise(F.col("v"))), "v", skip_empty_blocks=True).count() == 12
    with pytest.raises(ValueError):
        voxelwise.copy_volume(vox, "v", dtype="int", int_to_uint=8)
    with pytest.raises(ValueError):
        voxelwise.to_boundaries(vox.withColumn("c", F.lit(0)), "nothing")
    with pytest.raises(Exception, match="label without assignment"):
        voxelwise.write_labels(vox, "v", spark.createDataFrame([(1, 2)], "label long, new_label long")).collect()
    with pytest.raises(ValueError):
        agg.size_filter(vox, size_threshold=1, target_number=1)


def test_relabel_is_a_bijection_in_order(spark):
    rows = [(int(i),) for i in np.random.default_rng(1).integers(5, 10**9, 500)]
    lut = relabel.find_labeling(spark.createDataFrame(rows, "label long")).orderBy("label").collect()
    assert [r.new_label for r in lut] == list(range(1, len({r[0] for r in rows}) + 1))
    lut = relabel.find_labeling(spark.createDataFrame([(0,), (9,), (0,)], "label long")).orderBy("label").collect()
    assert [tuple(r) for r in lut] == [(0, 0), (9, 1)]
    assert relabel.find_labeling(spark.createDataFrame([], "label long")).count() == 0


def test_costs_with_node_labels(spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.9), (3, 4, 0.5)], "u long, v long, p double")
    marks = spark.createDataFrame([(2, 7), (3, 7)], "node long, label long")
    cost = lambda mode: [r.cost for r in voxelwise.probs_to_costs(edges, node_labels={mode: marks}).orderBy("u").collect()]
    low, high = 5 * np.log(0.1 / 0.9), 5 * np.log(0.9 / 0.1)
    assert np.allclose(cost("isolate"), [low, high, low]) and np.allclose(cost("ignore"), [low] * 3) and np.allclose(cost("ignore_transition"), [low, np.log(0.1 / 0.9), low])


def test_hierarchical_multicut_finds_the_blobs(spark):
    rng = np.random.default_rng(3)
    n, rows = 60, []
    for a in range(n):
        for b in range(a + 1, min(n, a + 4)):
            rows.append((a + 1, b + 1, float(rng.uniform(0.5, 1.5)) * (1 if a // 15 == b // 15 else -1)))
    edges = spark.createDataFrame(rows, "u long, v long, cost double")
    nodes = spark.createDataFrame([(i // 10, i + 1) for i in range(n)], "block_id long, node long")
    for scales in (0, 1, 2):
        got = {r.node: r.label for r in solvers.multicut(spark, nodes, edges, (1, 1, 6), scales).collect()}
        assert same_partition(np.array([got[i + 1] for i in range(n)]), np.arange(n) // 15)


def test_contraction_keeps_the_cost_between_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(rng.normal())) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.4]
    edges = spark.createDataFrame(rows, "u long, v long, cost double")
    nodes = spark.createDataFrame([(i, i % 4 + 1) for i in range(20)], "node long, label long")
    total = sum(c for a, b, c in rows if a % 4 != b % 4)
    assert abs(graph.contract(edges, nodes).agg(F.sum("cost")).first()[0] - total) < 1e-9


def test_clustering_and_graph_watershed(spark):
    edges = spark.createDataFrame([(1, 2, 0.1, 1.0), (2, 3, 0.8, 1.0), (3, 4, 0.2, 1.0), (4, 5, 0.9, 1.0)], "u long, v long, mean double, size double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    got = {r.node: r.label for r in solvers.agglomerative_clustering(spark, nodes, edges, 0.5).collect()}
    assert got[1] == got[2] != got[3] == got[4] != got[5]
    labels = nodes.select("node", F.col("node").alias("label"))
    got = {r.node: r.label for r in solvers.graph_watershed_assignments(spark, edges, labels, spark.createDataFrame([(2,), (3,)], "id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 4, 4: 4, 5: 5}


def test_image_filter_equals_whole_volume(spark):
    data = np.random.default_rng(2).random(BLOCKING.shape)
    data[0, 0, 0], data[-1, -1, -1] = 0.0, 1.0
    whole = Blocking(data.shape, data.shape)
    got = dense(stencils.image_filter(volume(spark, data), "v", whole, "gaussianSmoothing", 1.0, (0, 0, 0)), "v", data.shape).astype(float)
    assert np.allclose(got, kernels.gaussian(data, 1.0))


def test_affine_identity_and_remap(spark):
    data = np.random.default_rng(2).random((2, 5, 6))
    vox = volume(spark, data)
    eye = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    for order in (0, 1):
        assert np.allclose(dense(resample.affine(vox, "v", eye, data.shape, order), "v", data.shape).astype(float), data)
    there = vox.select(*AXES, F.col("z").cast("double").alias("tz"), (4.0 - F.col("y")).alias("ty"), F.col("x").cast("double").alias("tx"))
    assert np.allclose(dense(resample.remap(vox, "v", there), "v", data.shape).astype(float), data[:, ::-1])


def test_objects(spark):
    data = np.zeros((5, 7, 9), int)
    data[1:4, 1:6, 1:8] = 3
    vox = volume(spark, data, "l")
    centre = objects.region_centers(vox, "l").first()
    assert (centre.z, centre.y, centre.x) == (2, 2, 2) and centre.id == 3
    mesh = objects.meshes(vox, "l").first()
    v, f = np.array(mesh.vertices), np.array(mesh.faces)
    inside = np.einsum("ij,ij->i", v[f[:, 0]], np.cross(v[f[:, 1]], v[f[:, 2]])).sum() / 6
    assert abs(inside - 3 * 5 * 7) < 1e-9 and len(f) == 2 * 2 * (15 + 21 + 35)
    assert objects.as_obj(objects.meshes(vox, "l")).first().value.startswith("v ")
    bones = objects.skeletonize(vox, "l")
    row = bones.first()
    assert 0 < len(row.nodes) < 105 and objects.upsample_skeletons(bones, vox, "l", (1, 1, 1)).count() == len(row.nodes)


def test_models(spark):
    data = np.random.default_rng(2).random(BLOCKING.shape)
    vox = volume(spark, data).withColumn("m", F.col("x") < 6)
    found = models.inference(vox, "v", BLOCKING, lambda d: np.stack([d, 2 * d]), {"a": (0, 1), "b": (0, 2)}, (1, 2, 2), preprocess="none", mask="m", accumulate="mean")
    assert np.allclose(dense(found["b"], "v", data.shape).astype(float)[:, :, :6], 1.5 * data[:, :, :6]) and found["a"].count() == data.size // 2
    coarse = resample.downscale(vox, "v", 2)
    both = models.multiscale_inference([vox, coarse], "v", [(2, 2, 2)], BLOCKING, lambda s: s[0] - s[1], [(0, 0, 0), (1, 1, 1)])
    want = data - np.repeat(np.repeat(np.repeat(data.reshape(2, 2, 5, 2, 6, 2).mean((1, 3, 5)), 2, 0), 2, 1), 2, 2)
    assert np.allclose(dense(both, "v", data.shape).astype(float), want)
    stack = models.filter_stack(vox, "v", BLOCKING, (1.0,), (1, 2, 2)).withColumn("edge_label", (F.col("x") < 6).cast("int"))
    forest = models.learn_forest(stack, ["f0", "f1", "f2"], trees=3)
    assert models.pixel_classification(vox, "v", BLOCKING, forest, (1.0,), (1, 2, 2), [1]).count() == data.size


def test_volume_round_trip_and_pruning(spark, tmp_path):
    data = np.random.default_rng(2).random((6, 4, 5))
    path = str(tmp_path / "v")
    volumes.write_volume(volume(spark, data), path, Blocking(data.shape, (2, 4, 5)), {"maxId": 7})
    assert volumes.read_attributes(spark, path)["maxId"] == 7
    assert np.allclose(dense(volumes.read_volume(spark, path), "v", data.shape).astype(float), data)
    part = volumes.read_volume(spark, path, (2, 1, 0), (4, 3, 5))
    assert part.count() == 2 * 2 * 5
    assert "bz" in part._jdf.queryExecution().toString().split("PartitionFilters")[1][:120]
    np.save(tmp_path / "a.npy", data)
    assert np.allclose(dense(volumes.read_arrays(spark, f"{tmp_path}/*.npy"), "v", data.shape).astype(float), data)
    levels = workflows.copy_sources_workflow(spark, f"{tmp_path}/*.npy", str(tmp_path / "p"), Blocking(data.shape, (2, 4, 5)), [2, (1, 2, 2)])
    assert [x.count() for x in levels] == [120, 3 * 2 * 3, 3 * 1 * 2]
    assert volumes.read_attributes(spark, str(tmp_path / "p/s2"))["downsamplingFactors"] == [2, 4, 4]


def test_workflows_run(spark, sf):
    vox = volumes.raster(spark, sf)
    blocking = Blocking((1, 25, 40), (1, 13, 20))
    vox = vox.withColumn("block_id", blocking.block_id())
    seg = workflows.multicut_segmentation_workflow(spark, vox, "v", blocking, skip_ws=True, sanity_checks=True)
    assert seg.count() == vox.count() and seg.where("segment IS NULL").count() == 0
    whole = workflows.watershed_workflow(vox.drop("ws"), "v", blocking, halo=(0, 2, 2), size_filter=4)
    top = whole.agg(F.max("ws"), F.count_distinct("ws")).first()
    assert top[0] == top[1]
    exact = workflows.evaluation_workflow(vox, "gt", "gt").first()
    assert abs(exact.vi_split) < 1e-9 and abs(exact.vi_merge) < 1e-9 and abs(exact.rand_index - 1) < 1e-9 and abs(exact.adapted_rand_error) < 1e-9
    filled = workflows.size_filter_workflow(vox, "gt", 95, blocking, "v")
    assert filled.count() == vox.count() and filled.where("gt = 0").count() == 0
    assert workflows.filter_by_threshold_workflow(vox, "ws", "v", 48.0).where("ws = 0").count() > 0
    tables = workflows.label_tables_workflow(vox, "ws")
    assert tables["max_id"].first().max_id == 40
    model = workflows.learning_workflow([(vox, "ws", "v", "gt")], trees=3)
    assert workflows.problem_workflow(vox, "ws", "v", blocking, model=model).costs.where("cost IS NULL").count() == 0


def test_skeleton_evaluation(spark):
    from gridloom.operators import evaluation

    data = np.array([[[1, 1, 2, 2, 3, 3]]])
    nodes = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 0, 0, 1), (1, 2, 0, 0, 2), (2, 0, 0, 0, 3), (2, 1, 0, 0, 4), (2, 2, 0, 0, 5)], "skeleton long, node long, z long, y long, x long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2)], "skeleton long, u long, v long")
    row = evaluation.skeleton_evaluation(nodes, edges, volume(spark, data, "l"), "l").first()
    assert (row.correct, row.split, row.merge, row.n_merges) == (0.5, 0.0, 0.5, 1)


def test_distances_by_brute_force(spark):
    data = np.zeros((3, 8, 9), int)
    rng = np.random.default_rng(3)
    for i in range(1, 8):
        data[tuple(rng.integers(0, (3, 8, 9)))] = i
    got = {(r.a, r.b): r.distance for r in overlaps.object_distances(volume(spark, data, "l"), "l", 4.0, (2.0, 1.0, 1.0)).collect()}
    want = {}
    for a in range(1, 8):
        for b in range(a + 1, 8):
            p, q = np.argwhere(data == a), np.argwhere(data == b)
            if len(p) and len(q):
                d = np.sqrt((((p[:, None] - q[None]) * (2, 1, 1)) ** 2).sum(-1)).min()
                if d < 4:
                    want[a, b] = d
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_filtered_features_are_those_of_each_response(spark):
    from gridloom.operators import aggregates as agg
    from gridloom.operators.stencils import image_filter

    rng = np.random.default_rng(5)
    rows = [(z, y, x, float(rng.random()), y // 3 * 2 + x // 4 + 1) for z in range(3) for y in range(6) for x in range(8)]
    vox = spark.createDataFrame(rows, "z long, y long, x long, v double, ws long")
    blocking = Blocking((3, 6, 8), (3, 6, 8))
    found = agg.filtered_edge_features(vox, "ws", "v", blocking, {"gaussianSmoothing": [0.8, 1.5], "laplacianOfGaussian": [1.0]}, (0, 0, 0))
    for name, sigma in (("gaussianSmoothing", 0.8), ("gaussianSmoothing", 1.5), ("laplacianOfGaussian", 1.0)):
        response = image_filter(vox.select("z", "y", "x", "v"), "v", blocking, name, sigma, (0, 0, 0)).toPandas()
        value = {(r.z, r.y, r.x): r.v for r in response.itertuples()}
        label = {r[:3]: r[4] for r in rows}
        want = {}
        for (z, y, x), a in label.items():
            for p in ((z + 1, y, x), (z, y + 1, x), (z, y, x + 1)):
                if p in label and label[p] != a:
                    want.setdefault((min(a, label[p]), max(a, label[p])), []).append(max(value[z, y, x], value[p]))
        got = {(r.u, r.v): r for r in found.where(f"filter = '{name}' AND sigma = {sigma}").collect()}
        assert set(got) == set(want)
        for k, values in want.items():
            assert got[k].size == len(values) and abs(got[k]["mean"] - np.mean(values)) < 1e-9 and abs(got[k]["max"] - max(values)) < 1e-12
    channels = agg.filtered_edge_features(vox.withColumn("c", (vox.x * 0).cast("long")).unionByName(vox.withColumn("c", (vox.x * 0 + 1).cast("long"))), "ws", "v", blocking, {"gaussianSmoothing": [1.0]}, (0, 0, 0))
    assert {r.c for r in channels.collect()} == {0, 1}
    assert channels.count() == 2 * len(want)


def test_stitch_assignments_label_every_node(spark):
    from gridloom.operators import overlaps

    edges = spark.createDataFrame([(1, 2, 9, True), (2, 3, 2, True), (4, 5, 9, False), (7, 9, 8, True)], "u long, v long, size long, stitch boolean")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 7, 9)], "node long")
    got = {r.node: r.label for r in overlaps.stitch_assignments(spark, edges, 5, nodes=nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 9: 6}
    assert len(overlaps.stitch_assignments(spark, edges, 5).collect()) == 7


def test_all_channels_and_files_are_copied(spark, tmp_path):
    rng = np.random.default_rng(9)
    both = rng.random((2, 2, 4, 4)), rng.random((2, 4, 4))
    for k, data in enumerate(both):
        np.save(tmp_path / f"a{k}.npy", data)
    done = workflows.copy_channels_workflow(spark, f"{tmp_path}/*.npy", str(tmp_path / "p"), Blocking((2, 4, 4), (2, 4, 4)), [2])
    assert sorted(c for _, c in done) == [0, 0, 1]
    for (name, c), levels in done.items():
        data = both[0][c] if name.endswith("a0.npy") else both[1]
        assert np.allclose(dense(levels[0], "v", data.shape).astype(float), data)
        assert np.allclose(dense(levels[1], "v", (1, 2, 2)).astype(float), data.reshape(1, 2, 2, 2, 2, 2).mean(axis=(1, 3, 5)))
    with pytest.raises(ValueError):
        workflows.copy_sources_workflow(spark, f"{tmp_path}/*.npy", str(tmp_path / "q"), Blocking((2, 4, 4), (2, 4, 4)), [2])


def test_offsets_of_blocks_are_sums_before_each(spark):
    n = [int(k) for k in np.random.default_rng(3).integers(0, 50, 300)]
    rows = [(b, None if b % 7 == 0 else n[b]) for b in range(300)]
    got = {r.block_id: r.offset for r in resample.sub_volume_offsets(spark.createDataFrame(rows, "block_id long, n long")).collect()}
    total = 0
    for b, k in rows:
        assert got[b] == total
        total += k or 0
    assert resample.sub_volume_offsets(spark.createDataFrame([], "block_id long, n long")).count() == 0


def test_ranges_of_blocks_join_to_the_whole_rows(spark):
    rows = [(b, q) for b in range(50) for q in ([0, b % 3] if b % 5 else [None])]
    vox = spark.createDataFrame([*rows, *rows[:9]], "block_id long, q long")
    whole = {r.label: r.blocks for r in relabel.label_blocks(vox, "q").collect()}
    parts = {}
    for r in sorted(relabel.label_block_ranges(vox, "q", 8).collect(), key=lambda r: r.part):
        assert len(r.blocks) <= 8
        parts.setdefault(r.label, []).extend(r.blocks)
    assert parts == whole


def test_histograms_of_edges_merge_and_give_quantiles(spark):
    rng = np.random.default_rng(12)
    rows = [(int(u), int(u) + 1, int(b), float(x)) for u, b, x in zip(rng.integers(0, 3, 900), rng.integers(0, 5, 900), rng.normal(0.5, 0.4, 900))]
    pairs = spark.createDataFrame(rows, "u long, v long, block_id long, value double")
    direct = agg.edge_histograms(pairs, 0.0, 1.0, 256)
    merged = agg.merge_edge_histograms(agg.edge_histograms(pairs, 0.0, 1.0, 256, by=("block_id",)))
    one, two = ({(r.u, r.bin): r for r in t.collect()} for t in (direct, merged))
    assert one.keys() == two.keys() and max(k for _, k in one) == 255 and min(k for _, k in one) == 0
    for k, r in one.items():
        assert (r.n, r.min, r.max) == (two[k].n, two[k].min, two[k].max) and np.allclose((r.mean, r.var), (two[k].mean, two[k].var))
    for r in agg.histogram_features(merged, 0.0, 1.0, 256).collect():
        values = np.array([x for u, _, _, x in rows if u == r.u])
        assert (r.size, r.min, r.max) == (len(values), values.min(), values.max()) and np.allclose((r.mean, r.var), (values.mean(), values.var()))
        for q in (25, 50, 75):
            assert abs(r[f"q{q}"] - np.quantile(values, q / 100)) < 0.02
