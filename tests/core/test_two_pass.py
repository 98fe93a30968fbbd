"""The second pass of the mutex watershed knows what the first has joined and parted."""

import numpy as np
import pytest

from gridloom.model import AXES, Blocking
from gridloom.operators import kernels, segmentation
from gridloom.operators.graph import merge_assignments
from gridloom.plans import workflows

OFFSETS = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, -1, 0)]
BLOCKING = Blocking((1, 2, 8), (1, 2, 4))


def two_rows():
    """Two rows that attract each other a little everywhere, and repel each other strongly at x = 0 alone."""
    aff = np.zeros((4, 1, 2, 8))
    aff[1], aff[2], aff[3] = 0.6, 0.9, 1.0
    aff[3, 0, :, 0] = 0.0
    return aff


def table(spark, aff):
    c, z, y, x = np.indices(aff.shape).reshape(4, -1)
    return spark.createDataFrame(list(zip(c.tolist(), z.tolist(), y.tolist(), x.tolist(), aff.ravel().tolist())), "c long, z long, y long, x long, v double")


def clusters(spark, aff, **how):
    vox, pairs = segmentation.two_pass_mutex_watershed(table(spark, aff), OFFSETS, BLOCKING, halo=(0, 0, 2), size_filter=0, **how)
    lut = {r.node: r.label for r in merge_assignments(spark, vox.selectExpr("ws AS label").distinct(), pairs).collect()}
    out = np.zeros(aff.shape[1:], int)
    for r in vox.collect():
        out[r.z, r.y, r.x] = lut[r.ws]
    return out


def test_a_repulsive_edge_of_the_first_pass_keeps_labels_apart(spark, monkeypatch):
    got = clusters(spark, two_rows())
    assert len(set(got[0, 0])) == len(set(got[0, 1])) == 1 and got[0, 0, 0] != got[0, 1, 0]
    # the second pass can't see x = 0: without the table of edges it joins the rows
    real = segmentation.mutex_state
    monkeypatch.setattr(segmentation, "mutex_state", lambda *a: real(*a).where("false"))
    assert len(set(clusters(spark, two_rows()).ravel())) == 1


def test_rows_join_where_nothing_repels(spark):
    aff = two_rows()
    aff[3] = 1.0
    assert len(set(clusters(spark, aff).ravel())) == 1


def test_state_holds_the_strongest_edges(spark):
    aff = np.random.default_rng(1).random((4, 1, 2, 8))
    labelled = spark.createDataFrame([(0, y, x, x // 4, 1 + y * 2 + x // 4) for y in range(2) for x in range(8)], "z long, y long, x long, block_id long, ws long")
    got = {(r.a, r.b, r.attractive): r.weight for r in segmentation.mutex_state(labelled, table(spark, aff), OFFSETS).collect()}
    # rows meet within a block; edges between blocks don't count
    want = {(1 + k, 3 + k, True): aff[1, 0, 1, 4 * k : 4 * k + 4].max() for k in range(2)} | {(1 + k, 3 + k, False): 1 - aff[3, 0, 1, 4 * k : 4 * k + 4].min() for k in range(2)}
    assert got == pytest.approx(want)


def test_state_edges_compete_by_weight():
    aff = np.zeros((4, 1, 2, 3))
    aff[2], aff[3] = 0.9, 1.0
    seeds = np.array([[[5, 0, 0], [7, 0, 0]]])
    edges = lambda *rows: tuple(np.array(c) for c in zip(*rows))
    one = lambda state: len(np.unique(kernels.mutex_watershed(aff, OFFSETS, 3, seeds=seeds, state=state)))
    assert one(edges((5, 7, 0.8, True), (5, 7, 0.7, False))) == 1
    assert one(edges((5, 7, 0.7, True), (5, 7, 0.8, False))) == 2
    # an edge to a label that the block does not see counts for nothing, and nothing else keeps the two apart
    assert one(edges((5, 9, 0.8, False))) == 1
    assert len(np.unique(kernels.mutex_watershed(aff, OFFSETS, 3, seeds=seeds))) == 2


def test_voxels_are_all_labelled_and_whole(spark):
    rng = np.random.default_rng(2)
    aff = rng.random((4, 2, 6, 12))
    vox, pairs = segmentation.two_pass_mutex_watershed(table(spark, aff), OFFSETS, Blocking((2, 6, 12), (2, 3, 6)), halo=(0, 1, 1), size_filter=0)
    rows = vox.collect()
    assert len({tuple(r[a] for a in AXES) for r in rows}) == len(rows) == 2 * 6 * 12 and min(r.ws for r in rows) > 0
    labels = {r.ws for r in rows}
    assert {r.b for r in pairs.collect()} <= labels
    assert workflows.mutex_watershed_workflow(spark, table(spark, aff), OFFSETS, Blocking((2, 6, 12), (2, 3, 6)), True, size_filter=0).count() == 144


def test_voxels_are_not_broadcast(spark, tmp_path):
    """Their files are small for their rows, so Spark would send them through the driver."""
    table(spark, two_rows()).write.parquet(f"{tmp_path}/aff")
    labelled = spark.createDataFrame([(0, y, x, 0, 1 + y) for y in range(2) for x in range(8)], "z long, y long, x long, block_id long, ws long")
    labelled.write.parquet(f"{tmp_path}/labelled")
    labelled = spark.read.parquet(f"{tmp_path}/labelled")
    plan = segmentation.mutex_state(labelled, spark.read.parquet(f"{tmp_path}/aff"), OFFSETS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_colours_by_expression(spark):
    blocking = Blocking((9, 7, 5), (2, 2, 2))
    got = {r.block_id: r.c for r in spark.range(blocking.count).withColumnRenamed("id", "block_id").withColumn("c", blocking.colour()).collect()}
    assert [b for b in sorted(got) if got[b] == 0] == sorted(blocking.colours()[0]) and [b for b in sorted(got) if got[b] == 1] == sorted(blocking.colours()[1])


def test_labels_of_two_passes_are_connected(spark):
    """Labels that stand don't give way to the size filter, and halves of a label that only met in a halo are two labels."""
    blocking = Blocking((4, 26, 40), (2, 13, 20))
    data = np.random.default_rng(5).random(blocking.shape)
    z, y, x = np.indices(data.shape).reshape(3, -1)
    vox = spark.createDataFrame(list(zip(z.tolist(), y.tolist(), x.tolist(), data.ravel().tolist())), "z long, y long, x long, v double")
    label = np.zeros(data.shape, np.int64)
    for r in segmentation.two_pass_watershed(vox, "v", blocking, sigma_seeds=0.7, sigma_weights=0.5).collect():
        label[r.z, r.y, r.x] = r.ws
    assert (label > 0).all() and len(np.unique(kernels.components(label))) == len(np.unique(label))


def test_invariants_seeds_of_a_deep_volume_stay_apart(spark, monkeypatch):
    """Supervoxels above 10,000 don't run into those of the next block."""
    import pyspark.sql.functions as F

    from gridloom import catalogue

    seen = {}
    deep = catalogue.raster(spark, "/root/testdata/sf0.001").where("z < 1").withColumns({"z": F.lit(600).cast("long"), "ws": F.col("ws") + 12_000, "block_id": F.col("block_id") + 480})
    monkeypatch.setattr(catalogue, "raster", lambda *a: deep)
    monkeypatch.setattr(catalogue.segmentation, "agglomerate", lambda vox, *a, **b: seen.setdefault("vox", vox))
    monkeypatch.setattr(catalogue.graph, "voxel_components", lambda spark, df, label: df.withColumn("component", F.lit(0)))
    catalogue.segmentation_invariants(spark, "")
    assert seen["vox"].select("ws").distinct().count() == deep.select("ws", "block_id").distinct().count()
    assert seen["vox"].where("ws div 601000 <> block_id").count() == 0


def test_coarse_scales_are_not_broadcast(spark, tmp_path):
    from gridloom.operators import models, resample

    spark.range(400).selectExpr("0L AS z", "id div 20 AS y", "id % 20 AS x", "id * 1.0D AS v").write.parquet(f"{tmp_path}/v")
    vox = spark.read.parquet(f"{tmp_path}/v")
    found = models.multiscale_inference([vox, resample.downscale(vox, "v", (1, 5, 5))], "v", [(1, 5, 5)], Blocking((1, 20, 20), (1, 10, 10)), lambda d: d[0] - d[1], [(0, 2, 2), (0, 1, 1)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
