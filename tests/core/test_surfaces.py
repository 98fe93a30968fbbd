"""Distances along runs and surfaces by blocks, against kernels on whole objects and against what closed surfaces keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.model import AXES
from gridloom.operators import distances, kernels, objects, surfaces
from tests.core.test_operators import dense, volume


@pytest.mark.parametrize(("resolution", "batch"), [((1.0, 1.0, 1.0), 10_000), ((4.0, 0.5, 1.25), 7)])
def test_distances_equal_the_kernel(spark, resolution, batch):
    data = np.kron(np.random.default_rng(1).integers(0, 4, (3, 4, 3)), np.ones((2, 3, 5), int))
    want = np.zeros(data.shape)
    for k in range(1, 4):
        mask = np.pad(data == k, 1)
        want += kernels.distance_transform(mask, resolution)[1:-1, 1:-1, 1:-1]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = distances.distance_transform(volume(spark, data, "l"), "l", resolution)
        assert found.count() == (data > 0).sum()
        assert np.allclose(dense(found, "distance", data.shape).astype(float), want)
        centres = {r.id: (r.z, r.y, r.x) for r in objects.region_centers(volume(spark, data, "l"), "l", resolution=resolution).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in range(1, 4):
        assert want[centres[k]] == pytest.approx(want[data == k].max())


def test_a_run_longer_than_batches(spark):
    data = np.ones((1, 1, 50), int)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = dense(distances.distance_transform(volume(spark, data, "l"), "l", (100.0, 100.0, 1.0)), "distance", data.shape)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.ravel().tolist() == [float(min(k + 1, 50 - k)) for k in range(50)]


def test_distances_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "z long, y long, x long, l long")
    assert distances.distance_transform(empty, "l").count() == 0 and objects.region_centers(empty, "l").count() == 0
    some = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 5), (0, 0, 2, 0), (0, 0, 3, 5)], "z long, y long, x long, l long")
    assert sorted((r.x, r.l, r.distance) for r in distances.distance_transform(some, "l").collect()) == [(1, 5, 1.0), (3, 5, 1.0)]


@pytest.mark.parametrize("shape", ["tetrahedra", "squares"])
def test_surfaces_don_t_depend_on_blocks(spark, shape):
    data = (np.random.default_rng(3).random((5, 6, 7)) < 0.5) * (1 + (np.arange(7) > 3))
    own = volume(spark, data, "id").where("id > 0")
    sets = [sorted(map(tuple, surfaces.surface_faces(own, block, shape).collect())) for block in ((2, 3, 2), (64, 64, 64), (1, 1, 1))]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == len(set(sets[0]))
    rows = {r.id: r for r in surfaces.surface_measures(surfaces.surface_faces(own, (2, 3, 2), shape), (2.0, 1.0, 0.5)).collect()}
    for k in (1, 2):
        mask = np.pad(data == k, 1)
        turns = surfaces.surface_edges(surfaces.surface_faces(own, (2, 3, 2), shape)).where(f"id = {k} AND turns <> 0").count()
        assert turns == 0
        if shape == "squares":
            assert rows[k].volume == pytest.approx(mask.sum())
            assert rows[k].faces == 2 * sum(np.diff(mask.astype(int), axis=a).astype(bool).sum() for a in range(3))
        else:
            assert rows[k].open_edges == 0 and 2 * rows[k].edges == 3 * rows[k].faces


def test_a_ball_and_a_ring(spark):
    at = np.indices((17, 17, 17)) - 8
    ball = (at**2).sum(axis=0) <= 36
    ring = (np.hypot(at[1], at[2]) - 5) ** 2 + at[0] ** 2 <= 4
    for mask, euler in ((ball, 2), (ring, 0)):
        own = volume(spark, mask.astype(int), "id").where("id > 0")
        r = surfaces.surface_measures(surfaces.surface_faces(own, (5, 6, 7))).first()
        assert r.euler == euler and r.open_edges == 0 and abs(r.volume - mask.sum()) < 0.05 * mask.sum()
    found = surfaces.surface_faces(volume(spark, ball.astype(int), "id").where("id > 0"), (5, 6, 7))
    outward = surfaces.surface_vertices(found).select((sum(F.col(f"n{c}") * (F.col(c) - 8) for c in AXES)).alias("o"), sum(F.col(f"n{c}") ** 2 for c in AXES).alias("n"))
    low = outward.agg(F.min("o"), F.min("n"), F.max("n")).first()
    # the voxels at the poles stand out alone, so normals beside them are nearly across
    assert low[0] > 0 and low[1] == pytest.approx(1) and low[2] == pytest.approx(1)


def test_smoothing_by_joins_equals_the_packed_form(spark):
    data = np.zeros((4, 5, 6), int)
    data[1:3, 1:4, 1:5] = 2
    data[1, 1, 1] = 0
    own = volume(spark, data, "id")
    faces = surfaces.surface_faces(own.where("id > 0"), (2, 2, 2), "squares")
    got = surfaces.smoothed(surfaces.surface_vertices(faces, (2.0, 1.0, 1.0)), surfaces.surface_edges(faces), 3)
    mesh = objects.meshes(own, "id", (2.0, 1.0, 1.0), smoothing=3, block=(3, 3, 3)).first()
    assert np.allclose([(r.z, r.y, r.x) for r in got.orderBy("place").collect()], mesh.vertices)
    with pytest.raises(ValueError):
        surfaces.surface_faces(own, shape="cubes")


def test_surfaces_of_nothing(spark):
    empty = spark.createDataFrame([], "z long, y long, x long, id long")
    assert surfaces.surface_measures(surfaces.surface_faces(empty)).count() == 0 and objects.meshes(empty, "id").count() == 0


def test_measures_by_cells_equal_those_of_triangles(spark, monkeypatch):
    from gridloom import catalogue

    data = np.random.default_rng(4).integers(0, 4, (5, 6, 7)) - (np.indices((5, 6, 7))[0] > 3) * 9
    own = volume(spark, data, "id").where("id <> 0")
    # a second object on the same voxels, a voxel twice, one without a label: objects don't hide each other
    own = own.unionByName(own.where("id = 1").selectExpr("z - 2 AS z", "y", "x", "77 AS id")).unionByName(own.limit(1)).unionByName(own.limit(1).selectExpr("z", "y", "x", "CAST(NULL AS LONG) AS id"))
    want = sorted(surfaces.surface_measures(surfaces.surface_faces(own), (2.0, 1.0, 0.5)).collect())
    for block in ((2, 3, 2), (64, 64, 64), (1, 1, 1)):
        got = sorted(surfaces.object_measures(own, block, (2.0, 1.0, 0.5)).collect())
        assert len(got) == len(want) > 4
        for a, b in zip(got, want):
            assert a.asDict() == {**b.asDict(), "area": pytest.approx(b.area), "volume": pytest.approx(b.volume)}
    # the query makes no triangles, of which there are about 36 a voxel
    monkeypatch.setattr(surfaces, "surface_faces", None)
    assert catalogue.surface_measures(spark, "/root/testdata/sf0.001").count() == 9


@pytest.mark.parametrize("packed", [1, 150, 200_000])
def test_objects_are_packed_together(spark, monkeypatch, packed):
    """Objects of one batch, of several, and of many batches each come whole, and not one by one."""
    data = np.random.default_rng(5).integers(0, 5, (4, 5, 6)) - 2
    data[data == 0] = 9
    data = np.pad(data, ((0, 0), (0, 0), (0, 40)), constant_values=9)
    calls = spark.sparkContext.accumulator(0)
    real = objects._packed

    def counted(*given):
        calls.add(1)
        return real(*given)

    monkeypatch.setattr(objects, "_packed", counted)
    monkeypatch.setattr(objects, "PACKED", packed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        vox = volume(spark, data, "id")
        faces = surfaces.surface_faces(vox, (2, 3, 7), "squares").toPandas()
        rows = objects.meshes(vox, "id", (2.0, 1.0, 0.5), block=(3, 3, 3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in rows) == sorted(set(data.ravel().tolist()))
    if packed > len(faces):
        assert 0 < calls.value < len(rows)
    for r in rows:
        own = faces[faces["id"] == r.id][surfaces.PLACES].to_numpy().reshape(-1, 3)
        places, want = np.unique(own, axis=0, return_inverse=True)
        assert np.allclose(places / 2 * (2.0, 1.0, 0.5), r.vertices)
        assert sorted(map(tuple, want.reshape(-1, 3).tolist())) == [tuple(f) for f in r.faces]
        assert np.allclose(np.linalg.norm(r.normals, axis=1), 1, atol=1e-9) or np.linalg.norm(r.normals, axis=1).min() < 1e-9
