"""Cubic resampling and smoothing along lines, against their definitions on whole arrays."""

import numpy as np
import pytest

from gridloom.operators import resample
from tests.core.test_operators import dense, volume


def mirrored(i, n):
    """The place in 0 … n - 1 that a mirrored volume shows at i."""
    if n == 1:
        return 0
    i = abs(i) % (2 * n - 2)
    return min(i, 2 * n - 2 - i)


def bump(t):
    t = abs(t)
    return (4 - 6 * t**2 + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


def spline_at(data, point):
    """The spline through all voxels, its coefficients by solving for them."""
    for k, n in enumerate(data.shape):
        rows = np.zeros((n, n))
        for i in range(n):
            for j in (-1, 0, 1):
                rows[i, mirrored(i + j, n)] += bump(j)
        data = np.moveaxis(np.linalg.solve(rows, np.moveaxis(data, k, 0).reshape(n, -1)).reshape([n, *np.delete(data.shape, k)]), 0, k)
    total = 0.0
    near = [range(int(np.floor(p)) - 1, int(np.floor(p)) + 3) for p in point]
    for i in near[0]:
        for j in near[1]:
            for k in near[2]:
                total += bump(point[0] - i) * bump(point[1] - j) * bump(point[2] - k) * data[mirrored(i, data.shape[0]), mirrored(j, data.shape[1]), mirrored(k, data.shape[2])]
    return total


@pytest.mark.parametrize(("shape", "block", "batch"), [((4, 5, 6), (2, 3, 4), 10_000), ((1, 7, 3), (1, 1, 1), 5)])
def test_cubic_equals_the_definition(spark, shape, block, batch):
    data = np.random.default_rng(5).random(shape)
    matrix = [[0.9, 0.05, 0, 0], [0.1, 0.8, -0.1, 0.7], [0, 0.15, 1.1, -0.5]] if shape[0] > 1 else [[1, 0, 0, 0], [0, 0.7, 0.2, 0], [0, 0.1, 0.6, 0]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = dense(resample.affine(volume(spark, data), "v", matrix, shape, 3, fill=-1.0, block=block), "v", shape).astype(float)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    inside = 0
    for at in np.ndindex(*shape):
        p = np.array(matrix) @ np.array([*at, 1.0])
        within = all(0 <= q <= n - 1 for q, n in zip(p, shape))
        inside += within
        assert got[at] == pytest.approx(spline_at(data, p) if within else -1.0, abs=1e-9)
    assert 0 < inside < data.size or shape[0] == 1


def test_whole_places_keep_their_values(spark):
    data = np.random.default_rng(6).random((3, 4, 5))
    eye = np.eye(3, 4).tolist()
    assert np.allclose(dense(resample.affine(volume(spark, data), "v", eye, data.shape, 3, block=(2, 2, 2)), "v", data.shape).astype(float), data)
    with pytest.raises(ValueError):
        resample.affine(volume(spark, data), "v", eye, data.shape, 2)


def test_anti_aliasing_smooths_before_sampling(spark):
    data = np.random.default_rng(7).random((3, 6, 8))
    want = data
    for k, s in enumerate((0.0, 1.0, 0.7)):
        reach = int(np.ceil(4 * s))
        if reach:
            g = np.exp(-0.5 * (np.arange(-reach, reach + 1) / s) ** 2)
            pad = np.pad(want, [(reach, reach) if i == k else (0, 0) for i in range(3)], mode="symmetric")
            want = np.apply_along_axis(lambda v: np.convolve(v, g / g.sum(), "valid"), k, pad)  # noqa: B023
    matrix = [[1, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0]]
    got = dense(resample.affine(volume(spark, data), "v", matrix, (3, 3, 4), 0, anti_aliasing=(0.0, 1.0, 0.7)), "v", (3, 3, 4)).astype(float)
    assert np.allclose(got, want[:, ::2, ::2])


def test_gaps_nulls_and_nothing(spark):
    rows = [(0, 0, x, None if x == 2 else float(x)) for x in range(6) if x != 4]
    some = spark.createDataFrame(rows, "z long, y long, x long, v double")
    full = spark.createDataFrame([(0, 0, x, 9.0 if x in (2, 4) else float(x)) for x in range(6)], "z long, y long, x long, v double")
    half = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0.5, 0]]
    a, b = ({r.x: r.v for r in resample.affine(v, "v", half, (1, 1, 12), 3, fill=9.0).collect()} for v in (some, full))
    assert a == pytest.approx(b) and a[11] == 9.0
    data = np.full((3, 3, 4), 2.0)
    data[1, 2, 3], data[0, 0, 1] = 5.0, 7.0
    one = spark.createDataFrame([(1, 2, 3, 5.0), (0, 0, 1, 7.0)], "z long, y long, x long, v double")
    at = [[1, 0, 0, 0], [0, 1, 0, 0.5], [0, 0, 0.5, 0]]
    a, b = (resample.affine(v, "v", at, (3, 3, 8), 3, fill=2.0, source=(3, 3, 4), block=(2, 2, 2)) for v in (one, volume(spark, data)))
    assert np.allclose(dense(a, "v", (3, 3, 8)).astype(float), dense(b, "v", (3, 3, 8)).astype(float))
    empty = spark.createDataFrame([], "z long, y long, x long, v double")
    assert [r.v for r in resample.affine(empty, "v", half, (1, 1, 2), 3, fill=4.0).collect()] == [4.0, 4.0]
