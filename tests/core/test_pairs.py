"""Pairs of neighbours, made within blocks."""

import numpy as np
import pytest

from gridloom.model import lower_pairs
from tests.core.test_operators import volume


@pytest.mark.parametrize("block", [(1, 1, 1), (2, 3, 4), (16, 32, 32)])
def test_every_pair_once_whatever_the_block(spark, block):
    data = np.random.default_rng(8).integers(0, 50, (3, 5, 6))
    vox = volume(spark, data).where("v <> 7").selectExpr("z - 1 AS z", "y", "x", "v", "v + 1 AS w")
    want = []
    for at in np.ndindex(*data.shape):
        for k in range(3):
            to = tuple(np.array(at) + np.eye(3, dtype=int)[k])
            if to[k] < data.shape[k] and data[at] != 7 and data[to] != 7:
                want.append((at[0] - 1, *at[1:], data[at], data[at] + 1, k, data[to]))
    got = [(r.z, r.y, r.x, r.v_a, r.w, r.axis, r.v_b) for r in lower_pairs(vox, ["v"], ["w"], block).collect()]
    assert sorted(got) == sorted(want) and len(want) > 150


def test_voxels_are_shuffled_once(spark):
    vox = volume(spark, np.arange(24).reshape(2, 3, 4))
    pairs = lower_pairs(vox, ["v"])
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange ") == 1 and "Join" not in final


def test_nulls_and_nothing(spark):
    rows = [(0, 0, 0, None), (0, 0, 1, 4), (0, 0, 3, 5), (None, 0, 2, 6)]
    some = spark.createDataFrame(rows, "z long, y long, x long, v long")
    assert [(r.x, r.v_a, r.v_b) for r in lower_pairs(some, ["v"]).collect()] == [(0, None, 4)]
    assert lower_pairs(some.limit(0), ["v"]).count() == 0
