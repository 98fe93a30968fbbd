"""Kernels against definitions by brute force on tiny inputs, and invariants."""

from itertools import product

import numpy as np
import pytest

from gridloom.operators import kernels as k


def flood(data):
    label, top = np.zeros(data.shape, int), 0
    for p in np.ndindex(data.shape):
        if data[p] and not label[p]:
            top += 1
            todo = [p]
            label[p] = top
            while todo:
                q = todo.pop()
                for a in range(data.ndim):
                    for s in (-1, 1):
                        r = tuple(c + (s if i == a else 0) for i, c in enumerate(q))
                        if all(0 <= c < n for c, n in zip(r, data.shape)) and data[r] == data[q] and not label[r]:
                            label[r] = top
                            todo.append(r)
    return label


@pytest.mark.parametrize("seed", range(4))
def test_components(seed):
    data = np.random.default_rng(seed).integers(0, 3, (4, 7, 9))
    assert (k.components(data) == flood(data)).all()


def test_distance_transform():
    mask = np.random.default_rng(1).random((4, 6, 7)) < 0.7
    off = np.argwhere(~mask)
    got = k.distance_transform(mask, (2.0, 1.0, 1.5))
    for p in np.ndindex(mask.shape):
        want = 0 if not mask[p] else np.sqrt((((off - p) * (2.0, 1.0, 1.5)) ** 2).sum(1)).min()
        assert abs(got[p] - want) < 1e-9
    assert np.isinf(k.distance_transform(np.ones((2, 2), bool))).all()


def test_watershed_labels_are_connected_and_keep_seeds():
    rng = np.random.default_rng(2)
    height = rng.random((3, 12, 12))
    seeds = np.zeros(height.shape, int)
    for i, p in enumerate(rng.integers(0, (3, 12, 12), (6, 3)), 1):
        seeds[tuple(p)] = i
    mask = rng.random(height.shape) < 0.95
    label = k.watershed(height, seeds, mask)
    assert (label[~mask] == 0).all() and (label[(seeds > 0) & mask] == seeds[(seeds > 0) & mask]).all()
    for i in np.unique(label[label > 0]):
        assert flood((label == i).astype(int)).max() == 1


def test_dt_watershed_covers_the_mask():
    rng = np.random.default_rng(3)
    data = k.gaussian(rng.random((4, 20, 20)), 1.0)
    mask = np.ones(data.shape, bool)
    mask[:, :4] = False
    for in_2d, suppress in product((True, False), (True, False)):
        label = k.dt_watershed(data, size_filter=4, in_2d=in_2d, mask=mask, suppress=suppress)
        assert (label[mask] > 0).all() and (label[~mask] == 0).all()


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for c in range(max(p, default=-1) + 2):
            yield [*p, c]


@pytest.mark.parametrize("seed", range(6))
def test_multicut_solvers(seed):
    rng = np.random.default_rng(seed)
    n = 7
    edges = np.array([(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5 or b == a + 1])
    costs = rng.normal(size=len(edges))
    best = min(k.multicut_energy(edges, costs, np.array(p)) for p in partitions(n))
    one = k.multicut_energy(edges, costs, np.zeros(n, int))
    for name, solver in k.SOLVERS.items():
        labels = solver(n, edges, costs)
        energy = k.multicut_energy(edges, costs, labels)
        assert best - 1e-9 <= energy <= min(one, 0) + 1e-9, name
    assert k.multicut_energy(edges, costs, k.kernighan_lin(n, edges, costs)) <= best + 0.35 * abs(best) + 0.1


def test_lifted_edges_count():
    edges, costs = np.array([[0, 1], [1, 2]]), np.array([1.0, 1.0])
    assert len(set(k.kernighan_lin(3, edges, costs).tolist())) == 1
    assert len(set(k.kernighan_lin(3, edges, costs, lifted=np.array([[0, 2]]), lifted_costs=np.array([-5.0])).tolist())) == 2
    assert len(set(k.greedy_additive(3, edges, -costs, np.array([[0, 2]]), np.array([9.0])).tolist())) == 3


def test_average_linkage_and_graph_watershed():
    edges = np.array([[0, 1], [1, 2], [2, 3]])
    assert k.average_linkage(4, edges, np.array([0.1, 0.8, 0.2]), np.ones(3), threshold=0.5).tolist() == [0, 0, 1, 1]
    assert k.average_linkage(4, edges, np.array([0.1, 0.8, 0.2]), np.ones(3), clusters=1).tolist() == [0, 0, 0, 0]
    assert k.graph_watershed(4, edges, np.array([0.5, 0.1, 0.9]), np.array([7, 0, 0, 3])).tolist() == [7, 7, 7, 3]


def test_mutex_watershed_separates():
    aff = np.full((3, 1, 1, 6), 0.9)
    aff[1, 0, 0, :] = 0.0
    offsets = [(0, 0, -1), (0, 0, -3), (0, 0, -6)]
    label = k.mutex_watershed(aff[:2], offsets[:2], attractive=1)
    assert len(np.unique(label)) > 1
    assert len(np.unique(k.mutex_watershed(np.ones((2, 1, 1, 6)), offsets[:2], attractive=1))) == 1


def test_thinning_keeps_one_piece():
    mask = np.zeros((5, 5, 15), bool)
    mask[1:4, 1:4, 1:14] = True
    thin = k.thinned(mask)
    assert thin.any() and thin.sum() < mask.sum() / 4 and not (thin & ~mask).any()


def test_gaussian_keeps_constants_and_names():
    data = np.full((4, 8, 8), 3.0)
    assert np.allclose(k.gaussian(data, 1.5), 3.0)
    with pytest.raises(ValueError):
        k.named_filter(data, "nothing", 1.0)


def test_one_piece_by_definition():
    """Whether bits of a box hang together, as components of the box say it (diagonals touch)."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        box = rng.random((3, 3, 3)) < rng.choice([0.1, 0.2, 0.4])
        box[1, 1, 1] = False
        if not box.any():
            continue
        points = np.argwhere(box)
        seen = np.zeros(len(points), bool)
        seen[0] = True
        for _ in points:
            seen |= (np.abs(points[:, None] - points[None, seen]).max(axis=2) <= 1).any(axis=1)
        assert k._one_piece(sum(1 << int(b) for b in np.flatnonzero(box.ravel())), 3) == seen.all()
