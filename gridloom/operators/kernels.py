"""Numpy kernels on dense blocks and small graphs. Orders of equal values are fixed, so results are repeatable."""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import product

import numpy as np


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def merge(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return min(a, b)

    def labels(self) -> np.ndarray:
        return np.array([self.find(a) for a in range(len(self.parent))], np.int64)


def components(mask_or_labels: np.ndarray) -> np.ndarray:
    """Face-connected components of equal values but 0, numbered from 1 in scan order, by minimum propagation."""
    data = np.asarray(mask_or_labels)
    label = np.where(data != 0, np.arange(1, data.size + 1).reshape(data.shape), 0)
    while True:
        before = label.copy()
        for axis in range(data.ndim):
            a = [slice(None)] * data.ndim
            b = list(a)
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            a, b = tuple(a), tuple(b)
            same = (data[a] == data[b]) & (data[a] != 0)
            low = np.minimum(label[a], label[b])
            label[a] = np.where(same, low, label[a])
            label[b] = np.where(same, np.minimum(label[b], low), label[b])
        flat = label.ravel()
        step = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0)
        label = step.reshape(data.shape)
        if (label == before).all():
            break
    ids, back = np.unique(label, return_inverse=True)
    return (back.reshape(data.shape) + (0 if ids[0] == 0 else 1)).astype(np.int64)


def gaussian(data: np.ndarray, sigma: float, order: int = 0, axis: int | None = None) -> np.ndarray:
    """Separable Gaussian, mirrored at borders; with an axis and order its derivative along it."""
    out = np.asarray(data, float)
    if sigma <= 0:
        return out
    reach = int(np.ceil(3 * sigma))
    t = np.arange(-reach, reach + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    first = -t / sigma**2 * g
    second = (t**2 / sigma**4 - 1 / sigma**2) * g
    second -= second.mean()
    for k in range(out.ndim):
        if out.shape[k] == 1:
            continue
        kernel = {0: g, 1: -first, 2: second}[order if k == axis else 0]
        padded = np.pad(out, [(reach, reach) if i == k else (0, 0) for i in range(out.ndim)], mode="symmetric")
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel[::-1], "valid"), k, padded)  # noqa: B023
    return out


def named_filter(data: np.ndarray, name: str, sigma: float, in_2d: bool = False) -> np.ndarray:
    """Filters by name on the block brought to 0..1."""
    data = normalize(data)
    if in_2d and data.ndim == 3:
        return np.stack([named_filter(p, name, sigma) for p in data])
    if name == "identity":
        return data
    if name == "gaussianSmoothing":
        return gaussian(data, sigma)
    if name == "gaussianGradientMagnitude":
        return np.sqrt(sum(gaussian(data, sigma, 1, k) ** 2 for k in range(data.ndim)))
    if name == "laplacianOfGaussian":
        return sum(gaussian(data, sigma, 2, k) for k in range(data.ndim))
    if name == "hessianOfGaussianEigenvalues":
        n = data.ndim
        smooth = gaussian(data, sigma)
        grads = [np.gradient(smooth, axis=k) if data.shape[k] > 1 else np.zeros_like(smooth) for k in range(n)]
        hessian = np.empty(data.shape + (n, n))
        for i, j in product(range(n), range(n)):
            hessian[..., i, j] = np.gradient(grads[i], axis=j) if data.shape[j] > 1 else 0
        return np.linalg.eigvalsh((hessian + np.swapaxes(hessian, -1, -2)) / 2)[..., -1]
    raise ValueError(f"no filter {name!r}")


def normalize(data: np.ndarray) -> np.ndarray:
    out = np.asarray(data, float) - np.min(data)
    top = out.max()
    return out / top if top > 0 else out


def distance_transform(mask: np.ndarray, pitch=None) -> np.ndarray:
    """Exact Euclidean distance of each voxel set to the nearest one not set (inf if none), axis by axis."""
    pitch = (1.0,) * mask.ndim if pitch is None else pitch
    square = np.where(mask, np.inf, 0.0)
    for k in range(mask.ndim):
        n = mask.shape[k]
        apart = ((np.arange(n)[:, None] - np.arange(n)[None, :]) * pitch[k]) ** 2
        lines = np.moveaxis(square, k, -1)
        flat = lines.reshape(-1, n)
        out = np.empty_like(flat)
        step = max(1, (1 << 22) // (n * n))
        for at in range(0, len(flat), step):
            out[at : at + step] = (flat[at : at + step, None, :] + apart[None]).min(axis=2)
        square = np.moveaxis(out.reshape(lines.shape), -1, k)
    return np.sqrt(square)


def _neighbours(shape: tuple[int, ...]):
    steps = np.cumprod((1, *shape[::-1]))[:-1][::-1]

    def around(p: int):
        for s, n in zip(steps, shape):
            c = p // s % n
            if c > 0:
                yield p - s
            if c + 1 < n:
                yield p + s

    return around


def watershed(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Seeded flooding over faces in order of height, then of arrival."""
    label = np.where(mask, seeds, 0).ravel() if mask is not None else seeds.ravel().copy()
    free = mask.ravel() if mask is not None else np.ones(label.size, bool)
    h = height.ravel()
    around = _neighbours(height.shape)
    heap = [(h[p], k, p) for k, p in enumerate(np.flatnonzero(label))]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        level, _, p = heapq.heappop(heap)
        for q in around(int(p)):
            if label[q] == 0 and free[q]:
                label[q] = label[p]
                heapq.heappush(heap, (max(level, h[q]), count, q))
                count += 1
    return label.reshape(height.shape)


def local_maxima(data: np.ndarray) -> np.ndarray:
    """Plateaus no lower than their box neighbourhood and above its minimum or alone in it, by id."""
    top = data.copy()
    for k in range(data.ndim):
        padded = np.pad(top, [(1, 1) if i == k else (0, 0) for i in range(data.ndim)], constant_values=-np.inf)
        top = np.maximum.reduce([np.take(padded, np.arange(s, s + data.shape[k]), axis=k) for s in range(3)])
    return components((data >= top) & (data > 0))


def apply_size_filter(label: np.ndarray, height: np.ndarray, size: int, mask: np.ndarray | None = None, stand: int = 0) -> np.ndarray:
    """Labels below the size give way, but for those up to ``stand``: the others flood their voxels."""
    ids, counts = np.unique(label, return_counts=True)
    small = ids[(counts < size) & (ids > stand)]
    if not len(small) or len(small) == (ids != 0).sum():
        return label
    return watershed(height, np.where(np.isin(label, small), 0, label), mask)


def dt_watershed(data: np.ndarray, threshold: float = 0.5, sigma_seeds: float = 2.0, sigma_weights: float = 2.0, alpha: float = 0.8, size_filter: int = 25, pitch=None, in_2d: bool = True, mask: np.ndarray | None = None, suppress: bool = False, seeds: np.ndarray | None = None) -> np.ndarray:
    """Watershed from maxima of the smoothed distance to boundaries; ids from 1, 0 outside the mask.

    ``seeds`` are labels that stand already, whatever their size; new ones get larger ids.
    """
    data = normalize(data)
    if in_2d and data.ndim == 3:
        out = np.zeros(data.shape, np.int64)
        top = 0 if seeds is None else int(seeds.max())
        for k in range(len(data)):
            one = dt_watershed(data[k], threshold, sigma_seeds, sigma_weights, alpha, size_filter, None if pitch is None else pitch[1:], True, None if mask is None else mask[k], suppress, None if seeds is None else seeds[k])
            floor = 0 if seeds is None else int(seeds[k].max())
            new = one > floor
            out[k] = np.where(new, one - floor + top, one)
            top += int(max(0, one.max() - floor))
        return out
    inside = data < threshold
    if mask is not None:
        inside &= mask
    distance = distance_transform(inside, pitch)
    distance[~np.isfinite(distance)] = max(data.shape)
    smooth = gaussian(distance, sigma_seeds)
    found = local_maxima(np.where(inside, smooth, 0))
    if suppress:
        found = suppress_maxima(found, distance)
    if not found.any():
        found = components(np.ones(data.shape, bool) if mask is None else mask)
    top = 0 if seeds is None else int(seeds.max())
    if seeds is not None:
        free = components(np.where(seeds > 0, 0, found))  # what seeds cut in two are two
        found = np.where(seeds > 0, seeds, np.where(free > 0, free + top, 0))
    height = gaussian(alpha * data + (1 - alpha) * (1 - normalize(distance)), sigma_weights)
    label = watershed(height, found, mask)
    if size_filter > 0:
        label = apply_size_filter(label, height, size_filter, mask, top)
    if mask is not None:  # parts of the mask that no seed reaches
        rest = components((label == 0) & mask)
        label = np.where(rest > 0, rest + int(label.max()), label)
    return label


def suppress_maxima(seeds: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Of seeds within the distance of a stronger one only the stronger stays."""
    ids = np.unique(seeds[seeds > 0])
    points = np.array([np.argwhere(seeds == i).mean(axis=0) for i in ids]).reshape(len(ids), seeds.ndim)
    strength = np.array([distance[seeds == i].max() for i in ids])
    kept: list[int] = []
    for k in np.lexsort((ids, -strength)):
        if all(np.linalg.norm(points[k] - points[j]) > strength[j] for j in kept):
            kept.append(k)
    return np.where(np.isin(seeds, ids[kept]), seeds, 0)


def erode(mask: np.ndarray, by: int) -> np.ndarray:
    return distance_transform(mask) > by if by > 0 else mask


def fit_to_boundaries(objects: np.ndarray, boundary: np.ndarray, erode_by: int) -> np.ndarray:
    """Objects regrown from eroded seeds (eroded less where none would be left) with a background seed."""
    boundary = normalize(boundary)
    seeds = np.zeros(objects.shape, np.int64)
    ids = np.unique(objects[objects > 0])
    for i in ids:
        by = erode_by
        while True:
            core = erode(objects == i, by)
            if core.any() or by == 0:
                break
            by //= 2
        seeds[core] = i
    background = int(objects.max()) + 1
    outside = erode(objects == 0, erode_by // 2)
    seeds[outside] = background
    if not seeds.any():
        return objects
    distance = distance_transform(boundary < 0.3)
    distance[~np.isfinite(distance)] = max(boundary.shape)
    height = 0.8 * boundary + 0.2 * (1 - normalize(distance))
    out = watershed(height, seeds)
    return np.where(out == background, 0, out)


def mutex_watershed(affinities: np.ndarray, offsets, attractive: int = 3, strides=(1, 1, 1), mask: np.ndarray | None = None, randomize: bool = False, noise: float = 0.0, seed: int = 0, seeds: np.ndarray | None = None, state: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Kruskal over all edges by strength: attractive channels merge, the others forbid merging; ids from 1.

    Channels hold the affinity of a voxel and the one at the offset; repulsion is 1 - affinity. ``seeds`` are labels
    whose voxels are one cluster each. With ``state``, edges between seeds known from elsewhere (two labels, weight,
    whether attractive), these compete with the others; without it seeds never merge with one another.
    """
    shape = affinities.shape[1:]
    ids = np.arange(np.prod(shape)).reshape(shape)
    rng = np.random.default_rng(seed)
    u, v, w, kind = [], [], [], []
    for c, o in enumerate(offsets):
        if any(abs(d) >= n for d, n in zip(o, shape)):
            continue
        a = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, shape))
        b = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, shape))
        keep = np.ones(ids[a].shape, bool)
        if c >= attractive:
            if randomize:
                keep = rng.random(keep.shape) < 1 / np.prod(strides)
            else:
                keep[:] = False
                keep[tuple(slice(None, None, s) for s in strides)] = True
        if mask is not None:
            keep &= mask[a] & mask[b]
        value = affinities[c][a][keep]
        u.append(ids[a][keep])
        v.append(ids[b][keep])
        w.append(value if c < attractive else 1 - value)
        kind.append(np.full(keep.sum(), c < attractive))
    if state is not None and seeds is not None:
        held, first = np.unique(seeds, return_index=True)
        known = np.isin(state[0], held) & np.isin(state[1], held) & (state[0] > 0) & (state[1] > 0)
        for ends, label in ((u, state[0]), (v, state[1])):
            ends.insert(0, first[np.searchsorted(held, label[known])])
        w.insert(0, state[2][known])
        kind.insert(0, state[3][known].astype(bool))
    u, v, w, kind = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((u, int), (v, int), (w, float), (kind, bool)))
    if noise:
        w = w + rng.normal(scale=noise, size=len(w))
    union = UnionFind(ids.size)
    mutex: dict[int, set[int]] = {}

    def joined(a: int, b: int) -> None:
        new = union.merge(a, b)
        old = b if new == a else a
        for m in mutex.pop(old, ()):
            mutex[m].discard(old)
            mutex[m].add(new)
            mutex.setdefault(new, set()).add(m)

    if seeds is not None:
        roots = []
        for s in np.unique(seeds[seeds > 0]):
            points = ids[seeds == s].ravel().tolist()
            for p in points[1:]:
                joined(union.find(points[0]), union.find(p))
            roots.append(union.find(points[0]))
        for i, a in enumerate(roots if state is None else []):
            for b in roots[:i]:
                mutex.setdefault(a, set()).add(b)
                mutex.setdefault(b, set()).add(a)
    for k in np.lexsort((np.arange(len(w)), -w)).tolist():
        a, b = union.find(int(u[k])), union.find(int(v[k]))
        if a == b or b in mutex.get(a, ()):
            continue
        if kind[k]:
            joined(a, b)
        else:
            mutex.setdefault(a, set()).add(b)
            mutex.setdefault(b, set()).add(a)
    _, label = np.unique(union.labels(), return_inverse=True)
    label = label.reshape(shape) + 1
    return np.where(mask, label, 0) if mask is not None else label


def multicut_energy(edges: np.ndarray, costs: np.ndarray, labels: np.ndarray) -> float:
    return float(costs[labels[edges[:, 0]] != labels[edges[:, 1]]].sum())


def greedy_additive(n: int, edges: np.ndarray, costs: np.ndarray, lifted: np.ndarray | None = None, lifted_costs: np.ndarray | None = None) -> np.ndarray:
    """Contract the most attractive edge while its cost is positive; lifted edges add cost but never contract alone."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    local: list[set[int]] = [set() for _ in range(n)]

    def add(a, b, c):
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c

    for (a, b), c in zip(edges.tolist(), costs.tolist()):
        if a != b:
            add(a, b, c)
            local[a].add(b)
            local[b].add(a)
    if lifted is not None:
        for (a, b), c in zip(lifted.tolist(), lifted_costs.tolist()):
            if a != b:
                add(a, b, c)
    union = UnionFind(n)
    heap = [(-c, a, b) for a in range(n) for b, c in near[a].items() if a < b and c > 0 and b in local[a]]
    heapq.heapify(heap)
    while heap:
        c, a, b = heapq.heappop(heap)
        if union.parent[a] != a or union.parent[b] != b or near[a].get(b) != -c or b not in local[a]:
            continue
        keep, gone = (a, b) if len(near[a]) >= len(near[b]) else (b, a)
        union.parent[gone] = keep
        del near[keep][gone]
        local[keep].discard(gone)
        for m, value in near[gone].items():
            if m == keep:
                continue
            del near[m][gone]
            near[keep][m] = near[m][keep] = near[keep].get(m, 0.0) + value
        for m in local[gone]:
            if m != keep:
                local[m].discard(gone)
                local[m].add(keep)
                local[keep].add(m)
        near[gone], local[gone] = {}, set()
        for m in local[keep]:
            if near[keep].get(m, 0.0) > 0:
                heapq.heappush(heap, (-near[keep][m], min(keep, m), max(keep, m)))
    return np.unique(union.labels(), return_inverse=True)[1]


def kernighan_lin(n: int, edges: np.ndarray, costs: np.ndarray, labels: np.ndarray | None = None, lifted: np.ndarray | None = None, lifted_costs: np.ndarray | None = None, rounds: int = 20) -> np.ndarray:
    """From a greedy start, move single nodes to neighbouring or new clusters and join clusters while the energy falls."""
    labels = greedy_additive(n, edges, costs, lifted, lifted_costs) if labels is None else labels.copy()
    every = edges if lifted is None else np.concatenate([edges, lifted])
    value = costs if lifted is None else np.concatenate([costs, lifted_costs])
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for (a, b), c in zip(every.tolist(), value.tolist()):
        near[a].append((b, c))
        near[b].append((a, c))
    local: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges.tolist():
        local[a].add(b)
        local[b].add(a)
    for _ in range(rounds):
        changed = False
        for a in range(n):
            pull: dict[int, float] = {}
            for b, c in near[a]:
                pull[labels[b]] = pull.get(labels[b], 0.0) + c
            stay = pull.get(labels[a], 0.0)
            best, to = 0.0, -1
            for k in sorted({labels[b] for b in local[a]} - {labels[a]}):
                if pull[k] - stay > best + 1e-12:
                    best, to = pull[k] - stay, k
            if -stay > best + 1e-12 and (labels == labels[a]).sum() > 1:
                best, to = -stay, int(labels.max()) + 1
            if to >= 0:
                labels[a] = to
                changed = True
        joint = greedy_additive(int(labels.max()) + 1, labels[edges], costs, None if lifted is None else labels[lifted], lifted_costs)
        if len(np.unique(joint[labels])) < len(np.unique(labels)):
            labels, changed = joint[labels], True
        if not changed:
            break
    # clusters are connected by local edges
    union = UnionFind(n)
    for a, b in edges[labels[edges[:, 0]] == labels[edges[:, 1]]].tolist() if len(edges) else []:
        union.merge(a, b)
    return np.unique(union.labels(), return_inverse=True)[1]


def decomposition(n: int, edges: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Solve each component of the attractive edges by itself; between them every edge is cut at no loss."""
    union = UnionFind(n)
    for a, b in edges[costs > 0].tolist() if len(edges) else []:
        union.merge(a, b)
    part = np.unique(union.labels(), return_inverse=True)[1]
    out, top = np.zeros(n, np.int64), 0
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(part.max() + 2 if n else 1))
    inner = part[edges[:, 0]] == part[edges[:, 1]] if len(edges) else np.zeros(0, bool)
    by = np.argsort(part[edges[inner, 0]], kind="stable") if inner.any() else np.zeros(0, int)
    own, own_costs = (edges[inner][by], costs[inner][by]) if inner.any() else (np.zeros((0, 2), int), np.zeros(0))
    cuts = np.searchsorted(part[own[:, 0]], np.arange(part.max() + 2 if n else 1)) if len(own) else np.zeros(len(bounds), int)
    at = np.zeros(n, np.int64)
    for k in range(len(bounds) - 1):
        nodes = order[bounds[k] : bounds[k + 1]]
        at[nodes] = np.arange(len(nodes))
        e = own[cuts[k] : cuts[k + 1]]
        found = kernighan_lin(len(nodes), at[e], own_costs[cuts[k] : cuts[k + 1]]) if len(e) else np.arange(len(nodes))
        out[nodes] = found + top
        top += int(found.max()) + 1
    return out


SOLVERS = {"greedy-additive": greedy_additive, "kernighan-lin": kernighan_lin, "decomposition": decomposition}


def average_linkage(n: int, edges: np.ndarray, means: np.ndarray, sizes: np.ndarray, threshold: float | None = None, clusters: int | None = None, size_regularizer: float | None = None, node_sizes: np.ndarray | None = None) -> np.ndarray:
    """Merge the pair with the least size-weighted mean until the threshold or the number of clusters is reached."""
    near: list[dict[int, tuple[float, float]]] = [{} for _ in range(n)]
    for (a, b), m, s in zip(edges.tolist(), means.tolist(), sizes.tolist()):
        total, weight = near[a].get(b, (0.0, 0.0))
        near[a][b] = near[b][a] = (total + m * s, weight + s)
    volume = np.ones(n) if node_sizes is None else node_sizes.astype(float)

    def rank(a, b):
        total, weight = near[a][b]
        value = total / weight
        if size_regularizer:
            value *= 2 / (1 / volume[a] ** size_regularizer + 1 / volume[b] ** size_regularizer)
        return value

    union = UnionFind(n)
    heap = [(rank(a, b), a, b) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    left = n
    while heap and (clusters is None or left > clusters):
        value, a, b = heapq.heappop(heap)
        if union.parent[a] != a or union.parent[b] != b or b not in near[a] or rank(a, b) != value:
            continue
        if threshold is not None and value >= threshold:
            break
        keep, gone = (a, b) if len(near[a]) >= len(near[b]) else (b, a)
        union.parent[gone] = keep
        volume[keep] += volume[gone]
        left -= 1
        del near[keep][gone]
        for m, (total, weight) in near[gone].items():
            if m == keep:
                continue
            del near[m][gone]
            t, w = near[keep].get(m, (0.0, 0.0))
            near[keep][m] = near[m][keep] = (t + total, w + weight)
        near[gone] = {}
        for m in near[keep]:
            heapq.heappush(heap, (rank(min(keep, m), max(keep, m)), min(keep, m), max(keep, m)))
    return np.unique(union.labels(), return_inverse=True)[1]


def graph_watershed(n: int, edges: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Kruskal by weight: clusters merge unless both hold seeds of different labels; 0 stays where no seed reaches."""
    union, label = UnionFind(n), seeds.tolist()
    for k in np.lexsort((np.arange(len(weights)), weights)).tolist():
        a, b = union.find(int(edges[k, 0])), union.find(int(edges[k, 1]))
        if a == b or label[a] and label[b] and label[a] != label[b]:
            continue
        keep = label[a] or label[b]
        label[union.merge(a, b)] = keep
    return np.array([label[union.find(a)] for a in range(n)], np.int64)


@lru_cache
def _touching(ndim: int) -> tuple[int, ...]:
    """For each place of a box of three a side, in C order, the others that touch it, as bits."""
    box = np.array(list(product((-1, 0, 1), repeat=ndim)))
    near = np.abs(box[:, None] - box[None]).max(axis=2) == 1
    return tuple(sum(1 << int(k) for k in np.flatnonzero(row)) for row in near)


@lru_cache(1 << 16)
def _one_piece(around: int, ndim: int) -> bool:
    """Whether the places set in a box hang together."""
    near = _touching(ndim)
    seen = todo = around & -around
    while todo:
        low = todo & -todo
        new = near[low.bit_length() - 1] & around & ~seen
        seen |= new
        todo = (todo ^ low) | new
    return seen == around


def thinned(mask: np.ndarray) -> np.ndarray:
    """Thin to a skeleton: voxels go from the outside in while what is left around them stays in one piece."""
    data = np.pad(mask.astype(bool), 1)
    distance = distance_transform(data)
    box = np.array(list(product((-1, 0, 1), repeat=mask.ndim)))
    bits = np.where(np.abs(box).sum(axis=1) > 0, 1 << np.arange(len(box)), 0)
    faces = int(bits[np.abs(box).sum(axis=1) == 1].sum())
    flat = data.ravel()
    moves = box @ (np.array(data.strides) // data.itemsize)
    changed = True
    while changed:
        changed = False
        points = np.argwhere(data)
        order = np.lexsort((*points.T[::-1], distance[data]))
        for p in np.flatnonzero(flat)[order].tolist():
            around = int(bits[flat[p + moves]].sum())
            # removable if its neighbours hang together and it borders the outside
            if around.bit_count() > 1 and around & faces != faces and _one_piece(around, mask.ndim):
                flat[p] = False
                changed = True
    return data[tuple(slice(1, -1) for _ in range(mask.ndim))]
