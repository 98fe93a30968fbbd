"""Per-object operators: centres and surfaces without a group of an object's voxels, skeletons with one."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import AXES
from gridloom.operators import kernels
from gridloom.operators.distances import squared_distances
from gridloom.operators.surfaces import PLACES, surface_faces


def _crop(frame: pd.DataFrame, border: int = 1) -> tuple[np.ndarray, np.ndarray]:
    at = frame[list(AXES)].to_numpy()
    begin = at.min(axis=0) - border
    mask = np.zeros(at.max(axis=0) - begin + 1 + border, bool)
    mask[tuple((at - begin).T)] = True
    return mask, begin


def _objects(vox: DataFrame, label: str, size_threshold: int | None, ignore_label: int | None) -> DataFrame:
    own = vox.select(*AXES, F.col(label).alias("id"))
    if ignore_label is not None:
        own = own.where(F.col("id") != ignore_label)
    if size_threshold:
        large = own.groupBy("id").count().where(F.col("count") >= size_threshold).select("id")
        own = own.join(large, "id", "left_semi")
    return own


def region_centers(vox: DataFrame, label: str, ignore_label: int | None = 0, resolution=(1.0, 1.0, 1.0)) -> DataFrame:
    """``(id, z, y, x)``: the voxel of each object farthest from its border, the first in scan order of equals."""

    far = squared_distances(_objects(vox, label, None, ignore_label), resolution)
    order = F.struct("square", *[-F.col(c) for c in AXES])
    return far.groupBy("id").agg(F.max_by(F.struct(*AXES), order).alias("p")).select("id", *[f"p.{c}" for c in AXES])


def skeletonize(vox: DataFrame, label: str, resolution=(1.0, 1.0, 1.0), size_threshold: int | None = None) -> DataFrame:
    """``(id, nodes, edges)``: thinned objects, nodes in units of the resolution, edges between touching voxels."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask, begin = _crop(frame, 2)
        points = np.argwhere(kernels.thinned(mask))
        index = {tuple(p): k for k, p in enumerate(points.tolist())}
        edges = []
        for (z, y, x), k in index.items():
            for dz, dy, dx in product((-1, 0, 1), repeat=3):
                other = index.get((z + dz, y + dy, x + dx))
                if other is not None and other > k:
                    edges.append([k, other])
        nodes = ((points + begin) * np.array(resolution)).tolist()
        return pd.DataFrame({"id": [frame["id"].iloc[0]], "nodes": [nodes], "edges": [edges]})

    return _objects(vox, label, size_threshold, 0).groupBy("id").applyInPandas(run, "id long, nodes array<array<double>>, edges array<array<int>>")


def upsample_skeletons(skeletons: DataFrame, vox: DataFrame, label: str, scale: tuple[int, int, int]) -> DataFrame:
    """``(z, y, x, id)``: nodes brought to the finer grid, where the object has the voxel."""
    nodes = skeletons.select("id", F.explode("nodes").alias("n"))
    at = nodes.select("id", *[(F.col("n")[k] * s).cast("long").alias(c) for k, (c, s) in enumerate(zip(AXES, scale))])
    return at.join(vox.select(*AXES, F.col(label).alias("id")).hint("merge"), ["id", *AXES], "left_semi").select(*AXES, "id").distinct()


#: Triangles that are packed at a time, if an object hasn't more.
PACKED = 200_000


def _packed(ids: np.ndarray, places: np.ndarray, resolution, smoothing: int) -> pa.RecordBatch:
    """The meshes of whole objects; ``places`` are the corners of a triangle, ``ids`` in order of objects."""
    names, which = np.unique(ids, return_inverse=True)
    corners, owner = places.reshape(-1, 3), np.repeat(which, 3)
    order = np.lexsort((*corners.T[::-1], owner))
    corners, owner = corners[order], owner[order]
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(owner) != 0) | (np.diff(corners, axis=0) != 0).any(axis=1)
    f = np.empty(len(order), np.int64)
    f[order] = np.cumsum(first) - 1
    f = f.reshape(-1, 3)
    f = f[np.lexsort(f.T[::-1])]
    v, owner = corners[first] / 2 * np.array(resolution), owner[first]
    if smoothing:
        ends = np.unique(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=0)
    for _ in range(smoothing):
        total = np.zeros_like(v)
        np.add.at(total, ends[:, 0], v[ends[:, 1]])
        v = total / np.bincount(ends[:, 0], minlength=len(v))[:, None]
    normal = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
    own = np.zeros_like(v)
    for c in range(3):
        np.add.at(own, f[:, c], normal)
    own /= np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    # corners are numbered within their object
    begin = np.searchsorted(owner, np.arange(len(names) + 1))
    cut = np.searchsorted(owner[f[:, 0]], np.arange(len(names) + 1))
    rows = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, 3), pa.int32()), pa.array(values.ravel())))
    local = (f - begin[owner[f[:, 0]]][:, None]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names), rows(v, begin), rows(local, cut), rows(own, begin)], ["id", "vertices", "faces", "normals"])


def meshes(vox: DataFrame, label: str, resolution=(1.0, 1.0, 1.0), size_threshold: int | None = None, smoothing: int = 0, shape: str = "squares", block: tuple[int, int, int] = (32, 64, 64)) -> DataFrame:
    """``(id, vertices, faces, normals)``: the closed surface of each object in one row, vertices and faces in order.

    Triangles are made by blocks (see ``surfaces``, whose tables hold surfaces of any size); only the packing takes an
    object's triangles, never its voxels, as a group, and many small objects at once. Smoothing moves each vertex to the mean
    of its neighbours, as many times.
    """

    def run(batches):
        ids, places, held = [], [], 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            at = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(PLACES))])
            # the batch's last object may go on in the next one
            whole = int(np.searchsorted(own, own[-1]))
            if held + whole >= PACKED and (whole or own[-1] != ids[-1][-1]):
                yield _packed(np.concatenate([*ids, own[:whole]]), np.concatenate([*places, at[:whole]]), resolution, smoothing)
                ids, places, held, own, at = [], [], 0, own[whole:], at[whole:]
            ids.append(own)
            places.append(at)
            held += len(own)
        if held:
            yield _packed(np.concatenate(ids), np.concatenate(places), resolution, smoothing)

    faces = surface_faces(_objects(vox, label, size_threshold, 0), block, shape)
    placed = faces.repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(run, "id long, vertices array<array<double>>, faces array<array<int>>, normals array<array<double>>")


def as_obj(mesh: DataFrame) -> DataFrame:
    """``(id, value)``: meshes as text of the obj format, vertices in x, y, z order."""
    line = lambda kind: (lambda a: F.concat_ws(" ", F.lit(kind), a[2].cast("string"), a[1].cast("string"), a[0].cast("string")))
    corner = lambda a: F.concat_ws(" ", F.lit("f"), *[F.concat_ws("//", (a[k] + 1).cast("string"), (a[k] + 1).cast("string")) for k in range(3)])
    return mesh.select("id", F.concat_ws("\n", F.transform("vertices", line("v")), F.transform("normals", line("vn")), F.transform("faces", corner)).alias("value"))
