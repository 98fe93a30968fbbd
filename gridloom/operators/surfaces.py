"""Surfaces of objects by blocks: triangles are made cell by cell and share vertices by their place on a grid.

A vertex has whole coordinates on the grid of half voxels (voxel centres are even), so blocks agree on it without a word
between them, and welding is an aggregation by object and place. Nothing here gathers an object; only ``meshes`` in
``objects`` packs a surface into one row.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import permutations, product
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import AXES
from gridloom.plans.scratch import Scratch

CORNERS = "abc"
PLACES = [f"{k}{c}" for k in CORNERS for c in AXES]


def _outward(points: list[tuple], inside: np.ndarray, outside: np.ndarray) -> list[tuple]:
    """The corners of a triangle in the order whose normal points from inside to outside."""
    a, b, c = np.array(points)
    return points if np.cross(b - a, c - a) @ (outside - inside) > 0 else [points[0], points[2], points[1]]


def _tetrahedra() -> list[tuple[list, list[tuple[tuple, list]]]]:
    """Six tetrahedra fill a cell, each a way along three edges from its lowest corner to its highest.

    Each comes with the triangles for every set of its corners inside; vertices stand halfway on the edges that are cut.
    """
    out = []
    for way in permutations(np.eye(3, dtype=int)):
        corners = [np.zeros(3, int), way[0], way[0] + way[1], way[0] + way[1] + way[2]]
        cases = []
        for bits in product((False, True), repeat=4):
            ins, outs = [c for c, b in zip(corners, bits) if b], [c for c, b in zip(corners, bits) if not b]
            if not ins or not outs:
                continue
            ring = [tuple((i + o).tolist()) for i in ins for o in outs]
            if len(ring) == 4:
                ring = [ring[0], ring[1], ring[3], ring[2]]
            triangles = [[ring[0], ring[k], ring[k + 1]] for k in range(1, len(ring) - 1)]
            middle = [np.mean(side, axis=0) for side in (ins, outs)]
            cases.append((bits, [_outward(t, *middle) for t in triangles]))
        out.append(([tuple(c.tolist()) for c in corners], cases))
    return out


def _squares() -> list[tuple[list, list[tuple[tuple, list]]]]:
    """The faces between a voxel and its three upper neighbours, two triangles each, on the corners of voxels."""
    out = []
    for k in range(3):
        far = np.eye(3, dtype=int)[k]
        i, j = np.eye(3, dtype=int)[[a for a in range(3) if a != k]]
        ring = [tuple((far + s * i + t * j).tolist()) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        triangles = [[ring[0], ring[1], ring[2]], [ring[0], ring[2], ring[3]]]
        ends = [np.zeros(3), far]
        cases = [((a, not a), [_outward(t, *(ends if a else ends[::-1])) for t in triangles]) for a in (True, False)]
        out.append(([(0, 0, 0), tuple(far.tolist())], cases))
    return out


SHAPES = {"tetrahedra": _tetrahedra(), "squares": _squares()}


def triangles(mask: np.ndarray, shape: str) -> np.ndarray:
    """``(n, 9)``: triangles of all cells of a mask whose lowest corner has an upper neighbour along each axis."""
    size = np.array(mask.shape) - 1
    found = [np.zeros((0, 9), np.int64)]
    for corners, cases in SHAPES[shape]:
        inside = [mask[tuple(slice(o, o + n) for o, n in zip(c, size))] for c in corners]
        code = reduce(add, [m.astype(np.int8) << k for k, m in enumerate(inside)])
        mixed = np.argwhere((code != 0) & (code != (1 << len(corners)) - 1))
        codes = code[tuple(mixed.T)]
        for bits, made in cases:
            at = mixed[codes == sum(b << k for k, b in enumerate(bits))]
            found += [(2 * at[:, None, :] + np.array(t)[None]).reshape(-1, 9) for t in made]
    return np.concatenate(found)


#: Bit k of a cell's code is set if corner k is inside, corners in the order z, y, x.
CELL = list(product((0, 1), repeat=3))


@lru_cache
def _cell_triangles(shape: str) -> tuple[np.ndarray, np.ndarray]:
    """``(start, rows)``: the triangles of a cell of code c are ``rows[start[c]:start[c + 1]]``, places from its lowest corner."""
    each = [triangles(np.array([c >> k & 1 for k in range(8)], bool).reshape(2, 2, 2), shape) for c in range(256)]
    return np.cumsum([0, *map(len, each)]), np.concatenate(each)


@lru_cache
def _cell_counts() -> np.ndarray:
    """``(256, 3)``: vertices, edges and open edges that a cell of tetrahedra owns, by its code.

    A place belongs to the cell it has the lowest coordinates of. An edge within a side of a cell is of the triangles of two
    cells. What each of them has there must follow from the side's four corners alone, which is checked here for all codes,
    so the triangles on both sides are known in one cell.
    """
    start, rows = _cell_triangles("tetrahedra")
    inside, lower, upper, owned = [], [{} for _ in AXES], [{} for _ in AXES], np.zeros((256, 3), np.int64)
    at = lambda code, k, far: tuple(code >> j & 1 for j, c in enumerate(CELL) if c[k] == far)
    for code in range(256):
        edges = {}
        for t in rows[start[code] : start[code + 1]].reshape(-1, 3, 3).tolist():
            for i, j in ((0, 1), (1, 2), (2, 0)):
                p, q = tuple(t[i]), tuple(t[j])
                n, turns = edges.get((min(p, q), max(p, q)), (0, 0))
                edges[min(p, q), max(p, q)] = n + 1, turns + (1 if p < q else -1)
        # where an edge lies in two sides, more than two cells would share it
        if any(sum(p[k] == q[k] != 1 for k in range(3)) > 1 for p, q in edges):
            raise ValueError("an edge along an edge of a cell")
        for k in range(3):
            for sides, far in ((lower, 0), (upper, 1)):
                move = lambda p: p[:k] + (0,) + p[k + 1 :]  # noqa: B023, E731
                found = {(move(p), move(q)): n for (p, q), n in edges.items() if p[k] == q[k] == 2 * far}
                if sides[k].setdefault(at(code, k, far), found) != found:
                    raise ValueError("a side that doesn't follow from its corners")
        inside.append([n for (p, q), n in edges.items() if not any(p[k] == q[k] != 1 for k in range(3))])
        # a vertex halfway between two corners is there if one of them is inside
        places = set(map(tuple, rows[start[code] : start[code + 1]].reshape(-1, 3).tolist()))
        cut = lambda v: len({code >> CELL.index(tuple(c)) & 1 for c in ([i // 2 for i in v], [(i + 1) // 2 for i in v])}) == 2  # noqa: B023, E731
        if places != {v for v in product(range(3), repeat=3) if cut(v)}:
            raise ValueError("a vertex that doesn't follow from its corners")
        owned[code, 0] = sum(max(v) < 2 for v in places)
    for code in range(256):
        met = list(inside[code])
        for k in range(3):
            here, below = lower[k][at(code, k, 0)], upper[k][at(code, k, 0)]
            met += [tuple(map(add, here.get(e, (0, 0)), below.get(e, (0, 0)))) for e in {*here, *below}]
        owned[code, 1:] = len(met), sum(n != 2 or turns != 0 for n, turns in met)
    return owned


def _copied(own: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    """Voxels with the blocks ``bz, by, bx`` of the cells they are corners of."""
    placed = own.select("id", *AXES).dropna()
    for c, b in zip(AXES, block):
        both = F.array_distinct(F.array(*[F.floor((F.col(c) - k) / b).cast("long") for k in (1, 0)]))
        placed = placed.withColumn(f"b{c}", F.explode(both))
    return placed


def _cells(frame: pd.DataFrame, block: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(names, which, low, code)`` of a block: for each object and cell that it has a corner of, the object's number among
    the names, the cell's lowest corner and its code. Memory goes with the voxels, whatever the number of objects."""
    begin = np.array([frame[f"b{c}"].iloc[0] for c in AXES]) * block
    names, own = np.unique(frame["id"].to_numpy(), return_inverse=True)
    at = frame[list(AXES)].to_numpy() - begin
    keys, bits = [], []
    for k, corner in enumerate(CELL):
        low = at - corner
        # cells of this block alone: their lowest corners from its first voxel to its last
        held = ((low >= 0) & (low < block)).all(axis=1)
        low = low[held]
        keys.append(((own[held] * block[0] + low[:, 0]) * block[1] + low[:, 1]) * block[2] + low[:, 2])
        bits.append(np.full(len(low), 1 << k))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    code = np.zeros(len(key), np.int64)
    np.bitwise_or.at(code, back, np.concatenate(bits))
    which, *low = np.unravel_index(key, (len(names), *block))
    return names, which, np.stack(low, axis=1) + begin, code


def surface_faces(own: DataFrame, block: tuple[int, int, int] = (32, 64, 64), shape: str = "tetrahedra") -> DataFrame:
    """``(id, az … cx)``: the triangles of each object of ``own(z, y, x, id)``, corners in half voxels, normals outward.

    ``tetrahedra`` cut cells of eight voxel centres halfway along their edges: a closed surface, every edge in exactly
    two triangles. ``squares`` are the faces of voxels, two triangles each, which enclose exactly the voxels; where voxels of
    an object touch along an edge only, that edge is in four. A voxel is copied to the blocks of the cells it is a corner of.
    """
    if shape not in SHAPES:
        raise ValueError(f"shape {shape!r}")
    start, rows = _cell_triangles(shape)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, which, low, code = _cells(frame, block)
        count = np.diff(start)[code]
        cell = np.repeat(np.arange(len(code)), count)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
        made = rows[start[code][cell] + nth] + np.tile(2 * low, 3)[cell]
        return pd.DataFrame({"id": names[which[cell]], **{c: made[:, k] for k, c in enumerate(PLACES)}})

    schema = "id long, " + ", ".join(f"{c} long" for c in PLACES)
    return _copied(own, block).groupBy(*[f"b{c}" for c in AXES]).applyInPandas(run, schema)


def object_measures(own: DataFrame, block: tuple[int, int, int] = (32, 64, 64), resolution=(1.0, 1.0, 1.0)) -> DataFrame:
    """What ``surface_measures`` says of the surfaces of tetrahedra of ``own(z, y, x, id)``, without a table of triangles.

    Each vertex, edge and triangle is of one cell and follows from the cell's corners (see ``_cell_counts``), so a block adds
    up those of its cells and sends on one row an object.
    """
    start, rows = _cell_triangles("tetrahedra")
    points = rows.reshape(-1, 3, 3)
    normal = np.cross(points[:, 1] - points[:, 0], points[:, 2] - points[:, 0])
    scaled = points * (np.array(resolution, float) / 2)
    each = np.linalg.norm(np.cross(scaled[:, 1] - scaled[:, 0], scaled[:, 2] - scaled[:, 0]), axis=1) / 2
    total = lambda values: np.add.reduceat(np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)]), start[:-1]) * (np.diff(start) > 0).reshape(-1, *[1] * (values.ndim - 1))
    area, normals, six = total(each), total(normal), total((points[:, 0] * normal).sum(axis=1))
    counts = np.column_stack([_cell_counts(), np.diff(start)])
    names = ["vertices", "edges", "open_edges", "faces"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, which, low, code = _cells(frame, block)
        found = np.zeros((len(ids), len(names) + 1), np.int64)
        # six times the volume that triangles span with the origin, moved to the place of their cell
        np.add.at(found, which, np.column_stack([counts[code], six[code] + 2 * (low * normals[code]).sum(axis=1)]))
        return pd.DataFrame({"id": ids, **{c: found[:, k] for k, c in enumerate([*names, "six"])}, "area": np.bincount(which, area[code], len(ids))})

    schema = ", ".join(f"{c} long" for c in ["id", *names, "six"]) + ", area double"
    parts = _copied(own, block).groupBy(*[f"b{c}" for c in AXES]).applyInPandas(run, schema)
    out = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in [*names, "area", "six"]]).where("faces > 0")
    cell = float(np.prod(resolution)) / 48
    return out.select("id", "vertices", "edges", "faces", "open_edges", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"), "area", (F.col("six") * cell).alias("volume"))


def _corner(k: str):
    return F.struct(*[F.col(f"{k}{c}").alias(c) for c in AXES])


def surface_vertices(faces: DataFrame, resolution=(1.0, 1.0, 1.0)) -> DataFrame:
    """``(id, place, z, y, x, nz, ny, nx)``: each vertex once, its position and its unit normal, triangles weighed by area."""
    at = {k: [F.col(f"{k}{c}") * (float(r) / 2) for c, r in zip(AXES, resolution)] for k in CORNERS}
    u, w = ([q - p for p, q in zip(at["a"], at[k])] for k in "bc")
    # in z, y, x order a cross product has the sign it has in x, y, z order for the same order of corners
    cross = [u[(k + 1) % 3] * w[(k + 2) % 3] - u[(k + 2) % 3] * w[(k + 1) % 3] for k in range(3)]
    each = faces.select("id", *[n.alias(f"n{c}") for n, c in zip(cross, AXES)], F.explode(F.array(*[_corner(k) for k in CORNERS])).alias("place"))
    total = each.groupBy("id", "place").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in AXES])
    length = F.greatest(F.sqrt(reduce(add, [F.col(f"n{c}") ** 2 for c in AXES])), F.lit(1e-12))
    place = [(F.col(f"place.{c}") * (float(r) / 2)).alias(c) for c, r in zip(AXES, resolution)]
    return total.select("id", "place", *place, *[(F.col(f"n{c}") / length).alias(f"n{c}") for c in AXES])


def surface_edges(faces: DataFrame) -> DataFrame:
    """``(id, p, q, faces, turns)``: edges with their triangles, and how many more run from p to q than back (0 if closed)."""
    ends = F.array(*[F.struct(_corner(i).alias("i"), _corner(j).alias("j")) for i, j in ("ab", "bc", "ca")])
    each = faces.select("id", F.explode(ends).alias("e")).select("id", F.least("e.i", "e.j").alias("p"), F.greatest("e.i", "e.j").alias("q"), F.when(F.col("e.i") < F.col("e.j"), 1).otherwise(-1).alias("t"))
    return each.groupBy("id", "p", "q").agg(F.count("*").alias("faces"), F.sum("t").alias("turns"))


def surface_measures(faces: DataFrame, resolution=(1.0, 1.0, 1.0)) -> DataFrame:
    """``(id, vertices, edges, faces, open_edges, euler, area, volume)`` of each object's surface.

    The volume is the sum of the tetrahedra that triangles span with the origin. Triangles are written once and read
    for sums, edges and vertices. Euler's number is two for each part of a surface without holes.
    """
    faces = Scratch(faces.sparkSession, "surface").save(faces, "faces")
    at = {k: [F.col(f"{k}{c}") for c in AXES] for k in CORNERS}
    turn = lambda u, w: [u[(k + 1) % 3] * w[(k + 2) % 3] - u[(k + 2) % 3] * w[(k + 1) % 3] for k in range(3)]
    six = reduce(add, [p * n for p, n in zip(at["a"], turn(at["b"], at["c"]))])
    scaled = {k: [p * (float(r) / 2) for p, r in zip(at[k], resolution)] for k in CORNERS}
    u, w = ([q - p for p, q in zip(scaled["a"], scaled[k])] for k in "bc")
    area = F.sqrt(reduce(add, [n * n for n in turn(u, w)])) / 2
    cell = float(np.prod(resolution)) / 48
    sums = faces.groupBy("id").agg(F.count("*").alias("faces"), F.sum(area).alias("area"), (F.sum(six) * cell).alias("volume"))
    edges = surface_edges(faces).groupBy("id").agg(F.count("*").alias("edges"), F.count_if(F.expr("turns <> 0 OR faces <> 2")).alias("open_edges"))
    each = faces.select("id", F.explode(F.array(*[_corner(k) for k in CORNERS])).alias("place")).distinct()
    out = sums.join(edges, "id").join(each.groupBy("id").agg(F.count("*").alias("vertices")), "id")
    return out.select("id", "vertices", "edges", "faces", "open_edges", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"), "area", "volume")


def smoothed(vertices: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Vertices moved to the mean of their neighbours, so many times; normals stay those given."""
    ends = F.array(F.struct(F.col("p").alias("place"), F.col("q").alias("other")), F.struct(F.col("q").alias("place"), F.col("p").alias("other")))
    links = edges.select("id", F.explode(ends).alias("e")).select("id", "e.place", "e.other")
    for _ in range(rounds):
        there = vertices.select("id", F.col("place").alias("other"), *AXES)
        moved = links.join(there.hint("merge"), ["id", "other"]).groupBy("id", "place").agg(*[F.avg(c).alias(c) for c in AXES])
        vertices = vertices.drop(*AXES).join(moved.hint("merge"), ["id", "place"])
    return vertices
