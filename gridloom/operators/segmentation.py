"""Segmentation of voxels on blocks: watersheds, mutex watershed, agglomeration, connected components, hole filling.

Labels of a block are moved by ``block_id`` times the voxels of an outer block, so they are unique in the volume.
Two-pass operators run one colour of the checkerboard after the other; the second sees what the first wrote.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import reducer
from gridloom.model import AXES, Blocking
from gridloom.operators import kernels
from gridloom.operators.blockwise import map_blocks
from gridloom.plans.scratch import Scratch


def _channels(vox: DataFrame, value: str, begin: int, end: int | None, method: str) -> DataFrame:
    """A single channel of ``(c, z, y, x, value)``, other columns by their maximum."""
    if "c" not in vox.columns:
        return vox
    keep = vox.where((F.col("c") >= begin) & (F.col("c") < end)) if end is not None else vox.where(F.col("c") >= begin)
    rest = [F.max(c).alias(c) for c in vox.columns if c not in (*AXES, "c", value)]
    return keep.groupBy(*AXES).agg(reducer(method)(value).alias(value), *rest)


def _unique(label: np.ndarray, block_id: int, blocking: Blocking, halo) -> np.ndarray:
    size = int(np.prod([b + 2 * h for b, h in zip(blocking.block, halo)]))
    return np.where(label > 0, label + block_id * size, 0)


def watershed(vox: DataFrame, value: str, blocking: Blocking, *, mask: str | None = None, halo=(0, 0, 0), channel_begin: int = 0, channel_end: int | None = None, channels: str = "mean", invert: bool = False, blocks: list[int] | Column | None = None, **config) -> DataFrame:
    """``(z, y, x, block_id, ws)``: distance transform watershed on each block with its halo."""
    vox = _channels(vox, value, channel_begin, channel_end, channels)
    reads = {value: "double"} | ({mask: "boolean"} if mask else {})

    def run(block: dict) -> dict:
        data = -block[value] if invert else block[value]
        own = block["present"] & block[mask] if mask else block["present"]
        if not own.any():
            return {"ws": np.zeros(own.shape)}
        label = kernels.dt_watershed(data, mask=own, **config)
        if any(halo):  # a label may hang together over the halo alone: its parts in the block are labels of their own
            label = kernels.components(np.where(block["inner"], label, 0))
        return {"ws": _unique(label, block["block_id"], blocking, halo)}

    return map_blocks(vox, blocking, run, reads, {"ws": "long"}, halo, blocks=blocks)


def two_pass_watershed(vox: DataFrame, value: str, blocking: Blocking, *, mask: str | None = None, halo=(1, 2, 2), **config) -> DataFrame:
    """White blocks first; black ones flood from their neighbours' labels as well, so labels go on across faces."""
    scratch = Scratch(vox.sparkSession, "two-pass")
    white, black = blocking.colour() == 0, blocking.colour() == 1
    first = scratch.save(watershed(vox, value, blocking, mask=mask, halo=halo, blocks=white, **config), "white")
    seen = vox.join(first.select(*AXES, F.col("ws").alias("_seed")).hint("merge"), list(AXES), "left").fillna(0, ["_seed"])
    reads = {value: "double", "_seed": "long"} | ({mask: "boolean"} if mask else {})

    def run(block: dict) -> dict:
        own = block["present"] & block[mask] if mask else block["present"]
        seeds = block["_seed"]
        ids = np.unique(seeds[seeds > 0])
        local = np.searchsorted(ids, seeds) + 1
        local[seeds == 0] = 0
        label = kernels.dt_watershed(block[value], mask=own, seeds=local, **config)
        new = _unique(np.maximum(label - len(ids), 0), block["block_id"], blocking, halo)
        old = np.concatenate([[0], ids])[np.minimum(label, len(ids))]
        return {"ws": np.where(label > len(ids), new, old)}

    return first.unionByName(map_blocks(seen, blocking, run, reads, {"ws": "long"}, halo, blocks=black))


def watershed_from_seeds(vox: DataFrame, value: str, seeds: str, blocking: Blocking, *, mask: str | None = None, size_filter: int = 0, channel_begin: int = 0, channel_end: int | None = None, channels: str = "mean") -> DataFrame:
    """``(…, ws)``: flood from the column of seeds."""
    vox = _channels(vox, value, channel_begin, channel_end, channels)
    reads = {value: "double", seeds: "long"} | ({mask: "boolean"} if mask else {})

    def run(block: dict) -> dict:
        own = block["present"] & block[mask] if mask else block["present"]
        height = kernels.normalize(block[value])
        label = kernels.watershed(height, block[seeds], own)
        return {"ws": kernels.apply_size_filter(label, height, size_filter, own) if size_filter else label}

    return map_blocks(vox, blocking, run, reads, {"ws": "long"})


def filling_size_filter(vox: DataFrame, label: str, height: str, discard: DataFrame, blocking: Blocking, preserve_zeros: bool = False) -> DataFrame:
    """Discarded labels are flooded by the others; true background stays with ``preserve_zeros``."""
    from gridloom.operators.filters import filter_blocks

    kept = filter_blocks(vox.withColumn("_own", F.col(label) != 0), label, discard)
    reads = {label: "long", height: "double", "_own": "boolean"}

    def run(block: dict) -> dict:
        free = block["present"] & block["_own"] if preserve_zeros else block["present"]
        return {label: kernels.watershed(block[height], block[label], free)}

    return map_blocks(kept, blocking, run, reads, {label: "long"})


def component_blocks(vox: DataFrame, value: str, blocking: Blocking, *, threshold: float | None = None, mode: str = "greater", mask: str | None = None, sigma: float = 0.0) -> DataFrame:
    """``(…, component)``: components inside each block of the thresholded value, or of equal labels."""
    reads = {value: "double" if threshold is not None else "long"} | ({mask: "boolean"} if mask else {})

    def run(block: dict) -> dict:
        data = block[value]
        if threshold is not None:
            data = kernels.normalize(data)
            if sigma:
                data = kernels.normalize(kernels.gaussian(data, sigma))
            data = {"greater": data > threshold, "less": data < threshold, "equal": data == threshold}[mode]
        own = block["present"] & block[mask] if mask else block["present"]
        return {"component": _unique(kernels.components(np.where(own, data, 0)), block["block_id"], blocking, (0, 0, 0))}

    return map_blocks(vox, blocking, run, reads, {"component": "long"})


def connected_components(spark, vox: DataFrame, value: str, blocking: Blocking, **how) -> DataFrame:
    """The same across blocks: pairs over faces are joined and components numbered from 1."""
    from gridloom.operators.graph import merge_assignments
    from gridloom.operators.overlaps import face_pairs
    from gridloom.operators.voxelwise import write_labels

    parts = Scratch(spark, "components").save(component_blocks(vox, value, blocking, **how), "blocks")
    pairs = face_pairs(parts, "component")
    if how.get("threshold") is None:  # labels that touch are one component only if they are equal
        pairs = _equal_pairs(parts, vox, value)
    lut = merge_assignments(spark, parts.select(F.col("component").alias("label")).distinct(), pairs)
    return write_labels(parts, "component", lut.select(F.col("node").alias("label"), F.col("label").alias("new_label")))


def _equal_pairs(parts: DataFrame, vox: DataFrame, value: str) -> DataFrame:
    from gridloom.model import lower_pairs

    both = parts.join(vox.select(*AXES, F.col(value).alias("_l")).hint("merge"), list(AXES))
    pairs = lower_pairs(both, ["component", "block_id", "_l"]).where("block_id_a <> block_id_b AND _l_a = _l_b AND _l_a <> 0")
    return pairs.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct()


def _affinity_columns(vox: DataFrame, offsets) -> tuple[DataFrame, list[str]]:
    """``(z, y, x, a0, a1, …)`` of ``(c, z, y, x, v)``: one row a voxel."""
    names = [f"a{c}" for c in range(len(offsets))]
    rest = [F.max(c).alias(c) for c in vox.columns if c not in (*AXES, "c", "v")]
    return vox.groupBy(*AXES).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in enumerate(names)], *rest).fillna(0.0, names), names


def mutex_watershed(affinities: DataFrame, offsets: list[tuple[int, int, int]], blocking: Blocking, *, mask: str | None = None, halo=(0, 0, 0), strides=(1, 1, 1), randomize: bool = False, size_filter: int = 25, noise: float = 0.0, blocks: list[int] | Column | None = None) -> DataFrame:
    """``(…, ws)``: mutex watershed of ``(c, z, y, x, v)`` on each block; small parts give way to their neighbours."""
    vox, names = _affinity_columns(affinities, offsets)
    reads = dict.fromkeys(names, "double") | ({mask: "boolean"} if mask else {})

    def run(block: dict) -> dict:
        own = block["present"] & block[mask] if mask else block["present"]
        aff = np.stack([block[n] for n in names])
        label = kernels.mutex_watershed(aff, offsets, 3, strides, own, randomize, noise, block["block_id"])
        if size_filter:
            label = kernels.apply_size_filter(label, 1 - aff[:3].mean(axis=0), size_filter, own)
        return {"ws": _unique(label, block["block_id"], blocking, halo)}

    return map_blocks(vox, blocking, run, reads, {"ws": "long"}, halo, blocks=blocks)


def mutex_state(labelled: DataFrame, affinities: DataFrame, offsets, attractive: int = 3) -> DataFrame:
    """``(a, b, weight, attractive)``: the strongest attractive and repulsive edge between two labels of one block.

    ``labelled(z, y, x, block_id, ws)`` and ``affinities(c, z, y, x, v)``, of a voxel and the one at the channel's offset.
    """
    own = labelled.where("ws > 0").select(*AXES, "block_id", "ws")
    moves = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), *[F.lit(int(d)).alias(a) for a, d in zip(AXES, o)]) for c, o in enumerate(offsets)])
    there = own.select(*AXES, F.col("block_id").alias("_bb"), F.col("ws").alias("_b"), F.explode(moves).alias("m"))
    there = there.select(*[(F.col(a) - F.col(f"m.{a}")).alias(a) for a in AXES], F.col("m.c").alias("c"), "_bb", "_b")
    pairs = own.join(there.hint("merge"), list(AXES)).where("block_id = _bb AND ws <> _b").join(affinities.select("c", *AXES, "v").hint("merge"), ["c", *AXES])
    pulls = F.col("c") < attractive
    strong = F.max(F.when(pulls, F.col("v")).otherwise(1 - F.col("v"))).alias("weight")
    return pairs.groupBy(F.least("ws", "_b").alias("a"), F.greatest("ws", "_b").alias("b"), pulls.alias("attractive")).agg(strong).select("a", "b", "weight", "attractive")


def two_pass_mutex_watershed(affinities: DataFrame, offsets, blocking: Blocking, *, mask: str | None = None, halo=(1, 2, 2), **config) -> tuple[DataFrame, DataFrame]:
    """Labels of both colours, and ``(a, b)``: labels of black blocks and the white neighbours' labels they go on.

    White blocks write their labels, and a table of the attractive and repulsive edges between them. A black block has
    the labels it sees as seeds, and the edges between those compete with its own: what a white block has parted, over
    voxels that the black one doesn't see, stays apart.
    """
    scratch = Scratch(affinities.sparkSession, "two-pass")
    white, black = blocking.colour() == 0, blocking.colour() == 1
    first = scratch.save(mutex_watershed(affinities, offsets, blocking, mask=mask, halo=halo, blocks=white, **config), "white")
    state = scratch.save(mutex_state(first, affinities, offsets), "state")
    vox, names = _affinity_columns(affinities, offsets)
    seen = vox.join(first.select(*AXES, F.col("ws").alias("_seed")).hint("merge"), list(AXES), "left").fillna(0, ["_seed"])
    reads = dict.fromkeys(names, "double") | {"_seed": "long"} | ({mask: "boolean"} if mask else {})
    # edges between labels that a black block sees both of
    placed = blocking.with_halo(first.where("ws > 0").select(*AXES, "ws"), halo)
    sees = scratch.save(placed.where(black).select("block_id", "ws").distinct(), "sees")
    beside = state.join(sees.select("block_id", F.col("ws").alias("a")).hint("merge"), "a").join(sees.select("block_id", F.col("ws").alias("b")).hint("merge"), ["block_id", "b"])

    def run(block: dict) -> dict:
        own = block["present"] & block[mask] if mask else block["present"]
        seeds, known = block["_seed"], block["beside"].sort_values(["a", "b", "attractive"])
        edges = tuple(known[c].to_numpy() for c in ("a", "b", "weight", "attractive"))
        label = kernels.mutex_watershed(np.stack([block[n] for n in names]), offsets, 3, config.get("strides", (1, 1, 1)), own, seeds=seeds, state=edges)
        unique = _unique(label, block["block_id"], blocking, halo)
        goes = np.unique(np.stack([unique[seeds > 0], seeds[seeds > 0]], axis=1), axis=0)
        goes = goes[goes[:, 0] > 0]
        return {"ws": unique, "_of": np.zeros_like(unique), "more": pd.DataFrame({"ws": goes[:, 0], "_of": goes[:, 1]})}

    second = scratch.save(map_blocks(seen, blocking, run, reads, {"ws": "long", "_of": "long"}, halo, blocks=black, beside=beside), "black")
    pairs = second.where("z IS NULL").select(F.col("ws").alias("a"), F.col("_of").alias("b")).distinct()
    return first.unionByName(second.where("z IS NOT NULL").drop("_of")), pairs


def _block_graph(label: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges between neighbouring labels, with the mean of the larger values over their faces and the sizes."""
    us, vs, ws = [], [], []
    for k in range(label.ndim):
        a = tuple(slice(1, None) if i == k else slice(None) for i in range(label.ndim))
        b = tuple(slice(None, -1) if i == k else slice(None) for i in range(label.ndim))
        on = label[a] != label[b]
        us.append(np.minimum(label[a], label[b])[on])
        vs.append(np.maximum(label[a], label[b])[on])
        ws.append(np.maximum(value[a], value[b])[on])
    pairs = np.stack([np.concatenate(us), np.concatenate(vs)], axis=1)
    edges, back = np.unique(pairs, axis=0, return_inverse=True)
    size = np.bincount(back.ravel(), minlength=len(edges)).astype(float)
    total = np.bincount(back.ravel(), np.concatenate(ws), minlength=len(edges))
    return edges.reshape(-1, 2).astype(np.int64), total / np.maximum(size, 1), size, pairs


def agglomerate(vox: DataFrame, label: str, value: str, blocking: Blocking, *, threshold: float = 0.9, mala: bool = True, size_regularizer: float = 0.5, have_ignore_label: bool = True, invert: bool = False) -> DataFrame:
    """Merge the fragments of each block by average linkage, up to a threshold or to a share of their number."""

    def run(block: dict) -> dict:
        ids, local = np.unique(block[label], return_inverse=True)
        local = local.reshape(block[label].shape)
        data = kernels.normalize(-block[value] if invert else block[value])
        edges, mean, size, _ = _block_graph(local, data)
        if have_ignore_label and ids[0] == 0:
            mean = np.where((edges == 0).any(axis=1), 1.0, mean)
        counts = np.bincount(local.ravel(), minlength=len(ids))
        if mala:
            found = kernels.average_linkage(len(ids), edges, mean, size, threshold=threshold)
        else:
            found = kernels.average_linkage(len(ids), edges, mean, size, clusters=max(1, int(threshold * len(ids))), size_regularizer=size_regularizer, node_sizes=counts)
        first = np.full(found.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, found, ids)
        return {label: first[found][local]}

    return map_blocks(vox, blocking, run, {label: "long", value: "double"}, {label: "long"})


def slice_agglomeration(vox: DataFrame, label: str, value: str, shape: tuple[int, int, int], blocking: Blocking, *, beta_stitch: float = 0.5, beta: float = 0.75, invert: bool = False) -> DataFrame:
    """A multicut in each z slice; edges over block borders with the weaker bias."""
    slices = Blocking(shape, (1, shape[1], shape[2]))

    def run(block: dict) -> dict:
        plane = block[label][0]
        ids, local = np.unique(plane, return_inverse=True)
        local = local.reshape(plane.shape)
        data = kernels.normalize(-block[value][0] if invert else block[value][0])
        edges, mean, size, _ = _block_graph(local, data)
        y, x = np.indices(plane.shape)
        home = (y // blocking.block[1]) * 10**6 + x // blocking.block[2]
        of = np.zeros(len(ids), np.int64)
        of[local.ravel()] = home.ravel()
        p = np.clip(mean, 0.001, 0.999)
        b = np.where(of[edges[:, 0]] != of[edges[:, 1]], beta_stitch, beta)
        cost = (np.log((1 - p) / p) + np.log((1 - b) / b)) * size / max(1.0, size.max(initial=1.0))
        keep = ~((edges == 0).any(axis=1)) if ids[0] == 0 else np.ones(len(edges), bool)
        found = kernels.decomposition(len(ids), edges[keep], cost[keep])
        first = np.full(found.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, found, ids)
        return {label: first[found][local][None]}

    return map_blocks(vox, slices, run, {label: "long", value: "double"}, {label: "long"}).drop("block_id")
