"""Pyramids, upscaling and affine resampling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import reducer
from gridloom.model import AXES, Blocking
from gridloom.plans.scratch import Scratch

#: Ways to bring the voxels of a cell to one; the last three are for labels.
MODES = ("mean", "max", "min", "sum", "median", "first", "nearest", "mode")


def _factor(scale) -> tuple[int, int, int]:
    return (scale,) * 3 if isinstance(scale, int) else tuple(scale)


def downscale(vox: DataFrame, value: str, scale, mode: str = "mean", round_values: bool = False) -> DataFrame:
    """A voxel for each cell of ``scale`` voxels. ``mode`` takes the most frequent label, the smaller of equals."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}")
    factor = _factor(scale)
    cell = [F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(AXES, factor)]
    if mode == "mode":
        counts = vox.groupBy(*cell, F.col(value).alias(value)).agg(F.count("*").alias("_n"))
        return counts.groupBy(*AXES).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(value))
    if mode in ("first", "nearest"):
        place = F.struct(*AXES)
        return vox.select(*cell, place.alias("_p"), value).groupBy(*AXES).agg(F.min_by(value, "_p").alias(value))
    out = vox.groupBy(*cell).agg(reducer(mode)(value).alias(value))
    return out.withColumn(value, F.round(value)) if round_values else out


def pyramid(vox: DataFrame, value: str, scales: list, mode: str = "mean") -> list[DataFrame]:
    """The volume and its levels, each from the one before; what is read often is for the caller to keep."""
    levels = [vox.select(*AXES, value)]
    for s in scales:
        levels.append(downscale(levels[-1], value, s, mode))
    return levels


def upscale(vox: DataFrame, value: str, scale, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Each voxel repeated over its cell, cut to the shape."""
    out = vox.select(*AXES, value)
    for c, f in zip(AXES, _factor(scale)):
        out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn(c, (F.col(c) * f + F.col("_o")).cast("long")).drop("_o")
    if shape:
        for c, s in zip(AXES, shape):
            out = out.where(F.col(c) < s)
    return out


def grid(spark, shape: tuple[int, int, int]) -> DataFrame:
    """All coordinates of a shape, made in parallel."""
    n = shape[0] * shape[1] * shape[2]
    at = spark.range(n)
    return at.select(F.floor(F.col("id") / (shape[1] * shape[2])).cast("long").alias("z"), (F.floor(F.col("id") / shape[2]) % shape[1]).cast("long").alias("y"), (F.col("id") % shape[2]).cast("long").alias("x"))


def convolve_lines(vox: DataFrame, value: str, axis: str, taps: np.ndarray, length: int, mode: str = "reflect", fill: float = 0.0) -> DataFrame:
    """Each line of ``length`` voxels along an axis convolved with an odd number of taps, mirrored at its ends as ``np.pad`` does by ``mode``.

    Lines meet in one shuffle and stream past in order; a task holds a batch and a line. Places without a row and nulls
    hold ``fill``; all places of a line come back, if it has a row. Taps of a sum of one leave lines of ``fill`` as they are,
    so that a pass for each axis fills a volume.
    """
    across = [c for c in AXES if c != axis]
    reach = len(taps) // 2

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        lines = frame[across].to_numpy()
        starts = np.flatnonzero(np.append(True, (lines[1:] != lines[:-1]).any(axis=1)))
        at, given = frame[axis].to_numpy(), frame[value].to_numpy(float, na_value=np.nan)
        out = np.empty((len(starts), length))
        for k, (begin, end) in enumerate(zip(starts, np.append(starts[1:], len(frame)))):
            line = np.full(length, fill, float)
            line[at[begin:end]] = np.where(np.isnan(given[begin:end]), fill, given[begin:end])
            out[k] = np.convolve(np.pad(line, reach, mode), taps, "valid")
        where = {c: np.repeat(lines[starts, k], length) for k, c in enumerate(across)} | {axis: np.tile(np.arange(length), len(starts))}
        return pd.DataFrame({c: where[c] for c in AXES} | {value: out.ravel()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            last = (frame[across] == frame[across].iloc[-1]).all(axis=1).to_numpy()
            begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if held and (begin or (held[-1][across].iloc[-1] != frame[across].iloc[0]).any()):
                yield finish(pd.concat([*held, frame.iloc[:begin]], ignore_index=True))
                held = []
            elif begin:
                yield finish(frame.iloc[:begin])
            held.append(frame.iloc[begin:])
        if held:
            yield finish(pd.concat(held, ignore_index=True))

    placed = vox.select(*AXES, F.col(value).cast("double").alias(value)).repartition(*across).sortWithinPartitions(*across, axis)
    return placed.mapInPandas(run, f"z long, y long, x long, `{value}` double")


def spline_coefficients(vox: DataFrame, value: str, shape: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """Coefficients of the cubic B-spline through all voxels of a volume, mirrored at its borders; gaps hold ``fill``.

    The inverse of the sampled spline falls by a factor of 3.7 a voxel, so that past 30 voxels it is below rounding.
    """
    pole = sqrt(3) - 2
    taps = -6 * pole / (1 - pole**2) * pole ** np.abs(np.arange(-30, 31))
    for axis, n in zip(AXES, shape):
        vox = convolve_lines(vox, value, axis, taps, n, "reflect", fill)
    return vox


def smooth(vox: DataFrame, value: str, sigma, shape: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """A Gaussian of one width or one an axis, over four widths, mirrored at the borders."""
    for axis, n, s in zip(AXES, shape, (sigma,) * 3 if np.isscalar(sigma) else sigma):
        if s > 0 and n > 1:
            t = np.arange(-ceil(4 * s), ceil(4 * s) + 1)
            g = np.exp(-0.5 * (t / s) ** 2)
            vox = convolve_lines(vox, value, axis, g / g.sum(), n, "symmetric", fill)
    return vox


def _extent(vox: DataFrame) -> tuple[int, int, int]:
    return tuple((n or 0) + 1 if n is not None else 0 for n in vox.agg(*[F.max(c) for c in AXES]).first())


def _cubic(vox: DataFrame, value: str, placed: DataFrame, source: tuple[int, int, int], fill: float, block: tuple[int, int, int]) -> DataFrame:
    """``placed(_z, _y, _x, _pz, _py, _px)`` with the spline's value; 64 coefficients a voxel are read within its block.

    An output voxel goes to the block of the source it falls in, coefficients there and to the blocks that have them in a
    halo of two; neither is multiplied by the taps in the shuffle.
    """
    keep = [f"_{c}" for c in AXES]
    inside = F.lit(True)
    for c, n in zip(AXES, source):
        inside = inside & F.col(f"_p{c}").between(0, n - 1)
    outside = placed.where(~inside).select(*[F.col(f"_{c}").alias(c) for c in AXES], F.lit(float(fill)).alias(value))
    if 0 in source:
        return outside
    blocking = Blocking(source, tuple(min(b, n) for b, n in zip(block, source)))
    own = placed.where(inside).withColumn("block_id", blocking.block_id(*[F.floor(f"_p{c}") for c in AXES]))
    given = blocking.with_halo(spline_coefficients(vox, value, source, fill), (2, 2, 2)).select("block_id", *AXES, value)

    def run(wanted: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({c: [] for c in [*AXES, value]})
        at = given[list(AXES)].to_numpy()
        low = at.min(axis=0) if len(at) else np.zeros(3, int)
        data = np.zeros(at.max(axis=0) - low + 1 if len(at) else (1, 1, 1))
        data[tuple((at - low).T)] = given[value].to_numpy()
        places, weights = [], []
        for k, (c, n) in enumerate(zip(AXES, source)):
            p = wanted[f"_p{c}"].to_numpy()
            first = np.floor(p).astype(np.int64)
            t = p - first
            weights.append(np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6)
            # mirrored at the borders of the volume; a tap of weight zero may lie past the halo
            i = np.abs(first + np.arange(-1, 3)[:, None])
            i = np.minimum(i, np.maximum(2 * (n - 1) - i, 0))
            places.append(np.clip(i - low[k], 0, data.shape[k] - 1))
        out = np.zeros(len(wanted))
        for i, j, k in product(range(4), repeat=3):
            out += weights[0][i] * weights[1][j] * weights[2][k] * data[places[0][i], places[1][j], places[2][k]]
        return pd.DataFrame({c: wanted[f"_{c}"] for c in AXES} | {value: out})

    found = own.select("block_id", *keep, *[f"_p{c}" for c in AXES]).groupBy("block_id").cogroup(given.groupBy("block_id")).applyInPandas(run, f"z long, y long, x long, `{value}` double")
    return found.unionByName(outside)


def affine(vox: DataFrame, value: str, matrix, shape: tuple[int, int, int], order: int = 1, fill: float = 0.0, anti_aliasing=None, source: tuple[int, int, int] | None = None, block: tuple[int, int, int] = (32, 64, 64)) -> DataFrame:
    """The volume at ``matrix`` times each output voxel: nearest (order 0), linear or cubic spline (3); ``fill`` outside.

    The matrix has three or four rows of four. An output voxel meets its one or eight input voxels in one equi join, the 64 of
    a spline in its block. ``anti_aliasing`` is the width of a Gaussian (one or one an axis) over the input. Both it and
    splines take an input of shape ``source``, by default up to its largest coordinates, whose gaps and nulls hold ``fill``.
    """
    if order not in (0, 1, 3):
        raise ValueError("order 0, 1 or 3")
    if source is None and (order == 3 or anti_aliasing):
        source = _extent(vox)
    if anti_aliasing:
        vox = smooth(vox, value, anti_aliasing, source, fill)
    out = grid(vox.sparkSession, shape)
    at = [sum((F.col(c) * float(m) for c, m in zip(AXES, row)), F.lit(float(row[3]))) for row in list(matrix)[:3]]
    if order == 0:
        placed = out.select(*[F.col(c).alias(f"_{c}") for c in AXES], *[F.floor(a + 0.5).cast("long").alias(c) for a, c in zip(at, AXES)])
        found = placed.join(vox.select(*AXES, value).hint("merge"), list(AXES), "left")
        return found.select(*[F.col(f"_{c}").alias(c) for c in AXES], F.coalesce(value, F.lit(fill)).alias(value))
    placed = out.select(*[F.col(c).alias(f"_{c}") for c in AXES], *[a.alias(f"_p{c}") for a, c in zip(at, AXES)])
    if order == 3:
        return _cubic(vox, value, placed, source, fill, block)
    corners = F.array(*[F.struct(*[F.lit(int(k)).alias(c) for k, c in zip(corner, AXES)]) for corner in product((0, 1), repeat=3)])
    placed = placed.withColumn("_k", F.explode(corners))
    weight = F.lit(1.0)
    for c in AXES:
        part = F.col(f"_p{c}") - F.floor(f"_p{c}")
        weight = weight * F.when(F.col(f"_k.{c}") == 1, part).otherwise(1 - part)
    placed = placed.withColumns({"_w": weight, **{c: (F.floor(f"_p{c}") + F.col(f"_k.{c}")).cast("long") for c in AXES}}).where("_w > 0")
    found = placed.join(vox.select(*AXES, value).hint("merge"), list(AXES), "left")
    total = found.groupBy(*[F.col(f"_{c}").alias(c) for c in AXES]).agg(F.sum(F.col("_w") * F.coalesce(value, F.lit(fill))).alias(value))
    return total


def remap(vox: DataFrame, value: str, coordinates: DataFrame, fill: float = 0.0) -> DataFrame:
    """The volume gathered at given places: ``coordinates(z, y, x, tz, ty, tx)``, as another program transforms them."""
    at = coordinates.select(*AXES, *[F.floor(F.col(f"t{c}") + 0.5).cast("long").alias(f"t{c}") for c in AXES])
    there = vox.select(*[F.col(c).alias(f"t{c}") for c in AXES], value)
    return at.join(there.hint("merge"), [f"t{c}" for c in AXES], "left").select(*AXES, F.coalesce(value, F.lit(fill)).alias(value))


def sub_volume_offsets(blocks: DataFrame) -> DataFrame:
    """``(block_id, offset)``: sums of ``n`` over the blocks before each one (one row a block; a null counts nothing).

    Blocks are range partitioned; a partition's sums begin where those of the ones before it end, which takes a table of
    one row a partition and no task that holds all blocks.
    """
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = blocks.select("block_id", "n").repartitionByRange(parts, "block_id").withColumn("_p", F.spark_partition_id())
    placed = Scratch(spark, "offsets").save(placed, "placed")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    begins = placed.groupBy("_p").agg(F.sum("n").alias("n")).selectExpr("_p", f"coalesce(sum(n) OVER (ORDER BY _p {before}), 0) AS _begin")
    within = placed.selectExpr("block_id", "_p", f"coalesce(sum(n) OVER (PARTITION BY _p ORDER BY block_id {before}), 0) AS _within")
    return within.join(F.broadcast(begins), "_p").select("block_id", (F.col("_begin") + F.col("_within")).alias("offset"))
