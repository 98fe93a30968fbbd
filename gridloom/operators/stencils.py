"""Neighbourhood operators: windows along an axis, shifted joins, and kernels on blocks with a halo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import reducer
from gridloom.model import AXES, Blocking
from gridloom.operators import kernels
from gridloom.operators.blockwise import map_blocks


def _along(axis: str) -> Window:
    return Window.partitionBy(*[c for c in AXES if c != axis]).orderBy(axis)


def rank_filter(vox: DataFrame, value: str, shape: tuple[int, int, int], name: str = "min") -> DataFrame:
    """Minimum (or maximum) of a box of that shape around each voxel, one axis after the other."""
    f = reducer(name)
    for c, size in zip(AXES, shape):
        vox = vox.withColumn(value, f(value).over(_along(c).rangeBetween(-(size // 2), size - size // 2 - 1)))
    return vox


def min_filter(vox: DataFrame, value: str, shape: tuple[int, int, int] = (10, 100, 100)) -> DataFrame:
    return rank_filter(vox, value, shape, "min")


def gradient(vox: DataFrame, value: str) -> DataFrame:
    """Mean over the axes of central differences, one-sided at the ends; an axis of one voxel has 0."""
    total = F.lit(0.0)
    for c in AXES:
        before, after = F.lag(value).over(_along(c)), F.lead(value).over(_along(c))
        one = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - F.col(value)).when(before.isNotNull(), F.col(value) - before).otherwise(0.0)
        total = total + one
    return vox.withColumn(value, total / 3)


def gradients(volumes: list[DataFrame], value: str, average: bool = False) -> DataFrame:
    """A channel for each input's gradient, or their mean."""
    out = None
    for c, vox in enumerate(volumes):
        own = gradient(vox, value).select(F.lit(c).cast("long").alias("c"), *AXES, value)
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*AXES).agg(F.avg(value).alias(value)) if average else out


def vector_distance(a: str, b: str, norm: str = "l2"):
    """l2 or cosine distance of two array columns."""
    if norm == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if norm == "cosine":
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    raise ValueError(f"norm {norm!r}")


def embedding_distances(vox: DataFrame, vector: str, offsets: list[tuple[int, int, int]], norm: str = "l2") -> DataFrame:
    """``(c, z, y, x, v)``: distance of each voxel's vector to that at each offset."""
    moves = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), *[F.lit(int(d)).alias(a) for a, d in zip(AXES, o)]) for c, o in enumerate(offsets)])
    there = vox.select(*AXES, F.col(vector).alias("_b"), F.explode(moves).alias("m")).select(*[(F.col(a) - F.col(f"m.{a}")).alias(a) for a in AXES], F.col("m.c").alias("c"), "_b")
    return vox.select(*AXES, F.col(vector).alias("_a")).join(there.hint("merge"), list(AXES)).select("c", *AXES, vector_distance("_a", "_b", norm).alias("v"))


def object_affinities(vox: DataFrame, label: str, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """``(c, z, y, x, v)``: 1 where the voxel and the one at the offset are of one object (not 0), else 0."""
    moves = F.array(*[F.struct(F.lit(c).cast("long").alias("c"), *[F.lit(int(d)).alias(a) for a, d in zip(AXES, o)]) for c, o in enumerate(offsets)])
    there = vox.select(*AXES, F.col(label).alias("_b"), F.explode(moves).alias("m")).select(*[(F.col(a) - F.col(f"m.{a}")).alias(a) for a in AXES], F.col("m.c").alias("c"), "_b")
    return vox.select(*AXES, F.col(label).alias("_a")).join(there.hint("merge"), list(AXES)).select("c", *AXES, ((F.col("_a") == F.col("_b")) & (F.col("_a") != 0)).cast("double").alias("v"))


def insert_affinities(affinities: DataFrame, vox: DataFrame, label: str, offsets: list[tuple[int, int, int]], dilate_by: int = 2, zero_objects: list[int] | None = None, erode_by: int = 6) -> DataFrame:
    """Affinities plus the borders of objects: 1 - object affinity at borders, widened in the plane, clipped to 1.

    The mean of the in-plane channels is added to the channel along z; the eroded inside of ``zero_objects`` is 0.
    """
    own = object_affinities(vox, label, offsets).withColumn("v", 1 - F.col("v"))
    for c in ("y", "x"):
        own = own.withColumn("v", F.max("v").over(Window.partitionBy("c", *[a for a in AXES if a != c]).orderBy(c).rangeBetween(-dilate_by, dilate_by)))
    plane = own.where("c IN (1, 2)").groupBy(*AXES).agg(F.avg("v").alias("_p"))
    own = own.join(plane.hint("merge"), list(AXES), "left").select("c", *AXES, F.when(F.col("c") == 0, F.col("v") + F.coalesce("_p", F.lit(0.0))).otherwise(F.col("v")).alias("_o"))
    out = affinities.join(own.hint("merge"), ["c", *AXES], "left").withColumn("v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") + F.coalesce("_o", F.lit(0.0))))).drop("_o")
    if zero_objects:
        inside = vox.select(*AXES, F.col(label).isin(list(zero_objects)).cast("int").alias("_in"))
        inside = rank_filter(inside, "_in", (2 * erode_by + 1,) * 3, "min").where("_in = 1")
        out = out.join(inside.hint("merge"), list(AXES), "left").withColumn("v", F.when(F.col("_in") == 1, 0.0).otherwise(F.col("v"))).drop("_in")
    return out


def image_filter(vox: DataFrame, value: str, blocking: Blocking, name: str, sigma: float, halo: tuple[int, int, int], in_2d: bool = False) -> DataFrame:
    """A named filter (gaussian, gradient magnitude, laplacian, hessian eigenvalue) on blocks read with a halo."""

    def run(block: dict) -> dict:
        return {value: kernels.named_filter(block[value], name, sigma, in_2d)}

    return map_blocks(vox, blocking, run, {value: "double"}, {value: "double"}, halo)


def scale_to_boundaries(vox: DataFrame, objects: str, boundary: str, blocking: Blocking, erode_by: int = 12, offset: int = 0, halo: tuple[int, int, int] = (2, 8, 8)) -> DataFrame:
    """Objects fitted to a boundary map: seeds from erosion, one for the background, watershed, ids plus the offset."""

    def run(block: dict) -> dict:
        fitted = kernels.fit_to_boundaries(block[objects], block[boundary], erode_by)
        return {objects: kernels.np.where(fitted > 0, fitted + offset, 0)}

    return map_blocks(vox, blocking, run, {objects: "long", boundary: "double"}, {objects: "long"}, halo)
