"""Scans, sinks and element-wise operators on voxel and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.functions.expr import compare, log_odds, normalized, reducer, unsigned
from gridloom.model import AXES, region
from gridloom.plans.scratch import Scratch


def copy_volume(vox: DataFrame, value: str, *, begin=None, end=None, fit_to_roi: bool = False, value_list=None, offset: float | None = None, skip_empty_blocks: bool = False, uniform_to_background: bool = False, dtype: str | None = None, int_to_uint: int | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Copy with the filters of a copy: region, values kept, offset of what isn't 0, uniform blocks, insertion, type.

    ``int_to_uint`` is the number of bits of a signed type; ``previous(z, y, x, value)`` shows where the copy is 0.
    """
    if dtype and int_to_uint:
        raise ValueError("int_to_uint and dtype exclude each other")
    if begin is not None:
        vox = region(vox, begin, end)
        if fit_to_roi:
            vox = vox.withColumns({c: F.col(c) - int(b) for c, b in zip(AXES, begin)})
    out: Column = F.col(value)
    if value_list is not None:
        out = F.when(out.isin(list(value_list)), out).otherwise(0)
    if offset is not None:
        out = F.when(out != 0, out + offset).otherwise(out)
    if int_to_uint:
        out = unsigned(out, int_to_uint)
    vox = vox.withColumn(value, out)
    if skip_empty_blocks or uniform_to_background:
        w = Window.partitionBy("block_id")
        low, high = F.min(value).over(w), F.max(value).over(w)
        vox = vox.withColumns({"_low": low, "_high": high})
        if uniform_to_background:
            vox = vox.withColumn(value, F.when(F.col("_low") == F.col("_high"), 0).otherwise(F.col(value)))
        if skip_empty_blocks:
            vox = vox.where((F.col("_low") != 0) | (F.col("_high") != 0))
        vox = vox.drop("_low", "_high")
    if previous is not None:
        old = previous.select(*AXES, F.col(value).alias("_old"))
        vox = vox.join(old.hint("merge"), list(AXES), "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit(0)), F.col("_old"), F.lit(0))).drop("_old")
    return vox.withColumn(value, F.col(value).cast(dtype)) if dtype else vox


def stack_predictions(raw: DataFrame, predictions: DataFrame, value: str = "v") -> DataFrame:
    """The raw volume as channel 0, the channels of the prediction behind it."""
    first = raw.select(F.lit(0).cast("long").alias("c"), *AXES, value)
    return first.unionByName(predictions.select((F.col("c") + 1).cast("long").alias("c"), *AXES, value))


def write_labels(vox: DataFrame, label: str, lut: DataFrame, *, allow_missing: bool = False, offsets: DataFrame | None = None) -> DataFrame:
    """Map labels by ``lut(label, new_label)``; ``offsets(block_id, offset)`` are added to labels but 0 first.

    Labels without an entry are an error, or stay with ``allow_missing``.
    """
    if offsets is not None:
        vox = vox.join(offsets, "block_id").withColumn(label, F.when(F.col(label) == 0, 0).otherwise(F.col(label) + F.col("offset"))).drop("offset")
    entry = lut.select(F.col("label").alias(label), F.col("new_label").alias("_new"))
    out = vox.join(entry, label, "left")
    new = F.coalesce("_new", label) if allow_missing else F.coalesce("_new", F.raise_error(F.concat(F.lit("label without assignment: "), F.col(label).cast("string"))).cast("long"))
    return out.withColumn(label, new).drop("_new")


def to_boundaries(channels: DataFrame, method: str = "mean", channel_begin: int | None = None, channel_end: int | None = None, value: str = "v") -> DataFrame:
    """Reduce the channels ``[channel_begin, channel_end)`` of ``(c, z, y, x, value)`` by a named reducer."""
    if channel_begin is not None and channel_end is not None and not channel_begin < channel_end:
        raise ValueError("empty range of channels")
    if channel_begin is not None:
        channels = channels.where(F.col("c") >= channel_begin)
    if channel_end is not None:
        channels = channels.where(F.col("c") < channel_end)
    return channels.groupBy(*AXES).agg(reducer(method)(value).alias(value))


def probs_to_costs(edges: DataFrame, probability: str = "p", *, size: str | None = None, invert: bool = False, transform: bool = True, weighting_exponent: float = 1.0, beta: float = 0.5, node_labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """Edges with ``cost``; ``node_labels`` has tables ``(node, label)`` by mode.

    ``ignore``: an end with a label is repelled. ``isolate``: both ends attract, one repels. ``ignore_transition``:
    different labels repel. The strengths are five times the least and the largest cost. Edges whose sizes or costs are
    compared with all others' are written once, as they are read twice and may come from all voxels.
    """
    if size or node_labels:
        edges = Scratch(edges.sparkSession, "costs").save(edges, "edges")
    p = 1 - F.col(probability) if invert else F.col(probability)
    cost = log_odds(p, beta) if transform else p
    if size:
        # one row: the largest size
        most = F.broadcast(edges.agg(F.max(size).alias("_most")))
        edges = edges.crossJoin(most)
        cost = cost * F.pow(F.col(size) / F.col("_most"), weighting_exponent)
    out = edges.withColumn("cost", cost).drop("_most")
    if not node_labels:
        return out
    bounds = F.broadcast(out.agg((5 * F.min("cost")).alias("_repel"), (5 * F.max("cost")).alias("_attract")))
    out = out.crossJoin(bounds)
    for mode, labels in node_labels.items():
        out = out.join(labels.select(F.col("node").alias("u"), F.col("label").alias("_lu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("label").alias("_lv")), "v", "left")
        lu, lv = F.coalesce("_lu", F.lit(0)), F.coalesce("_lv", F.lit(0))
        a, b = lu != 0, lv != 0
        if mode == "ignore":
            cost = F.when(a | b, F.col("_repel"))
        elif mode == "isolate":
            cost = F.when(a & b, F.col("_attract")).when(a | b, F.col("_repel"))
        elif mode == "ignore_transition":
            cost = F.when(lu != lv, F.col("_repel"))
        else:
            raise ValueError(f"mode {mode!r}")
        out = out.withColumn("cost", cost.otherwise(F.col("cost"))).drop("_lu", "_lv")
    return out.drop("_repel", "_attract")


def with_ends(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Edges with the labels ``lu`` and ``lv`` of their ends; a node without one has 0."""
    one = lambda end, name: labels.select(F.col("node").alias(end), F.col(label).alias(name))
    return edges.join(one("u", "lu"), "u", "left").join(one("v", "lv"), "v", "left").fillna(0, ["lu", "lv"])


def edge_labels(edges: DataFrame, labels: DataFrame, ignore_label: bool = False) -> DataFrame:
    """1 where the ends' labels differ, 0 where not, and -1 where one is 0 and ``ignore_label`` is set."""
    found = F.when(F.col("lu") != F.col("lv"), 1).otherwise(0)
    if ignore_label:
        found = F.when((F.col("lu") == 0) | (F.col("lv") == 0), -1).otherwise(found)
    return with_ends(edges, labels).withColumn("edge_label", found.cast("int")).drop("lu", "lv")


def costs_from_node_labels(lifted: DataFrame, labels: DataFrame, intra: float = 6.0, inter: float = -6.0) -> DataFrame:
    return with_ends(lifted, labels).withColumn("cost", F.when(F.col("lu") == F.col("lv"), intra).otherwise(inter)).drop("lu", "lv")


def threshold(vox: DataFrame, value: str, level: float, mode: str = "greater", by: str = "block_id", channels: list[int] | None = None) -> DataFrame:
    """1 where the block-wise normalised value (or mean of channels) compares, else 0."""
    if channels is not None:
        vox = vox.where(F.col("c").isin(channels)).groupBy(by, *AXES).agg(F.avg(value).alias(value))
    return vox.withColumn(value, normalized(value, by)).withColumn(value, compare(F.col(value), level, mode).cast("int"))


def linear(vox: DataFrame, value: str, transformation: tuple[float, float] | DataFrame, mask: str | None = None) -> DataFrame:
    """``a * v + b`` by one pair or by a table ``(z, a, b)``; only where the mask is set, if there is one."""
    if isinstance(transformation, DataFrame):
        vox = vox.join(transformation, "z")
        a, b = F.col("a"), F.col("b")
    else:
        a, b = (F.lit(float(t)) for t in transformation)
    new = a * F.col(value) + b
    out = vox.withColumn(value, F.when(F.col(mask), new).otherwise(F.col(value)) if mask else new)
    return out.drop("a", "b") if isinstance(transformation, DataFrame) else out
